"""Episodes replayed in one plan are those replayed one by one."""

from dataclasses import replace
from datetime import date, timedelta

import pytest

from gaugeworks.contract import default_contract
from gaugeworks.ml import corpus, replay
from gaugeworks.ml.ranker import CANDIDATE
from gaugeworks.operators import postings
from gaugeworks.sources.estate import Estate
from gaugeworks.sources.generate import evidence, generate, write_estate

EPISODES = "episode_id string, metric string, ws date, we date, dim string, value string"


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    tables, ep = generate(spark, "service_failure", days=170, per_day=90)
    folder = str(tmp_path_factory.mktemp("replay"))
    write_estate(tables, folder)
    return folder, ep


def test_one_plan_equals_one_by_one(spark, estate):
    folder, ep = estate
    a, z = (date.fromisoformat(x) for x in ep["window"])
    past = [("a", "net_revenue", a, z, None, None), ("b", "order_volume", a, z, None, None), ("c", "order_volume", a - timedelta(days=30), z - timedelta(days=30), "region", "ASIA"), ("early", "net_revenue", date(2000, 1, 10), date(2000, 1, 20), None, None)]
    calendar = [(k, "competitor_promo", a - timedelta(days=k), z, ("ASIA", "EUROPE")[k % 2], "2-HIGH") for k in range(3)] + [(9, "holiday", a, z, "ASIA", "2-HIGH")]
    events = spark.createDataFrame(calendar, "event_id long, event_type string, start_date date, end_date date, region string, channel string")
    texts = evidence(spark, ep)
    e = Estate(spark, folder)
    index = postings.build(texts, ())
    rows = replay.replay_all(e.fact(), e.dispatch(), spark.createDataFrame(past, EPISODES), default_contract(), events, index).collect()
    got = {(r["episode_id"], r["candidate_id"]): r for r in rows}
    assert len(got) == len(rows) and not any(k == "early" for k, _ in got)
    assert ("a", "H-SLA-WH-3") in got and got["a", "H-SLA-WH-3"]["precedence_consistent"] and ("b", "H-PRICE") in got
    contract = default_contract()
    for id_, metric, ws, we, dim, value in past[:3]:
        one = corpus.replay(e, contract, {"episode_id": id_, "metric": metric, "window": (ws, we), "filters": {dim: value} if dim else {}}, events=events, evidence=texts)
        one = {r["candidate_id"]: r for r in one.collect()}
        assert {c for k, c in got if k == id_} == set(one)
        for c, r in one.items():
            for f in [*CANDIDATE.names, "heuristic"]:
                if f not in ("episode_id", "feed_stale", "dose_monotone", "sparse"):
                    assert got[id_, c][f] == (pytest.approx(r[f], rel=1e-6, abs=1e-9) if isinstance(r[f], float) else r[f]), (id_, c, f)


def test_jobs_do_not_grow_with_episodes(spark, estate):
    folder, ep = estate
    e = Estate(spark, folder)
    a, z = (date.fromisoformat(x) for x in ep["window"])
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        group = f"replay-{n}"
        spark.sparkContext.setJobGroup(group, group)
        past = [(f"e{k}", "net_revenue", a - timedelta(days=k), z - timedelta(days=k), None, None) for k in range(n)]
        replay.replay_all(e.fact(), e.dispatch(), spark.createDataFrame(past, EPISODES), replace(default_contract())).collect()
        return len(tracker.getJobIdsForGroup(group))

    assert abs(jobs(8) - jobs(2)) <= 6
