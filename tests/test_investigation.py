"""Planted causes, verdicts, the ranker in the loop, feedback, narration, ranks over ranges."""

import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
from gaugeworks.ml import corpus, ranker
from gaugeworks.operators import feedback, ladder, narrative
from gaugeworks.operators.security import personas
from gaugeworks.plans.investigate import advisories, investigate
from gaugeworks.sources.estate import Estate
from gaugeworks.sources.generate import generate, history, write_estate
from gaugeworks.sources.store import numbered
from gaugeworks.telemetry import timed


def contract():
    c = default_contract()
    return replace(c, metrics={**c.metrics, "net_revenue": replace(c.metrics["net_revenue"], abs_floor=1000.0)})


def planted(spark, folder, scenario, **inputs):
    tables, ep = generate(spark, scenario, days=200, per_day=120)
    write_estate(tables, folder)
    a, z = (date.fromisoformat(x) for x in ep["window"])
    events = spark.createDataFrame(ep["events"], "event_id string, start_date date, end_date date")
    return investigate(Estate(spark, folder, z), contract(), ep["metric"], inputs.pop("persona", "data_analyst"), a, z, ep["filters"], events=events, **inputs), ep


def item(kind, rung, score, **more):
    return {"hyp": {"id": kind, "driver_type": kind, "explanatory_power": 0.5, "exposure": {}} | more, "grade": {"ladder": rung, "path": (), "lag": None, "tests": {}}, "score": score}


def test_rivals_of_another_type_compete():
    top, rival = item("service_failure", "L2", 0.9), item("price_change", "L2", 0.5)
    assert ladder.verdict([top, rival])["status"] == "COMPETING"
    assert [x["hyp"]["id"] for x in ladder.verdict([rival, top])["leaders"]] == ["service_failure", "price_change"]
    assert ladder.verdict([top, item("price_change", "L3", 0.5)])["status"] == "CONFIRMED"  # another rung
    assert ladder.verdict([top, item("service_failure", "L2", 0.5)])["status"] == "CONFIRMED"  # the same type
    assert ladder.verdict([top, item("mix_shift", "L2", 0.5, arithmetic_only=True)])["status"] == "CONFIRMED"
    assert ladder.verdict([item("mix_shift", "L2", 0.9, arithmetic_only=True), rival])["status"] == "CONFIRMED"


def test_a_live_defect_of_data_comes_first():
    v = ladder.verdict([item("service_failure", "L3", 0.9), item("instrumentation", "L0", 0.1)])
    assert v["status"] == "DATA_QUALITY" and [x["hyp"]["id"] for x in v["leaders"]] == ["instrumentation"]
    assert ladder.verdict([item("service_failure", "L3", 0.9), item("instrumentation", "REJECTED", 0.1)])["status"] == "CONFIRMED"


def test_planted_service_failure_is_found(spark, tmp_path):
    """With evidence, precedence and a ranker: the leader is the planted warehouse, with and without the model."""
    from gaugeworks.plans.catalogue import _candidates

    rows = spark.createDataFrame([(k, f"delivery was late and delayed again at store {k}", "service_failure", f"role{k % 3}", f"type{k % 2}", k % 5, "crm") for k in range(12)], "doc_id long, text string, theme string, author_role string, type string, account_id long, domain string")
    out, ep = planted(spark, str(tmp_path / "e"), "service_failure", evidence=rows, cache=narrative.NarrativeCache(str(tmp_path / "c.json")), outbox=str(tmp_path / "o.json"))
    lead = out["hypotheses"][0]
    assert out["status"] == "CONFIRMED" and lead["hyp"]["id"] == ep["drivers"][0]["entity"] and lead["grade"]["ladder"] == "L3"
    assert lead["grade"]["tests"]["corroboration"]["corroborated"] and lead["grade"]["tests"]["precedence"]["cause_onset"] < date.fromisoformat(ep["window"][0])
    assert out["movement"]["plan"] > 0 and out["guard"]["passed"] and out["queued"] == 1 and not out["advisories"]
    model, _ = ranker.train(ranker.featurize(_candidates(spark, "/root/testdata/sf0.001")), grid=((3, 0.1, 2),))
    again, _ = planted(spark, str(tmp_path / "e2"), "service_failure", evidence=rows, model=model)
    assert again["status"] == out["status"] and {h["hyp"]["id"]: h["grade"]["ladder"] for h in again["hypotheses"]} == {h["hyp"]["id"]: h["grade"]["ladder"] for h in out["hypotheses"]}
    assert all("fused" in h for h in again["hypotheses"])
    if not any(h["in_distribution"] for h in again["hypotheses"]):  # withdrawn: the heuristic orders alone
        assert all(h["fused"] == pytest.approx(h["score"]) for h in again["hypotheses"])


def test_nothing_planted_and_missing_rows(spark, tmp_path):
    out, _ = planted(spark, str(tmp_path / "n"), "none")
    assert out["movement"]["verdict"] == "NOT_MATERIAL"
    out, _ = planted(spark, str(tmp_path / "p"), "partial_load")
    assert out["status"] in ("DATA_QUALITY", "UNFIT_DATA")


def test_corpus_of_replayed_episodes(spark, tmp_path):
    episodes = history(spark, str(tmp_path / "h"), range(1), ("service_failure",), days=150, per_day=80)
    bad = {"episode_id": "bad", "metric": "no_such_metric", "window": ("2000-05-01", "2000-05-10"), "drivers": []}
    made = corpus.build(Estate(spark, episodes[0]["folder"]), contract(), [*episodes, bad], str(tmp_path / "f"))
    assert made["episodes"] == [episodes[0]["episode_id"]] and "KeyError" in made["skipped"]["bad"]
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert rows.where("label = 1").select("candidate_id").collect()[0][0] == "H-SLA-WH-3" and {f"f_{n}" for n in ranker.FEATURES} <= set(rows.columns)


def test_entitlements_that_weaken_evidence_are_named():
    reader = personas(default_contract().personas)["regional_manager"]
    weak = item("service_failure", "L1", 0.5)
    weak["grade"]["tests"] = {"counterfactual": {"enough": True, "parallel": False}}
    assert [a["type"] for a in advisories(reader, [weak])] == ["ENTITLEMENT_WEAKENED_EVIDENCE"]
    assert not advisories(personas(default_contract().personas)["cfo"], [weak])


def test_feedback_is_recorded_and_reset(spark, tmp_path):
    path = str(tmp_path / "log")
    assert feedback.read_log(spark, path).count() == 0
    assert feedback.record(spark, path, 1, "r", "m", "H", "accept")["prior"] == pytest.approx(1.12)
    assert feedback.record(spark, path, 2, "r", "m", "H", "reject", "wrong site", "ann")["prior"] == pytest.approx(1.12 * 0.75)
    with pytest.raises(ValueError):
        feedback.record(spark, path, 3, "r", "m", "H", "maybe")
    assert feedback.corrections(feedback.read_log(spark, path)).count() == 1
    assert feedback.reset(spark, path, 4) == 1 and feedback.priors(feedback.read_log(spark, path)).first()["prior"] == 1.0
    assert feedback.record(spark, path, 5, "r", "m", "H", "accept")["prior"] == pytest.approx(1.12)


def test_narration_falls_back_on_the_template(tmp_path):
    who = personas(default_contract().personas)["data_analyst"]
    packet = narrative.evidence_packet({"actual": 100.0, "expected": 150.0, "delta": -50.0}, [], {"status": "UNKNOWN", "leaders": []}, [], None, who, "net_revenue")
    asked = []

    def model(p, persona, rejected):
        asked.append(list(rejected))
        return "It fell by 7,777 units." if len(asked) == 1 else "It fell by 50."

    good = narrative.told(packet, who, "model", model, narrative.NarrativeCache(str(tmp_path / "c.json")))
    assert good["text"] == "It fell by 50." and good["attempts"] == 2 and asked == [[], [7777.0]]
    assert narrative.told(packet, who, "model", model, narrative.NarrativeCache(str(tmp_path / "c.json")))["cached"]
    assert narrative.told(packet, who, "simulate_bad")["mode"] == "fallback" and narrative.told(packet, who, "simulate")["guard"]["passed"]
    assert narrative.cacheable_system_block("x")["cache_control"] and narrative.rendered("x", packet, who)["to"] == "data_analyst"


def test_alpha_scorecard_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("e", "a", 1.0, 0.1, 0), ("e", "b", 0.9, 0.9, 1), ("f", "a", 1.0, 0.2, 0), ("f", "b", 0.8, 0.9, 1)], "episode_id string, candidate_id string, heuristic double, p double, label int").withColumn("in_distribution", F.lit(True))
    alpha, tried = ranker.choose_alpha(rows, 1)
    assert set(tried) == set(ranker.ALPHAS) and 0 < alpha <= 0.5 and tried[alpha] == 1.0 > tried[0.0]
    assert "top-1" in ranker.scorecard({"ndcg": 0.5}, [{"true_type": "x", "top1": 1.0, "episodes": 2}], [{"driver_type": "x", "recall": 1.0}])
    held = ranker.RankerCache()
    assert held.get(str(tmp_path / "none")) is None
    (tmp_path / "card").write_text("")
    assert held.get(str(tmp_path / "card")) is None
    assert timed(lambda: 3)[1] == 3


def test_places_over_ranges_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k, rng.randrange(4)) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, w int").repartition(7)
    got = {(r["a"], r["b"]): r["before"] for r in numbered(df, ["a", "b"], "w").collect()}
    total, want = 0, {}
    for a, b, w in sorted(rows):
        want[a, b], total = total, total + w
    assert got == want
