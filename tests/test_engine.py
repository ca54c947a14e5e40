"""The metric engine: queries against their SQL, operators on hand-made frames, rules on small results."""

from datetime import date
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.contract import Contract, ContractError, Definition, DefinitionSet, default_contract, parse
from gaugeworks.functions import fiscal, scalars
from gaugeworks.ml.calibration import Isotonic, pool_adjacent_violators
from gaugeworks.ml.gbdt import BoostedTrees, FlatTrees
from gaugeworks.ml import ranker
from gaugeworks.operators import actions, causal, definitions, feedback, ladder, narrative, series, sift
from gaugeworks.operators.graph import CausalGraph
from gaugeworks.operators.security import RESTRICTED, Persona, filter_evidence, personas
from gaugeworks.plans import catalogue
from gaugeworks.sources import estate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["kpi_daily_additive", "reorder_rate_weekly", "drill_down_closure", "price_volume_mix", "expected_band", "did_log_ratio", "bm25_scores", "causal_paths", "estate_sweep", "feedback_priors", "auc"])
def test_query_equals_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted((tuple(r) for r in df.select(*names).collect()), key=key), sorted(cur.fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(x, (int, float)) for x in a + b) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-4) for x, y in zip(a, b, strict=True))


def test_fiscal_tokens():
    assert fiscal.period_bounds("FY2027-Q2") == (date(2026, 7, 1), date(2026, 9, 30)) and fiscal.period_bounds("FY2027-M05") == (date(2026, 8, 1), date(2026, 8, 31))
    for bad in ("FY27", "FY2027-Q5", "FY2027-M13", ""):
        with pytest.raises(ValueError):
            fiscal.period_bounds(bad)
    assert fiscal.describe_window(date(2026, 3, 25), date(2026, 4, 5))["crosses_year"]


def test_fiscal_months(spark):
    w = spark.createDataFrame([(date(2026, 3, 25), date(2026, 4, 5)), (date(2026, 5, 20), date(2026, 6, 10))], "ws date, we date")
    rows = fiscal.months_in_window(w).orderBy("month_start").collect()
    assert [r["overlap_days"] for r in rows] == [7, 5, 12, 10] and [r["fiscal_month"] for r in rows] == [12, 1, 2, 3]


def test_contract(spark):
    c = default_contract().resolved()
    assert c.selected["net_revenue"] == "finance" and c.sliceable("otd_pct", "region") and not c.sliceable("otd_pct", "city")
    with pytest.raises(KeyError):
        c.metric("nope")
    with pytest.raises(ContractError):
        parse("sum(x) + java_method('a')")
    y = Contract.from_yaml("metrics: {m: {kind: additive, source: s, numerator: sum(x)}}\nfiscal_start_month: 1")
    assert y.metric("m").numerator == "sum(x)" and y.fiscal_start_month == 1


def test_definitions_without_a_rule_are_refused():
    d = DefinitionSet("m", (Definition("a", "sum(x)", "x"), Definition("b", "sum(y)", "y")))
    assert definitions.resolve(d)["status"] == "UNRESOLVED"
    assert definitions.resolve(replace(d, rule="authority_precedence", precedence=("b", "a")))["selected"] == "b"
    assert definitions.refusal(replace(default_contract(), definitions={"m": d}), "m")["status"] == "KPI_DEFINITION_UNRESOLVED"


def test_security(spark):
    p = personas(default_contract().personas)["regional_manager"]
    assert p.refused({"region": "EUROPE"}) == ["region"] and not p.refused({"region": "ASIA"}) and not p.may_see_row({"region": "EUROPE"})
    df = spark.createDataFrame([("ASIA", "web", "call +91 9876543210 or a@b.com"), ("EUROPE", "crm", "x")], "region string, domain string, text string")
    rows = filter_evidence(df, replace(p, deny_domains=("crm",))).collect()
    assert rows[0]["text"] == "call [phone] or [email]" and rows[1]["withheld_reason"] == "domain:crm" and rows[1]["text"] is None


def test_detection_finds_a_planted_drop(spark):
    rng = np.random.default_rng(4)
    days = [(date.fromordinal(date(2026, 1, 1).toordinal() + k), float(1000 + 100 * (k % 7 == 0) + rng.normal(0, 10) - (300 if k >= 180 else 0))) for k in range(190)]
    s = spark.createDataFrame(days, "d date, v double")
    m = replace(default_contract().metric("net_revenue"), abs_floor=100.0)
    r = sift.detect_many(s, days[180][0], days[-1][0], m).first()
    assert r["material"] and r["verdict"] == "MATERIAL" and r["z"] < -5 and r["persistence"] >= 3
    assert sift.detect_many(s.where(F.col("d") < F.lit(days[30][0])), days[20][0], days[29][0], m).first()["verdict"] == "INSUFFICIENT_HISTORY"
    assert causal.effect_onset(series.expected_band(s), days[180][0], days[-1][0], 5 * r["sigma"]).first()["onset"] == days[180][0]


def test_graph_and_ladder():
    g = CausalGraph(*(lambda c: (c.edges, c.blocked))(default_contract()))
    assert g.paths("warehouse_sla", "net_revenue")[0][0] == "warehouse_sla" and not g.paths("weather", "reorder_behaviour")
    h = {"id": "H", "driver_type": "service_failure", "cause": "warehouse_sla", "explanatory_power": 0.6, "exposure": {}}
    did = {"counterfactual": {"enough": True, "parallel": True, "p_value": 0.01}}
    top = ladder.grade(h, "net_revenue", g, did)
    assert top["ladder"] == "L3" and ladder.grade({**h, "cause": "nothing"}, "net_revenue", g, did)["ladder"] == "REJECTED"
    item = {"hyp": h, "grade": top, "score": ladder.rank_score(h, top)}
    assert ladder.verdict([item])["status"] == "CONFIRMED" and ladder.verdict([])["status"] == "UNKNOWN"
    weak = ladder.grade(h, "net_revenue", g, {"precedence": {"consistent": True}})
    assert ladder.verdict([{**item, "grade": weak}] * 2)["status"] == "COMPETING"
    c = default_contract()
    recs = actions.recommend(c, "net_revenue", ladder.verdict([item]), -1e6)
    assert recs and actions.route(c, recs[0], "CONFIRMED") == "AI_LED" and actions.route(c, {**recs[0], "expected_impact": 9e9}, "CONFIRMED") == "HUMAN_LED"
    assert actions.recommend(c, "net_revenue", {"status": "UNKNOWN", "leaders": []}, 1)[0]["abstention"]


def test_guard_and_packet():
    assert narrative.numeric_guard("a gap of 4.2 and 9.7", {"d": "Rs -1.85 Cr", "p": -16.1})["rejected"] == [4.2, 9.7]
    assert narrative.numeric_guard("down 1.85 in 2026, 10 days", {"d": -1.85})["passed"]
    blind = Persona("x", deny_columns=("net_revenue",))
    p = narrative.evidence_packet({"delta": 5.0, "actual": 1.0, "expected": 2.0}, [], {"status": "UNKNOWN", "leaders": []}, [], None, blind, "net_revenue")
    assert p["movement"]["delta"] == RESTRICTED and RESTRICTED in narrative.narrate(p, blind)


def test_cache_and_outbox(tmp_path):
    now = [0.0]
    c = narrative.NarrativeCache(str(tmp_path / "c.json"), ttl=10, most=2, clock=lambda: now[0])
    for k in "abc":
        now[0] += 1
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    now[0] = 50
    assert c.get("c") is None and narrative.queue(str(tmp_path / "o.json"), {"to": "x"}) == 1


def test_p_values():
    assert scalars.student_two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-3) and scalars.student_two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float)
    m = BoostedTrees(rounds=40, min_child_weight=1).fit(x, y)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.93
    assert (FlatTrees.from_json(m.to_json()).raw(x) == m.raw(x)).all()
    groups = np.repeat(np.arange(100), 6)
    r = BoostedTrees("lambdarank", rounds=30, min_child_weight=0.01).fit(x, y, groups)
    assert ranker._ndcg(y, r.raw(x), groups) > 0.9
    assert pool_adjacent_violators(np.array([1.0, 0.0, 2.0]), np.ones(3)).tolist() == [0.5, 0.5, 2.0]
    iso = Isotonic.fit([0.1, 0.2, 0.3, 0.4], [0, 1, 0, 1]).predict([0.0, 0.25, 0.9])
    assert (np.diff(iso) >= 0).all() and iso.max() <= 0.999
    with pytest.raises(ValueError):
        ranker.assert_no_leakage(["share_abs", "Label"])
    assert len(ranker.FEATURES) == 42 and ranker.Ranker.load(None) is None


def test_ranker_bound_keeps_whole_episodes(spark, small):
    from gaugeworks.plans.catalogue import _candidates

    rows = ranker.featurize(_candidates(spark, small)).cache()
    sizes = {r["episode_id"]: r["count"] for r in rows.groupBy("episode_id").count().collect()}
    some = {r["episode_id"]: r["count"] for r in ranker._whole_episodes(rows, rows.count() // 3).groupBy("episode_id").count().collect()}
    assert 0 < len(some) < len(sizes) and all(sizes[e] == n for e, n in some.items()) and sum(some.values()) <= rows.count() // 3
    cards = [ranker.train(rows.repartition(n, "candidate_id"), max_rows=rows.count() // 3, grid=((3, 0.1, 2),)) for n in (1, 5)]
    assert cards[0][1]["rows"] == rows.count() and cards[0][1]["episodes"] == len(sizes)
    assert cards[0][0].to_json() == cards[1][0].to_json()


def test_fusion_and_priors(spark):
    e = spark.createDataFrame([("e", "a", 1.0, 0.1), ("e", "b", 0.02, 0.9), ("f", "a", 0.3, None)], "episode_id string, candidate_id string, heuristic double, p double").withColumn("in_distribution", F.lit(True))
    hard, soft = ({(r[0], r[1]): r["fused"] for r in ranker.fuse(e, a).collect()} for a in (0.99, 0.5))
    assert hard == soft and hard["f", "a"] == 0.3
    log = spark.createDataFrame([(k, "m", "h", g, None, "x") for k, g in enumerate(["accept"] * 8 + ["reject", "partial"])], "seq long, metric string, hypothesis_id string, grade string, correction string, analyst string")
    assert feedback.priors(log).first()["prior"] == pytest.approx(1.2)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    estate.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, estate.read_csv(spark, str(tmp_path / "c"), "k int, v string").collect())) == [(1, "a"), (2, "b")]
    estate.append_log(df, str(tmp_path / "l"))
    estate.append_log(df, str(tmp_path / "l"))
    estate.save_snapshot(df, str(tmp_path / "s"), "r1")
    estate.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4 and spark.read.parquet(str(tmp_path / "s")).where("run_id = 'r1'").count() == 2
    assert estate.replicate(df, 3, "k").select("k").distinct().count() == 6 and estate.applicable({"k": 1, "z": 2}, df) == ({"k": 1}, ["z"])


def test_streaming(spark, small, tmp_path):
    from gaugeworks.streaming import monitors

    src = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(2).write.parquet(str(src))
    ev = monitors.event_stream(spark, str(src))
    q = monitors.without_duplicates(ev).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable(), q.stop()
    assert spark.table("once").count() == spark.read.parquet(str(src)).select("event_id").distinct().count()
    q = monitors.daily_totals(ev, "60 days").writeStream.outputMode("append").format("memory").queryName("daily").start()
    q.processAllAvailable(), q.stop()
    seen: list = []
    q = monitors.freshness(ev, 60, seen, "2100-01-01").start()
    q.processAllAvailable(), q.stop()
    assert seen and seen[-1]["breached"]
    q = monitors.sliding_totals(ev, late="1 day").writeStream.outputMode("update").format("memory").queryName("slide").start()
    q.processAllAvailable(), q.stop()
    assert spark.table("slide").count() > 0


def test_investigation(spark, small):
    from gaugeworks.plans.investigate import STAGES, investigate

    e, c = estate.Estate(spark, small), default_contract()
    assert investigate(e, c, "net_revenue", "regional_manager", date(2000, 3, 1), date(2000, 3, 14), {"region": "EUROPE"})["status"] == "ENTITLEMENT_DENIED"
    out = investigate(e, c, "net_revenue", "data_analyst", date(2000, 3, 1), date(2000, 3, 14))
    assert out["status"] in ("CONFIRMED", "COMPETING", "UNKNOWN", "DATA_QUALITY", "UNFIT_DATA", "INSUFFICIENT_HISTORY") and out["stages"] == list(STAGES)
    if "guard" in out:
        assert out["guard"]["passed"] and abs(out["identity"]["residual"]) < 1
