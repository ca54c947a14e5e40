"""A planned past: what is planned, how effects compose, and that a replay recovers them."""

from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
from gaugeworks.ml import ranker, replay
from gaugeworks.operators import postings
from gaugeworks.plans import catalogue, past
from gaugeworks.sources import history

LINE = "order_id long, line_no int, order_date date, account_id long, region string, channel string, category string, tier string, warehouse_id string, units double, price double, on_time boolean, ship_date date"
EFFECT = "episode_id string, driver int, kind string, region string, entity string, start date, end date, strength double, second double, docs int, contested boolean"
D = date(2000, 6, 1)


def line(n, day=D, region="ASIA", channel="x", category="c", tier="N", shop="WH-1", units=10.0, price=100.0, on_time=True):
    return (n, 1, day, n, region, channel, category, tier, shop, units, price, on_time, day)


def effect(kind, entity, strength, second=0.0, region="ASIA", start=D - timedelta(days=20), end=D + timedelta(days=5), id_="e", driver=0):
    return (id_, driver, kind, region, entity, start, end, strength, second, 0, False)


@pytest.mark.parametrize("name", ["planned_past", "contested_evidence", "regional_targets"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, small)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_plan_is_laid_out_before_any_data(spark, small):
    lines = past._lines(spark, small).cache()
    episodes, effects = history.plan(lines, 3)
    again, _ = history.plan(lines.repartition(7), 3)
    e, f = episodes.collect(), effects.collect()
    assert sorted(map(tuple, e)) == sorted(map(tuple, again.collect()))
    ends = lines.agg(F.min("order_date").alias("a"), F.max("order_date").alias("z")).first()
    assert len({r["episode_id"] for r in e}) == len(e) > 300
    assert all(ends["a"] + timedelta(days=history.WARMUP) <= r["ws"] <= r["we"] <= ends["z"] for r in e)
    planted = {r["episode_id"] for r in e if not r["null_episode"]}
    assert planted == {r["episode_id"] for r in f} and abs(len(planted) / len(e) - history.PLANTED) < 0.08
    told = [r for r in f if r["docs"]]
    assert abs(sum(r["contested"] for r in told) / len(told) - history.CONTESTED) < 0.06 and not any(r["contested"] for r in f if not r["docs"])
    kinds = {}
    for r in f:
        kinds.setdefault(r["episode_id"], {})[r["driver"]] = r["kind"]
    two = [k for k in kinds.values() if len(k) == 2]
    assert abs(len(two) / len(kinds) - history.SECOND) < 0.07 and all(k[0] != k[1] != "instrumentation" for k in two)
    assert {k for v in kinds.values() for k in v.values()} == set(history.KINDS)


def test_effects_that_overlap_multiply(spark):
    base = spark.createDataFrame([line(n) for n in range(400)] + [line(1000 + n, region="EUROPE") for n in range(50)], LINE)
    dear = [effect("price_change", "c", 0.1, 0.5), effect("price_change", "c", 0.2, 1.0, id_="f"), effect("price_change", "other", 0.9, 1.0, id_="g")]
    rows = history.compose(base, spark.createDataFrame(dear, EFFECT)).collect()
    # units: 10 times 0.8 times 0.55 (the floor), rounded; the price of a unit: 10 times 1.1 times 1.2
    assert {(r["units"], round(r["price"], 6), r["kept"]) for r in rows if r["region"] == "ASIA"} == {(4.0, 52.8, True)}
    assert {(r["units"], r["price"]) for r in rows if r["region"] == "EUROPE"} == {(10.0, 100.0)}
    both = [effect("external_market", "x", 0.5), effect("service_failure", "WH-1", 0.5, 0.4), effect("mix_shift", "R", 0.3), effect("instrumentation", "WH-1", 0.9, id_="h")]
    rows = history.compose(base, spark.createDataFrame(both, EFFECT)).collect()
    asia = [r for r in rows if r["region"] == "ASIA"]
    # half by the market, half by the failing warehouse, and of these nine in ten of the six in ten late ones not loaded
    assert abs(sum(r["kept"] for r in asia) / 400 - 0.25 * 0.46) < 0.05
    assert abs(sum(not r["on_time"] for r in asia) / 400 - 0.6) < 0.08 and abs(sum(r["tier"] == "R" for r in asia) / 400 - 0.3) < 0.08
    assert all(r["kept"] and r["tier"] == "N" for r in rows if r["region"] == "EUROPE")
    # a failing warehouse is late for all regions
    assert any(not r["on_time"] for r in rows if r["region"] == "EUROPE")


def test_nulls_ties_empty_tables_and_clashing_names(spark):
    odd = [line(1), line(1), (None,) * 13, line(2, region=None), line(3, day=D, units=None, price=None, on_time=None)]
    rows = spark.createDataFrame(odd, LINE).withColumn("kind", F.lit("own")).withColumn("strength", F.lit("own"))
    fx = spark.createDataFrame([effect(k, v, 0.5, 0.5) for k, v in (("external_market", "x"), ("price_change", "c"), ("mix_shift", "R"), ("service_failure", "WH-1"), ("instrumentation", "WH-1"))], EFFECT)
    got = history.compose(rows, fx).collect()
    assert len(got) == 5 and all(r["kind"] == r["strength"] == "own" for r in got)
    assert all(r["kept"] is not None for r in got)
    same = [tuple(r) for r in got if r["order_id"] == 1]
    assert same[0] == same[1]
    none = [tuple(r) for r in got if r["order_id"] is None]
    assert none == [(None,) * 13 + ("own", "own", True)]
    none = history.compose(rows, fx.limit(0)).drop("kind", "strength", "kept").collect()
    assert sorted(map(str, none)) == sorted(map(str, rows.drop("kind", "strength").collect()))
    for few in (rows.limit(0), rows):
        episodes, effects = history.plan(few)
        assert episodes.count() == effects.count() == 0
        assert history.compose(few, effects).count() == few.count()
        people = few.select("account_id", "region", "warehouse_id")
        assert history.texts(effects, people).count() == history.calendar(effects).count() == 0
    assert history.targets(rows.limit(0)).count() == 0
    # a driver without accounts of its region has no reports; routine texts need accounts as well
    lonely = spark.createDataFrame([effect("service_failure", "WH-9", 0.5)[:9] + (5, True)], EFFECT)
    assert history.texts(lonely, rows.select("account_id", "region", "warehouse_id"), span=(D, D)).where("theme <> 'routine'").count() == 0


def test_a_replay_recovers_what_was_planted(spark, tmp_path):
    h = history.history(spark, str(tmp_path), years=2, per_day=150)
    index = postings.build(h["interactions"], ("region", "warehouse_id"))
    rows = replay.replay_all(h["fact"], h["ships"], h["episodes"].drop("null_episode"), default_contract(), h["market"], index)
    truth = history.truth(h["effects"])
    told = h["effects"].select("episode_id", F.col("kind").alias("driver_type"), "contested")
    found = ranker.label(rows, truth).join(told, ["episode_id", "driver_type"], "left").collect()
    mean = lambda kind, label, c: (lambda v: sum(v) / len(v))([float(r[c]) for r in found if r["driver_type"] == kind and r["label"] == label and r[c] is not None])
    for kind in ("service_failure", "external_market"):
        assert mean(kind, 1, "did_t") < mean(kind, 0, "did_t") - 1
        assert mean(kind, 1, "on_theme") > mean(kind, 0, "on_theme") + 1
    assert mean("service_failure", 1, "precedence_consistent") > mean("service_failure", 0, "precedence_consistent") + 0.3
    # every planted promotion, and every failing warehouse but for a few, is a candidate of its episode
    planted = h["effects"].groupBy("kind").count().collect()
    planted = {r["kind"]: r["count"] for r in planted}
    hits = lambda kind: len({r["episode_id"] for r in found if r["driver_type"] == kind and r["label"]})
    assert hits("external_market") == planted["external_market"] and hits("service_failure") >= 0.8 * planted["service_failure"]
    # contested episodes, and hardly any others, hear of another cause
    right = [r for r in found if r["label"] and r["on_theme"]]
    share = lambda flag: (lambda v: sum(r["conflict_ratio"] > 0 for r in v) / len(v))([r for r in right if r["contested"] == flag])
    assert share(True) >= 0.7 and share(False) <= 0.35


def test_lines_are_dealt_out_by_order_and_part_only(spark, small):
    """Orders meet their customers below the join with the lines."""
    text = past._lines(spark, small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda key: next(x.index("Join") for x in text if "Join" in x and key in x)
    assert depth("c_custkey") > depth("l_orderkey") > depth("p_partkey")


def test_reports_find_accounts_without_a_task_a_place(spark, small):
    """Accounts are numbered in ranges, as row_number in each region and warehouse would."""
    text = past.contested_evidence(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in text
    accounts = spark.createDataFrame([(k, "ASIA" if k % 3 else "EUROPE", f"WH-{k % 2}") for k in range(40)], "account_id long, region string, warehouse_id string")
    effects = spark.createDataFrame([effect("service_failure", "WH-1", 0.5)[:9] + (30, False)], EFFECT)
    got = {r["doc_id"]: r["account_id"] for r in history.texts(effects, accounts.repartition(7), 5).collect()}
    pool = [k for k in range(40) if k % 3 and k % 2]
    drawn = spark.createDataFrame([(d,) for d in got], "doc_id string").select("doc_id", history.draw(5, "who", "doc_id").alias("x")).collect()
    assert len(got) == 30 and got == {r["doc_id"]: pool[int(r["x"] * len(pool))] for r in drawn}
