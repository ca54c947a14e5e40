"""As-of join, sketches, silence, late rows, stored tables; queries of plans.further against their SQL."""

import inspect
import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.asof import asof_join
from gaugeworks.plans import catalogue, evidence, further  # noqa: F401  evidence adds to the catalogue
from gaugeworks.sources import store
from gaugeworks.streaming import ledger

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in inspect.getmembers(further, inspect.isfunction) if f.__module__ == further.__name__ and n in catalogue.ORACLE_SQL]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, small)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert got and got == sorted(cur.fetchall(), key=key)


def test_queries_without_sql(spark, small):
    rows = further.replayed_episodes(spark, small)
    assert {"candidate_id", "heuristic", "window_start"} <= set(rows.columns) and rows.where("window_start IS NULL").count() == 0
    trees = further.spread_trees(spark, small)
    assert trees.where("left <> node").count() > 0 and trees.select("node").distinct().count() == trees.count()


def test_last_shipments_are_sorted_once_and_never_broadcast(spark, small):
    """No aggregate, which would sort or hash all rows once more, and no copy of the orders in every task's memory."""
    plan = further.last_shipment_before_order(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "BroadcastHashJoin [l_orderkey" not in plan and "SortMergeJoin [l_orderkey" in plan


def test_asof_join_of_types_and_names_of_both_sides(spark):
    """The match has right's columns in their order and types; names may be those that the join uses itself."""
    left = spark.createDataFrame([(1, datetime(2000, 1, 5), "x"), (1, datetime(2000, 3, 5), "y"), (2, datetime(2000, 1, 5), "z")], "key int, t timestamp, own string")
    right = spark.createDataFrame([(1, datetime(2000, 1, 5), "b", 7), (1, datetime(2000, 1, 5), "c", 3)], "key int, t timestamp, last string, row int").select("row", "last", F.col("key").cast("long").alias("key"), "t")
    got = asof_join(left, right.withColumn("key", F.col("key").cast("int")), ["key"], "t", "t", ["row"])
    assert got.columns == ["key", "t", "own", "match"] and got.schema["match"].dataType.names == ["row", "last", "key", "t"]
    assert sorted((r["own"], r["match"] and (r["match"]["row"], r["match"]["last"])) for r in got.collect()) == [("x", (7, "b")), ("y", (7, "b")), ("z", None)]


def test_asof_join_equals_plain_version(spark):
    rng = random.Random(6)
    t = lambda: datetime(2000, 1, 1) + timedelta(hours=rng.randrange(24 * 60))
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(rng.choice(keys), t() if k % 17 else None, k) for k in range(400)]
    right = [(rng.choice(keys), t() if k % 13 else None, k) for k in range(300)] + [("hot", datetime(2000, 1, 10), 1000), ("hot", datetime(2000, 1, 10), 1001)]
    left.append(("hot", datetime(2000, 1, 10), 999))
    left += left[:3]
    schema = "key string, t timestamp, bucket long"
    got = asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"], "t", "t", ["bucket"], bucket_days=4).collect()
    want = []
    for k, at, n in left:
        seen = [(u, m) for j, u, m in right if k is not None and at is not None and j == k and u is not None and u <= at]
        want.append((k, at, n, max(seen)[1] if seen else None))
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r["key"], r["t"], r["bucket"], r["match"] and r["match"]["bucket"]) for r in got), key=order) == sorted(want, key=order)
    none = spark.createDataFrame([], schema)
    assert asof_join(none, spark.createDataFrame(right, schema), ["key"], "t", "t").count() == 0
    assert asof_join(spark.createDataFrame(left, schema), none, ["key"], "t", "t").where("match IS NULL").count() == len(left)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = lambda lo, hi, day: spark.createDataFrame([(k, datetime(2000, 1, day, 1) + timedelta(seconds=k), "x", 1.0) for k in range(lo, hi)], "event_id long, ts timestamp, event_type string, value double")
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    assert book.totals().count() == 0
    book.add(rows(0, 10, 9), 0)
    book.add(rows(5, 12, 9).unionByName(rows(20, 23, 2)).unionByName(rows(20, 23, 2)), 1)
    want = {(date(2000, 1, 9), 12, 12.0, 0), (date(2000, 1, 2), 3, 3.0, 3)}
    told = lambda: {(r["d"], r["n"], r["v"], r["n_late"]) for r in book.totals().collect()}
    assert told() == want
    book.add(rows(5, 12, 9).unionByName(rows(20, 23, 2)), 1)
    assert told() == want and {r["event_id"] for r in book.late_rows().collect()} == {20, 21, 22}


def _tables(spark):
    target, fs = store._path(spark, f"{store.shared_folder(spark)}/gaugeworks")
    return {x.getPath().getName() for x in fs.listStatus(target)} if fs.exists(target) else set()


def test_no_table_is_left_after_a_result_is_written(spark, small, tmp_path):
    catalogue._fact(spark, small)
    before = _tables(spark)
    for name in ("estate_sweep", "postings_scores", "spearman_rho", "csv_round_trip", "stream_ledger", "backtest_windows"):
        with store.scope(spark) as made:
            catalogue.QUERIES[name](spark, small).write.parquet(f"{tmp_path}/{name}")
        assert made and _tables(spark) == before, name


def test_a_changed_folder_is_read_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    put = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    read = lambda: store.kept(spark, folder, "copy", lambda: spark.read.parquet(f"{folder}/t.parquet"), "id").count()
    put(3)
    assert read() == 3 and read() == 3
    put(5)
    assert read() == 5


@pytest.mark.parametrize(("recent", "enrolled"), [(28, 84), (10, 25), (7, 7), (40, 30)])
def test_reorder_rate_by_steps_equals_brute_force(spark, recent, enrolled):
    from datetime import date, timedelta

    from gaugeworks.operators.series import reorder_rate

    first = date(2000, 1, 5)
    rows = [(a, first + timedelta(days=(a * 37 + k * k * (3 + a)) % 300), a * 100 + k) for a in range(1, 7) for k in range(9)]
    # repeated rows, an account that is null, a long gap, a row without a date
    rows += [rows[0], rows[0], (None, first + timedelta(days=50), 1), (None, first + timedelta(days=52), 2), (9, first, 901), (9, first + timedelta(days=290), 902), (9, None, 903)]
    got = {r["d"]: (r["orders"], r["enrolled"]) for r in reorder_rate(spark.createDataFrame(rows, "account_id long, order_date date, order_id long"), recent, enrolled).collect()}
    dated = {r for r in rows if r[1]}
    want = {}
    for w in {d - timedelta(days=d.weekday()) for _, d, _ in dated}:
        seen = [r for r in dated if r[1] <= w < r[1] + timedelta(days=enrolled)]
        want[w] = (sum(w < d + timedelta(days=recent) for _, d, _ in seen), len({a for a, _, _ in seen}))
    assert got == want


def test_rules_of_authority_and_ledger(spark):
    """The rules themselves: a model's status by its outside share, a run's mix of methods and its cost."""
    from gaugeworks.operators import drift
    from gaugeworks.telemetry import Telemetry, cost, method_mix

    shares = [None, 0.1, 0.15, 0.2, 0.35, 0.5]
    rows = spark.createDataFrame([(x,) for x in shares], "x double").select(drift.authority(F.col("x"))).collect()
    assert [r[0] for r in rows] == [drift.model_status(x)["status"] for x in shares] == ["NO_MODEL", "STABLE", "STABLE", "SHIFTING", "SHIFTING", "DRIFTED"]
    assert [drift.model_status(x)["withdrawn"] for x in shares] == [True, False, False, False, False, True]
    tel = Telemetry()
    steps = [("SQL", 1000, None), ("SQL", None, 100), ("LLM", 200, 300)]
    for kind, *_ in steps:
        tel.method("x", kind, "y")
    ledger = spark.createDataFrame([("run", *x) for x in steps] + [("run", "GUESS", 9, 9), ("run", None, 9, 9), ("other", "ML", None, None)], "run string, method string, tokens_in long, tokens_out long")
    got = {r["run"]: r for r in method_mix(ledger, ("run",), 3.0, 15.0).collect()}
    assert got["run"]["steps"] == tel.summary()["steps"] == 3 and got["run"]["sql"] == 2
    assert got["run"]["non_llm_pct"] == pytest.approx(tel.summary()["non_llm_pct"]) == pytest.approx(200 / 3)
    assert got["run"]["cost"] == pytest.approx(cost(1200, 400, 3.0, 15.0)) and got["other"]["cost"] == 0 and got["other"]["non_llm_pct"] == 100
    assert method_mix(ledger.limit(0), ("run",), 3.0, 15.0).count() == 0


def test_outside_shares_with_nulls_and_without_reference(spark):
    from gaugeworks.operators import drift

    rows = spark.createDataFrame([("a", float(x), 1.0) for x in (5, 50, 500, -1)] + [("b", None, 1.0), (None, 50.0, 1.0)], "g string, x double, y double")
    reference = spark.createDataFrame([(float(x), 1.0) for x in range(101)], "x double, y double")
    got = {r["g"]: (r["n"], r["outside_share"], r["status"], r["withdrawn"]) for r in drift.outside_shares(rows, reference, ("g",), ("x", "y")).collect()}
    assert got == {"a": (4, 0.5, "DRIFTED", True), "b": (1, 1.0, "DRIFTED", True), None: (1, 0.0, "STABLE", False)}
    assert {r["outside_share"] for r in drift.outside_shares(rows, reference.limit(0), ("g",), ("x", "y")).collect()} == {1.0}
    assert drift.outside_shares(rows.limit(0), reference, ("g",), ("x", "y")).count() == 0
