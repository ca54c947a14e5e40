"""Findings of round 3: what failed before."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import causal
from gaugeworks.plans import catalogue, checks
from gaugeworks.sources import store


def test_correlation_is_null_where_a_side_does_not_vary(spark):
    rows = [("flat", 1.0, float(k)) for k in range(4)] + [("one", 1.0, 2.0)] + [("up", float(k), 2.0 * k + k % 2) for k in range(9)] + [("up", None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(causal.correlation("x", "y").alias("c")).collect()}
    assert got["flat"] is None and got["one"] is None
    assert got["up"] == pytest.approx(df.where("g = 'up'").agg(F.corr("x", "y")).first()[0])


def test_sliding_totals_equal_sql_just_before_a_week(spark, tmp_path):
    last = datetime(2024, 1, 3, 23, 59, 59, 700000)  # the weeks of the windows begin on Thursdays
    rows = [(k, t, 1, "view", 1.0, "{}") for k, t in enumerate((last, datetime(2024, 1, 4), datetime(2024, 1, 20, 5)))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in checks.stream_sliding_totals(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["stream_sliding_totals"]).fetchall())


@pytest.mark.parametrize("name", ["materiality_gates", "orders_slice", "kpi_daily_ratio", "level_availability", "suppression_reasons", "worklist", "replayed_episodes"])
def test_queries_do_not_store_the_whole_fact(spark, small, name):
    from gaugeworks.plans import further  # noqa: F401  it registers queries

    with store.scope(spark) as made:
        catalogue.QUERIES[name](spark, f"{small}/.")
    assert not [x for x in made if "/fact-" in x]


def test_variants_broadcast_no_table_of_the_vocabulary(spark):
    from gaugeworks.llm import variants
    from gaugeworks.llm.shared import Scratch

    words = spark.createDataFrame([(0, "shared", 9), (1, "shaped", 3), (2, "share", 4), (3, "sharing", 5)], "id long, word string, n long")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    # only the heavy children of short prefixes, which the alphabet bounds
    assert plan(variants.light_places(words)).count("BroadcastHashJoin") == 1
    with Scratch(spark) as scratch:
        pairs = variants.near_pairs(words, scratch)
        assert "BroadcastHashJoin" not in plan(pairs)
        assert {tuple(sorted(r)) for r in pairs.collect()} == {("shaped", "shared"), ("share", "shared")}


def test_postings_part_each_text_once(spark):
    from gaugeworks.operators import postings

    rows = [(1, "2000-03-01", "token version token", "a"), (2, "2000-03-02", "", "b"), (3, "2000-03-02", None, "b"), (4, None, "token", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, day string, text string, lang string").withColumn("day", F.to_date("day"))
    with store.scope(spark) as made:
        index = postings.build(docs, ("lang",))
        assert sum("-counted-" in x for x in made) == 1
        assert sorted((r["term"], r["doc_id"], r["tf"], r["dl"]) for r in index.postings.collect()) == [("token", 1, 2, 3), ("version", 1, 1, 3)]
        assert sorted((r["doc_id"], r["dl"]) for r in index.documents.collect()) == [(1, 3), (2, 0), (3, 0)]
