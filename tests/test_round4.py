"""Findings of round 4: what failed before."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.plans import catalogue, checks, evidence


@pytest.fixture
def few_rows_a_frame(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    yield
    spark.conf.set(key, before)


def _sql(name: str, **views: str) -> list[tuple]:
    """The query's SQL over these files, and over sf0.001 for the other tables."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for t, path in views.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall())


def test_stream_priors_fold_in_order_across_frames(spark, tmp_path, few_rows_a_frame):
    rng = random.Random(4)
    rows = [(k, rng.choice((0, 1, 1, 1, 1)), rng.choice((0, 0, 0, 1))) for k in range(1200)]
    rng.shuffle(rows)
    path = f"{tmp_path}/labels.parquet"
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in checks.stream_priors(spark, str(tmp_path)).collect())
    assert got == _sql("stream_priors", labels=path) and len({r[2] for r in got}) > 3


def test_postings_evidence_goes_past_withheld_texts(spark, tmp_path):
    """However many of the best a reader may not see, the best dozen of the others are found."""
    rows = [(k, "token license version apache the " * 3 + "filler " * (k % 5), "en", "web") for k in range(60)]
    rows += [(100 + k, "token " + "filler " * (20 + k), "en", "src1") for k in range(20)]
    rows += [(200 + k, "filler words", "en", "src1") for k in range(300)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(path)
    got = sorted(tuple(r) for r in evidence.postings_evidence(spark, str(tmp_path)).collect())
    assert got == _sql("postings_evidence", documents=path)
    assert [r[3] for r in got if r[0] == "*"] == list(range(1, 13))
    # its SQL looks through the best 36 only, all withheld here
    agreed = {r["ask"]: r for r in evidence.postings_corroboration(spark, str(tmp_path)).collect()}
    assert agreed["*"]["on_theme"] == agreed["*"]["conflicting"] == 0
    assert sorted(tuple(r) for r in agreed.values()) == _sql("postings_corroboration", documents=path)


def test_best_visible_counts_all_withheld_or_those_of_a_pool(spark):
    from gaugeworks.operators import postings

    scored = spark.createDataFrame([("q", k, 100.0 - k) for k in range(50)], "ask string, doc_id long, score double")
    documents = spark.createDataFrame([(k, [], *[None] * 4, "web" if k < 40 else "crm" if k % 2 else None) for k in range(50)], "doc_id long, dims array<string>, theme string, author_role string, type string, account_id string, domain string")
    visible = F.col("domain") != "web"
    found, withheld = postings.best_visible(scored, documents, visible, 4)
    assert [(r["doc_id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(41, 1), (43, 2), (45, 3), (47, 4)]
    assert {r["domain"]: r["n"] for r in withheld.collect()} == {"web": 40, None: 5}
    found, withheld = postings.best_visible(scored, documents, visible, 4, pool=42)
    assert [r["doc_id"] for r in found.collect()] == [41] and {r["domain"]: r["n"] for r in withheld.collect()} == {"web": 40, None: 1}


def test_postings_of_terms_that_nobody_asks_for_stay_where_they_lie(spark):
    from gaugeworks.operators import postings

    docs = [(k, "2000-03-01", f"token word{k} word{k + 1}") for k in range(50)] + [(50, "2000-03-01", "version")]
    index = postings.build(spark.createDataFrame(docs, "doc_id long, day string, text string"), ())
    asks = spark.createDataFrame([("a", ["token", None]), ("b", ["version", "version"]), ("c", []), ("d", None)], "ask string, terms array<string>").selectExpr("ask", "date'2000-02-01' AS lo", "date'2000-04-01' AS hi", "terms", "CAST(NULL AS array<array<string>>) AS scope")
    found = postings.retrieve(index, asks)
    assert "LeftSemi, BuildRight" in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r["ask"], r["doc_id"]) for r in found.collect()} == {("a", k) for k in range(50)} | {("b", 50)}
