import pytest
from pyspark.sql import functions as F


def test_stages_take_effect(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    out = p.STAGES[-1][1](spark, docs, small)
    assert out.count() == n and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_rows_without_a_doc_id_of_their_own(spark, tmp_path):
    """Null and repeated doc_ids: only the copies, repeated lines and leaks among them go."""
    import corpus_pipeline as p

    text = lambda k: " ".join(f"{a}{k}{b}" for a in ("ba", "ko", "mi", "tu") for b in ("lan", "dor", "vex", "pim", "gul"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], schema)
    got = lambda df: sorted((r["text"] for r in df.collect()))
    docs = make([(3, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (5, text(1)), (5, text(4))])
    assert got(p.one_of_each_group(spark, docs, "")) == sorted(map(text, (1, 2, 3, 4)))
    spark.createDataFrame([(1, text(2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = p.drop_benchmark(spark, make([(None, text(2)), (None, text(3)), (5, text(2)), (5, text(4)), (6, text(5))]), str(tmp_path))
    assert got(left) == sorted(map(text, (3, 4, 5)))
    lines = make([(1, text(1)), (None, text(6) + "\n" + text(1)), (None, text(7) + "\n" + text(8)), (None, text(9) + "\n" + text(8))])
    cleaned = got(p.drop_repeated_lines(spark, lines, ""))
    assert sorted(x for t in cleaned for x in t.split("\n")) == sorted(map(text, (1, 6, 7, 8, 9)))


CLASHES = ("row", "text_", "gone", "kept", "key", "given", "h", "id", "_own", "_gone", "_key", "_text", "words", "template", "first", "last", "stats", "score", "doc", "line", "component_id")


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_tables(spark, small, k):
    """No rows; nulls in every column; repeated rows; a long text; columns whose names the stages use themselves."""
    import corpus_pipeline as p

    name, stage = p.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    out = stage(spark, empty, small)
    assert out.columns == empty.columns and out.count() == 0
    long_ = " ".join(f"word{k}" for k in range(60_000))
    text = "This is a plain line of words that reads like any other text in the table and goes on"
    rows = [(None, None, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, long_ + "\n" + long_[::-1], "en", "s", 3), (None, "another line of other words without an id of its own that is kept", "en", "s", 1)]
    odd = spark.createDataFrame(rows, schema)
    for c in CLASHES:
        odd = odd.withColumn(c, F.lit("clash"))
    out = stage(spark, odd, small)
    assert out.columns == odd.columns
    got = out.collect()
    assert all(r[c] == "clash" for r in got for c in CLASHES)
    texts = [r["text"] for r in got]
    if name in ("line_dedup", "decontamination"):
        assert len(got) == len(rows)
    if name == "near_dedup":
        assert len(got) == len(rows) - 1 and texts.count(text) == 1
    if name != "quality":
        assert rows[5][1] in texts and rows[6][1] in texts


def test_run_equals_its_stages_and_leaves_one_table_of_a_stage(spark, small):
    import os

    import corpus_pipeline as p
    from gaugeworks.llm.shared import scratch_root

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, small)
    root = scratch_root(spark).removeprefix("file://") + "/gaugeworks"
    before = set(os.listdir(root))
    got = p.run(spark, small)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"stage-decontamination", "bpe-digests"}
