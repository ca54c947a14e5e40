"""Corpus preparation: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and works on all that the stage before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, linededup, neardup, quality
from gaugeworks.llm.shared import Scratch, drop_scratch, materialise, scope, table, unpacked, whole_row

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Keys of texts whose doc_id is not theirs alone lie from here on, behind all documents with one.
_OWN = 1 << 62


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are scored as such; repeated
    rows are judged alike; columns of any name pass through."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def own_keys(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, doc_id, a key of each distinct doc_id and text, and text. The key is the
    doc_id where it is given and for one of the texts under it (the one of least hash), else the hash of
    both. Equal rows share it."""
    spark = docs.sparkSession
    given, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(whole_row(docs), given.alias("given"), text.alias("text"), F.xxhash64(given, text).alias("h"))
    with Scratch(spark) as scratch:
        ids = docs.select(given.alias("id"), F.xxhash64(given, text).alias("h")).where("id IS NOT NULL")
        shared = scratch.keep(ids.groupBy("id").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last").select("id", "first"), "shared-ids")
    odd = F.col("given").isNull() | (F.col("given") >= _OWN)
    if shared.limit(1).count():
        rows = rows.join(shared, F.col("given") == F.col("id"), "left")
        odd = odd | F.coalesce(F.col("h") != F.col("first"), F.lit(False))
    hashed = F.lit(_OWN) + F.col("h").bitwiseAND(F.lit(_OWN - 1))
    return rows.select("row", F.when(odd, hashed).otherwise(F.col("given")).alias("doc_id"), "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those that keep no words go. Rows of equal
    doc_id and text are one document; null and empty texts stay; columns of any name pass through."""
    left = linededup.dedup_lines(own_keys(docs))
    return left.select(*unpacked(docs, text=F.col("text")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least key (see own_keys). Texts that
    share a doc_id, or have none, are documents of their own; of rows with equal doc_id and text one stays.
    Null and empty texts belong to no group; columns of any name pass through."""
    rows = own_keys(docs)
    groups = neardup.near_duplicates(rows, SHINGLE).select("doc_id", "kept")
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").count().where("count > 1").limit(1).count()
    left = rows.join(gone, "doc_id", "left_anti")
    return (left.dropDuplicates(["doc_id"]) if repeated else left).select(*unpacked(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; columns of any name pass through."""
    return decontaminate.drop_contaminated(own_keys(docs), table(spark, sf_dir, "benchmark")).select(*unpacked(docs))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row per document; null and
    empty texts have no tokens; further columns end here."""
    return bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("tokens", to_tokens),
]

#: SQL cannot express the trained, hashed and tokenised stages; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's table is written once; it and all that the stages needed
    inside go as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as inner:
            docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            inner.remove(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
