"""Sharding: proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialise, table

SHARDS = 8
SEED = "gaugeworks-7"
#: Hash ranges per source and ranges of the fractional rank: no window sees more than one of them. There
#: are at least 16 ** DIGITS, and 16 times more while they would hold over PER_RANGE rows.
DIGITS, PER_RANGE = 3, 50_000


def _offsets(counts: DataFrame, part: list[str], order: str) -> DataFrame:
    """Rows that come before each range, and all rows of its part; counts has a row a range of a part at most."""
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("before", F.sum("n").over(before) - F.col("n")).withColumn("total", F.sum("n").over(whole)).drop("n")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Deal all documents into shards that all have the mixture of the whole table.

    Within each source rows are ranked by a seeded hash (a shuffle), the fractional rank
    (rank - 1/2) / rows of the source puts all sources on one line, and that line is cut into
    shards whose row counts differ by one at most (law `rows`).

    A rank is never taken over a whole source: rows are counted by range of their hash, the ranges
    before give an offset, and a window ranks within one range. A hot source is thus spread over
    all its ranges, which grow in number with the table. Result, one row per input row: doc_id, source, size (UTF-8 bytes and 1; null text:
    1), text_crc32 (null: that of no bytes), law, shard, slot (gapless from 0), grown_shard (null).
    Null sources form one source of their own; repeated rows tie and are dealt as any rows; extra
    columns are ignored; an empty table gives no rows.
    """
    digits, n = DIGITS, docs.count()
    while 16**digits * PER_RANGE < n:
        digits += 1
    ranges = 16**digits
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    stratum = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    rows = rows.withColumn("stratum", stratum).withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "stratum", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")))
    rows = rows.withColumn("range", F.conv(F.substring("h", 1, digits), 16, 10).cast("int"))
    within = _offsets(rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n")), ["stratum"], "range")
    tie: list[str | Column] = ["h", "doc_id", "size", "text_crc32"]
    ranked = rows.join(within, ["stratum", "range"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*tie)))
    ranked = ranked.withColumn("at", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("total")).cast("double"))
    line, _ = materialise(ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "h", "at", F.floor(F.col("at") * ranges).cast("int").alias("range")), "shard-line")
    cuts = _offsets(line.groupBy("range").agg(F.count(F.lit(1)).alias("n")), [], "range")
    place = line.join(cuts, "range").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("at", "stratum", *tie)) - 1)
    exact = F.expr(f"cast((place * {shards}) div total as int)")
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return place.withColumn("shard", exact).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
