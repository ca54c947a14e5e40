"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.cohorts import BUCKET_DAYS


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, tie: list[str] | None = None, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """left's columns and `match`: the struct of right's columns of the last row with equal keys and a time not
    after left's (null where there is none). Of equal times the greatest by tie, then by all columns.

    No range join: both tables go to ranges of (keys, days), the last value inside a range comes from one
    window over their union, and what a range inherits from those before it from a row a range. So a key
    that holds a third of all rows is as many groups as it has ranges. Rows whose key or time is null match
    nothing; left's rows are all kept, repeated ones too."""
    keys = [F.col(f"`{k}`") for k in on]
    bucket = lambda t: F.floor(F.unix_date(F.to_date(t)) / bucket_days).cast("long")
    whole = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    named = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    by_tie = [*(tie or []), *[c for c in right.columns if c not in (tie or [])]]
    rows = left.select(named.alias("key"), F.col(f"`{left_time}`").cast("timestamp").alias("t"), whole(left.columns).alias("row"))
    seen = right.select(named.alias("key"), F.col(f"`{right_time}`").cast("timestamp").alias("t"), whole(by_tie).alias("order"))
    full = F.forall(F.array(*[F.col(f"key.k{i}").isNull() for i in range(len(on))]), lambda x: ~x) & F.col("t").isNotNull()
    rows = rows.withColumn("full", full)
    given = seen.where(full).withColumn("bucket", bucket(F.col("t")))
    asked = rows.where("full").withColumn("bucket", bucket(F.col("t")))
    both = given.select("key", "bucket", "t", F.lit(0).cast("byte").alias("side"), "order", F.lit(None).cast(rows.schema["row"].dataType).alias("row")).unionByName(
        asked.select("key", "bucket", "t", F.lit(1).cast("byte").alias("side"), F.lit(None).cast(given.schema["order"].dataType).alias("order"), "row"))
    inside = Window.partitionBy("key", "bucket").orderBy("t", "side", "order")
    told = both.withColumn("own", F.last("order", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("end", F.lead(F.lit(True)).over(inside).isNull())
    # the last row of a range has what the ranges after it inherit
    ends = told.where("end").select(F.col("key").alias("key"), F.col("bucket").alias("bucket"), F.col("own").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "bucket", F.last("last", ignorenulls=True).over(before).alias("inherited"))
    found = told.where("side = 1").join(ends, ["key", "bucket"]).withColumn("last", F.coalesce("own", "inherited"))
    match = F.when(F.col("last").isNotNull(), F.struct(*[F.col("last").getField(c).alias(c) for c in right.columns]))
    none = rows.where("NOT full").select("row", F.lit(None).cast(right.schema).alias("match"))
    return found.select("row", match.alias("match")).unionByName(none).select("row.*", "match")
