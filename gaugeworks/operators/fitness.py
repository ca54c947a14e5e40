"""Data-quality gate: freshness, completeness, consistency, validity, duplicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of an issue by severity.
WEIGHTS = {"critical": 1.0, "major": 0.45, "minor": 0.12}


def daily_profile(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))


def completeness(profile: DataFrame, we: date) -> DataFrame:
    """Median daily rows of the last week to that of the 28 rows before it, and the severity."""
    p = profile.where(F.col("d") <= F.lit(we)).withColumn("recent", F.col("d") >= F.date_sub(F.lit(we), 6))
    r = F.row_number().over(Window.partitionBy("recent").orderBy(F.desc("d")))
    kept = p.withColumn("r", r).where(F.col("recent") | (F.col("r") <= 28))
    out = kept.agg(F.median(F.when(F.col("recent"), F.col("n"))).alias("recent_median"), F.median(F.when(~F.col("recent"), F.col("n"))).alias("base_median"), F.count(F.lit(1)).alias("rows"))
    ratio = F.try_divide("recent_median", "base_median")
    return out.select("recent_median", "base_median", ratio.alias("ratio"), F.when(F.col("rows") < 10, None).when(ratio < 0.6, "critical").when(ratio < 0.85, "major").alias("severity"))


def partition_completeness(shipments: DataFrame, we: date, by: str = "warehouse_id") -> DataFrame:
    """Recent rows of each partition against the 28 days before, and its late share against then."""
    d = F.col("dispatch_date")
    recent, base = d.between(F.date_sub(F.lit(we), 6), F.lit(we)), d.between(F.date_sub(F.lit(we), 34), F.date_sub(F.lit(we), 7))
    late = ~F.col("on_time")
    out = shipments.where(recent | base).groupBy(by).agg(F.count_if(recent).alias("recent_n"), F.count_if(base).alias("base_n"), F.count_if(recent & late).alias("recent_late"), F.count_if(base & late).alias("base_late"))
    expected = F.col("base_n") * 7.0 / 28.0
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(by, "recent_n", "base_n", "recent_late", "base_late", expected.alias("expected_n"), ((expected > 5) & (F.col("recent_n") < 0.55 * expected)).alias("partial"), ((rate("base_late", "base_n") > 0.02) & (F.col("recent_n") > 20) & (rate("recent_late", "recent_n") < 0.3 * rate("base_late", "base_n"))).alias("class_missing"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children without a parent: an anti-join."""
    return child.join(parent.select(key), key, "left_anti")


def chronology_violations(shipments: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Shipments dated before their order."""
    return shipments.join(orders, key).where(F.col("dispatch_date") < F.col("order_date"))


def validity(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("units") <= 0).alias("bad_units"), F.count_if(F.col("net_revenue") < 0).alias("negative_revenue"), F.count_if((F.col("discount_amount") < 0) | (F.col("discount_amount") > F.col("gross_revenue"))).alias("bad_discount"))


def duplicate_keys(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Keys with more rows than distinct combinations of parts."""
    text = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(text).alias("distinct_n")).where("n > distinct_n")


def unknown_members(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the master lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(master.select(key), key, "left_anti")


def score(issues: DataFrame, checks: int) -> DataFrame:
    """issues: severity. One row: penalty, score and verdict (UNFIT, FIT_WITH_CAVEATS, FIT)."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("severity")]
    out = issues.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("penalty"), F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"))
    value = F.greatest(F.lit(0.0), 1 - F.col("penalty") / F.lit(max(1.0, checks * 0.55)))
    return out.select("penalty", "issues", "critical", value.alias("score"), F.when((F.col("critical") > 0) & (value < 0.55), "UNFIT").when(F.col("issues") > 0, "FIT_WITH_CAVEATS").otherwise("FIT").alias("verdict"))


def assess(fact: DataFrame, shipments: DataFrame, orders: DataFrame, accounts: DataFrame, we: date) -> DataFrame:
    """All checks as one frame of issues: dimension, source, severity, count."""
    row = lambda df, dim, source, severity, n: df.select(F.lit(dim).alias("dimension"), F.lit(source).alias("source"), severity.alias("severity"), n.cast("long").alias("n")).where("severity is not null")
    when = lambda c, s: F.when(c, F.lit(s))
    parts = [row(completeness(daily_profile(fact, "order_date"), we), "completeness", "orders", F.col("severity"), F.col("recent_median")), row(completeness(daily_profile(shipments, "dispatch_date"), we), "completeness", "dispatch", F.col("severity"), F.col("recent_median"))]
    w = partition_completeness(shipments, we)
    parts += [row(w, "partition", "dispatch", when(F.col("partial"), "critical"), F.col("recent_n")), row(w, "class", "dispatch", when(F.col("class_missing"), "critical"), F.col("recent_n"))]
    counted = [
        (orphans(shipments, orders, "order_id"), "consistency", "dispatch", "major"), (chronology_violations(shipments, orders), "consistency", "dispatch", "major"),
        (unknown_members(fact, accounts, "account_id"), "consistency", "orders", "major"), (duplicate_keys(fact, "order_id", ["account_id", "order_date", "line_no"]), "uniqueness", "orders", "minor"),
    ]
    parts += [row(df.agg(F.count(F.lit(1)).alias("k")), dim, source, when(F.col("k") > 0, severity), F.col("k")) for df, dim, source, severity in counted]
    bad = validity(fact).withColumn("k", F.col("bad_units") + F.col("negative_revenue") + F.col("bad_discount"))
    parts.append(row(bad, "validity", "orders", when(F.col("k") > 0, "major"), F.col("k")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
