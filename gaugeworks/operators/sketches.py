"""Mergeable sketches by day and slice, stored beside the fact: distinct accounts and percentiles of any
window without another read of the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.store import stored

#: Logarithm of the registers of a distinct count (relative error about 1.04 / sqrt(2 ** REGISTERS)), and the
#: size of a quantile sketch (rank error about 2 / SIZE).
REGISTERS, SIZE = 12, 400


def daily(fact: DataFrame, dimension: str, measure: str = "net_revenue", who: str = "account_id", day: str = "order_date") -> DataFrame:
    """slice, d, n, accounts (a distinct-count sketch), values (a quantile sketch) of every day and value of a
    dimension, stored in ranges of days: one read of the fact, a row a day and slice."""
    rows = fact.groupBy(F.col(dimension).alias("slice"), F.col(day).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(who).cast("string"), F.lit(REGISTERS)).alias("accounts"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(SIZE)).alias("values"))
    return stored(rows.repartitionByRange("d").sortWithinPartitions("d"), "sketches")


def of_windows(sketches: DataFrame, windows: DataFrame, percentiles: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """window, slice, n, accounts and q_<percent> of every window (window, ws, we) by union of its days' sketches.

    Windows are sent to their days: an equality join of rows a day. A window without days gives no rows."""
    days = windows.where("ws <= we").select("window", F.explode(F.sequence("ws", "we")).alias("d"))
    both = sketches.join(days, "d").groupBy("window", "slice").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("accounts"), F.kll_merge_agg_double("values").alias("values"))
    return both.select("window", "slice", "n", "accounts", *[F.kll_sketch_get_quantile_double("values", F.lit(float(p))).alias(f"q_{round(100 * p)}") for p in percentiles])
