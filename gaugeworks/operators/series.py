"""Metric series, and their expected band. All windows are by row position within a slice."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.contract import Metric


def daily_series(fact: DataFrame, metric: Metric, date_col: str = "order_date", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., d, v): one aggregate; filters on fact reach the scan."""
    return fact.groupBy(*by, F.col(date_col).alias("d")).agg(metric.value().alias("v"))


def measure_series(fact: DataFrame, column: str, date_col: str = "order_date", by: tuple[str, ...] = ()) -> DataFrame:
    return fact.groupBy(*by, F.col(date_col).alias("d")).agg(F.sum(column).alias("v"))


def reorder_rate(fact: DataFrame, recent: int = 28, enrolled: int = 84) -> DataFrame:
    """Weekly reorder frequency: orders of the last `recent` days over accounts with one in `enrolled` days.

    An order day counts towards the weeks that begin from it on, for `recent` or `enrolled` days: it is a step
    up at the first of them and a step down after the last, or where the account's next order day takes over.
    Steps are added up by week as soon as they arise, so no row is multiplied by the weeks it counts in, and
    the running totals go over a row a week. Rows without a date take no part.
    """
    days = fact.where("order_date IS NOT NULL").groupBy("account_id", F.col("order_date").alias("d")).agg(F.countDistinct("order_id").alias("n"))
    monday = lambda ahead: F.to_date(F.trunc(F.date_add("d", ahead + 6), "week"))
    days = days.withColumn("next", F.lead(monday(0)).over(Window.partitionBy("account_id").orderBy("d")))
    step = lambda week, n, accounts, own: F.struct(week.alias("w"), n.cast("long").alias("n"), F.lit(accounts).alias("accounts"), F.lit(own).alias("own"))
    steps = F.array(step(F.to_date(F.trunc("d", "week")), F.lit(0), 0, True), step(monday(0), F.col("n"), 1, False), step(monday(min(recent, enrolled)), -F.col("n"), 0, False), step(F.least(monday(enrolled), "next"), F.lit(0), -1, False))
    weeks = days.select(F.explode(steps).alias("s")).groupBy("s.w").agg(F.sum("s.n").alias("n"), F.sum("s.accounts").alias("accounts"), F.max("s.own").alias("own"))
    so_far = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    totals = weeks.select("w", "own", F.sum("n").over(so_far).alias("orders"), F.sum("accounts").over(so_far).alias("enrolled"))
    return totals.where("own").select(F.col("w").alias("d"), F.try_divide("orders", "enrolled").alias("v"), "orders", "enrolled")


def _frame(by: tuple[str, ...], lo: int, hi: int):
    return Window.partitionBy(*by).orderBy("d").rowsBetween(lo, hi)


def rolling_median(v: str, by: tuple[str, ...], lo: int, hi: int, least: int) -> Column:
    w = _frame(by, lo, hi)
    return F.when(F.count(v).over(w) >= least, F.percentile(v, F.lit(0.5)).over(w))


def rolling_mean(v: str, by: tuple[str, ...], lo: int, hi: int, least: int = 1) -> Column:
    w = _frame(by, lo, hi)
    return F.when(F.count(v).over(w) >= least, F.avg(v).over(w))


def weekday_index(series: DataFrame, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """(by.., wd 0 = Monday, idx): median ratio to the centred median by weekday (1 under `least`
    observations), so scaled that the seven have mean 1."""
    ratio = series.withColumn("c", rolling_median("v", by, -3, 3, 4)).where("c is not null and c <> 0 and v is not null").withColumn("r", F.col("v") / F.col("c"))
    seen = ratio.groupBy(*by, F.weekday("d").alias("wd")).agg(F.when(F.count(F.lit(1)) >= least, F.median("r")).alias("m"))
    # the seven of a slice in one row: weekdays that were never seen count as 1, with no spine to join
    packed = seen.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("wd", "m"))).alias("ms"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.coalesce(F.try_element_at("ms", k), F.lit(1.0)))
    packed = packed.select(*by, raw.alias("raw")).withColumn("mean", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / 7)
    index = F.transform("raw", lambda x: F.when(F.col("mean") != 0, x / F.col("mean")).otherwise(F.lit(1.0)))
    return packed.select(*by, F.posexplode(index).alias("wd", "idx"))


def expected_band(series: DataFrame, by: tuple[str, ...] = (), trail: int = 28, least: int = 7) -> DataFrame:
    """series with wd, idx, e (expected: trailing median of deseasonalised values before the row, times
    the index) and resid."""
    index = weekday_index(series, by)
    rows = series.withColumn("wd", F.weekday("d")).join(index, [*by, "wd"], "left").withColumn("idx", F.coalesce("idx", F.lit(1.0))).withColumn("flat", F.col("v") / F.when(F.col("idx") != 0, F.col("idx")))
    rows = rows.withColumn("level", rolling_median("flat", by, -trail, -1, least))
    return rows.withColumn("e", F.col("level") * F.col("idx")).withColumn("resid", F.col("v") - F.col("e")).drop("flat", "level")


def tail(df: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The last n rows of each slice by day."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("d")))
    return df.withColumn("_r", last).where(F.col("_r") <= n).drop("_r")


def until(df: DataFrame, as_of: date, column: str = "d") -> DataFrame:
    return df.where(F.col(column) <= F.lit(as_of))
