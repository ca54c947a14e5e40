"""Movement detection against the band, for any number of slices and windows in one plan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.contract import Metric
from gaugeworks.functions.fiscal import months_in_window
from gaugeworks.operators.series import expected_band

#: Least history in rows, how much wider a sparse band is, and its floor as a share of the level.
MIN_HISTORY, SPARSE_WIDTH, SPARSE_CV = 42, 1.9, 0.22
#: Fixed value: consistency factor of the median absolute deviation.
MAD = 1.4826


def robust_sigma(resid: Column, before: Column, by: tuple[str, ...]) -> Column:
    """1.4826 times the median absolute deviation of the residuals before the window."""
    w = Window.partitionBy(*by)
    r = F.when(before, resid)
    centre = F.percentile(r, F.lit(0.5)).over(w)
    return F.percentile(F.abs(r - centre), F.lit(0.5)).over(w) * MAD


def detect_many(series: DataFrame, ws: date, we: date, metric: Metric, by: tuple[str, ...] = (), plan: DataFrame | None = None) -> DataFrame:
    """One row per slice: actual, expected, delta, pct_change, z, sigma, persistence, gates and verdict.

    plan: by.. and plan (the slice's plan for the window). Gates: the rupee floor (metrics in INR only),
    share of plan (passes without a plan), days outside warn sigma, and |z|; material needs all.
    A slice with under MIN_HISTORY days before the window is INSUFFICIENT_HISTORY.
    """
    key = list(by) or ["_all"]
    if not by:
        series = series.withColumn("_all", F.lit(1))
    by = tuple(key)
    band = expected_band(series.where(F.col("d") <= F.lit(we)), by)
    before, inside = F.col("d") < F.lit(ws), F.col("d").between(F.lit(ws), F.lit(we))
    # the median and the deviation from it need two passes over a slice's days: two windows of one partitioning
    whole = Window.partitionBy(*by)
    rows = band.withColumn("_c", F.percentile(F.when(before, F.col("resid")), F.lit(0.5)).over(whole))
    rows = rows.withColumn("_dev", F.when(before, F.abs(F.col("resid") - F.col("_c"))))
    rows = rows.withColumn("_rank", F.when(before, F.row_number().over(Window.partitionBy(*by, before).orderBy(F.desc("d")))))
    stats = rows.groupBy(*by).agg(
        (F.percentile("_dev", F.lit(0.5)) * MAD).alias("mad"), F.stddev_samp(F.when(before, F.col("resid"))).alias("sd"), F.count(F.when(before, F.col("resid"))).alias("n_resid"),
        F.count(F.when(before, F.col("v"))).alias("history_days"), F.avg(F.when(F.col("_rank") <= 28, F.col("v"))).alias("level"), *window_sums(inside),
    )
    sparse = F.col("history_days") < MIN_HISTORY
    sigma = F.when(F.coalesce("mad", F.lit(0.0)) > 0, F.col("mad")).otherwise(F.when((F.col("n_resid") > 2) & (F.col("sd") > 0), F.col("sd")).otherwise(F.lit(1.0)))
    sigma = sigma * F.when(sparse, SPARSE_WIDTH).otherwise(1.0)
    floor = SPARSE_CV * F.abs(F.coalesce("level", F.lit(0.0)))
    stats = stats.withColumn("sparse", sparse).withColumn("sigma", F.when(sparse | (sigma <= 0), F.greatest(sigma, floor)).otherwise(sigma))
    out = with_persistence(stats, metric)
    delta = F.col("actual") - F.col("expected")
    out = out.withColumn("delta", delta).withColumn("pct_change", F.try_divide(delta, F.abs("expected"))).withColumn("z", F.try_divide(delta, F.col("sigma") * F.sqrt("n_days")))
    if plan is not None:
        out = out.join(plan, list(by), "left")
    else:
        out = out.withColumn("plan", F.lit(None).cast("double"))
    gates = gate_columns(metric)
    out = out.select("*", *[g.alias(n) for n, g in gates.items()])
    material = F.coalesce(F.col("gate_abs") & F.col("gate_plan") & F.col("gate_persistence") & F.col("gate_z"), F.lit(False))
    verdict = F.when(F.col("sparse") | F.col("actual").isNull(), "INSUFFICIENT_HISTORY").when(material, "MATERIAL").otherwise("NOT_MATERIAL")
    names = [*(b for b in by if b != "_all"), "actual", "expected", "delta", "pct_change", "z", "sigma", "n_days", "persistence", "history_days", "sparse", "plan", *gates]
    return out.select(*names, material.alias("material"), verdict.alias("verdict"))


def window_sums(inside: Column) -> list[Column]:
    """Aggregates over a slice's days inside the window that have a value and an expectation: actual,
    expected, n_days, and their residuals (as many as a window has days), beside all other statistics."""
    counts = inside & F.col("e").isNotNull() & F.col("v").isNotNull()
    return [
        F.sum(F.when(counts, F.col("v"))).alias("actual"), F.sum(F.when(counts, F.col("e"))).alias("expected"),
        F.nullif(F.count(F.when(counts, F.lit(1))), F.lit(0)).alias("n_days"), F.collect_list(F.when(counts, F.col("resid"))).alias("_resids"),
    ]


def with_persistence(stats: DataFrame, metric: Metric) -> DataFrame:
    """stats with the number of days outside warn sigma; null where the window is empty."""
    days = F.size(F.filter("_resids", lambda r: F.abs(r) > metric.warn_sigma * F.col("sigma"))).cast("long")
    return stats.withColumn("persistence", F.when(F.col("n_days").isNotNull(), days)).drop("_resids")


def gate_columns(metric: Metric) -> dict[str, Column]:
    """The four materiality gates over delta, plan, persistence and z."""
    return {
        "gate_abs": (F.abs("delta") >= metric.abs_floor) if metric.unit == "INR" else F.lit(True),
        "gate_plan": F.coalesce(F.try_divide(F.abs("delta"), F.abs("plan")) >= metric.pct_floor, F.lit(True)),
        "gate_persistence": F.col("persistence") >= metric.persistence_days,
        "gate_z": F.abs("z") >= metric.warn_sigma,
    }


def late_row_collapse(rows: DataFrame, we: date, by: tuple[str, ...] = (), recent_days: int = 7, floor: float = 0.35) -> DataFrame:
    """Slices whose daily row count of the last days fell under `floor` of the 28 rows before: a partial load."""
    daily = rows.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n")).where(F.col("d") <= F.lit(we))
    recent = F.col("d") >= F.date_sub(F.lit(we), recent_days - 1)
    order = Window.partitionBy(*by, recent).orderBy(F.desc("d"))
    kept = daily.withColumn("recent", recent).withColumn("r", F.row_number().over(order)).where(F.col("recent") | (F.col("r") <= 28))
    out = kept.groupBy(*by).agg(F.avg(F.when(F.col("recent"), F.col("n"))).alias("recent_mean"), F.avg(F.when(~F.col("recent"), F.col("n"))).alias("base_mean"))
    return out.withColumn("partial_load", F.coalesce(F.col("recent_mean") < floor * F.col("base_mean"), F.lit(False)))


def prorated_plan(windows: DataFrame, plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Plan of each window (ws, we): every month's plan by the share of its days inside."""
    months = months_in_window(windows)
    joined = months.join(plan, ["year", "month"])
    return joined.groupBy(*by, *windows.columns).agg(F.sum(F.col("plan_value") * F.col("overlap_days") / F.col("days_in_month")).alias("plan"))


def derived_plan(fact: DataFrame, by: tuple[str, ...] = ("region",), uplift: float = 1.04) -> DataFrame:
    """A plan by month for tables that have none: mean daily revenue of the month by its days, raised."""
    daily = fact.groupBy(*by, F.col("order_date").alias("d")).agg(F.sum("net_revenue").alias("v"))
    month = daily.groupBy(*by, F.year("d").alias("year"), F.month("d").alias("month")).agg(F.avg("v").alias("mean"), F.dayofmonth(F.last_day(F.min("d"))).alias("dim"))
    return month.select(*by, "year", "month", (F.col("mean") * F.col("dim") * uplift).alias("plan_value"))


def plan_before(fact: DataFrame, ws: date, we: date, days: int = 84, uplift: float = 1.04) -> DataFrame:
    """year, month, plan_value for the months of a window without a plan table: mean daily revenue of the days
    before the window, raised. Nothing of the window or after it is read."""
    daily = fact.where(F.col("order_date").between(F.date_sub(F.lit(ws), days), F.date_sub(F.lit(ws), 1))).groupBy(F.col("order_date").alias("d")).agg(F.sum("net_revenue").alias("v"))
    months = months_in_window(fact.sparkSession.createDataFrame([(ws, we)], "ws date, we date")).select("year", "month", "days_in_month").distinct()
    return months.join(F.broadcast(daily.agg(F.avg("v").alias("mean")))).select("year", "month", (F.col("mean") * F.col("days_in_month") * uplift).alias("plan_value"))
