"""Do-nothing projection and the overlay of an intervention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.series import tail

#: Rows needed, rows fitted.
MIN_POINTS, FIT_ROWS = 35, 28


def smoothed(series: DataFrame, by: tuple[str, ...] = (), fit: int = FIT_ROWS) -> DataFrame:
    """The last `fit` rows with k (0..) and wk, the centred 7-row mean cut off at the ends."""
    last = tail(series.select(*by, "d", "v"), fit, by)
    w = Window.partitionBy(*by).orderBy("d")
    return last.withColumn("k", F.row_number().over(w) - 1).withColumn("wk", F.avg("v").over(w.rowsBetween(-3, 3)))


def theil_sen(rows: DataFrame, y: str = "wk", by: tuple[str, ...] = ()) -> DataFrame:
    """Median slope of all pairs of a slice's fitted rows (at most FIT_ROWS of them)."""
    a, b = rows.select(*by, F.col("k").alias("i"), F.col(y).alias("yi")), rows.select(*by, F.col("k").alias("j"), F.col(y).alias("yj"))
    pairs = a.join(b, list(by)).where("i < j") if by else a.withColumn("_g", F.lit(1)).join(b.withColumn("_g", F.lit(1)), "_g").where("i < j")
    return pairs.groupBy(*by).agg(F.median((F.col("yj") - F.col("yi")) / (F.col("j") - F.col("i"))).alias("slope"))


def project(series: DataFrame, horizon: int = 28, by: tuple[str, ...] = ()) -> DataFrame:
    """h, centre, lo, hi: level plus slope h, with a band of 1.96 sigma sqrt(h / 7). Slices with under
    MIN_POINTS rows have no forecast."""
    one = list(by) or ["_g"]
    series = series if by else series.withColumn("_g", F.lit(1))
    by_ = tuple(one)
    enough = series.groupBy(*by_).agg(F.count("v").alias("points")).where(F.col("points") >= MIN_POINTS)
    rows = smoothed(series.join(enough.select(*by_), one, "left_semi"), by_)
    rows = rows.withColumn("_m", F.percentile(F.col("v") - F.col("wk"), F.lit(0.5)).over(Window.partitionBy(*by_)))
    fit = rows.groupBy(*by_).agg(F.median(F.when(F.col("k") >= FIT_ROWS - 7, F.col("wk"))).alias("level"), (F.median(F.abs(F.col("v") - F.col("wk") - F.col("_m"))) * 1.4826).alias("sigma"))
    path = fit.join(theil_sen(rows, "wk", by_), one).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    centre, width = F.col("level") + F.col("slope") * F.col("h"), 1.96 * F.col("sigma") * F.sqrt(F.col("h") / 7.0)
    return path.select(*by, "h", "level", "slope", "sigma", centre.alias("centre"), (centre - width).alias("lo"), (centre + width).alias("hi"))


def with_intervention(forecast: DataFrame, recovery_per_day: float, ramp_days: int) -> DataFrame:
    """The path with a recovery that grows linearly over the ramp."""
    share = F.least(F.lit(1.0), F.col("h") / F.lit(float(max(1, ramp_days))))
    return forecast.withColumn("ramp", share).withColumn("with_action", F.col("centre") + F.lit(recovery_per_day) * share)
