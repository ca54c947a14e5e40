"""Causal tests on measured data: difference in differences, dose-response, precedence, onsets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import normal_two_sided_p, student_two_sided_p
from gaugeworks.operators.series import rolling_mean
from gaugeworks.operators.split import baseline, scale_of, two_windows
from gaugeworks.sources.store import numbered, stored

#: Rows that each of the four series must have.
MIN_ROWS = 5


def log_ratio_series(rows: DataFrame, treated: Column, measure: str = "net_revenue") -> DataFrame:
    """d, cur, t, c, r: daily sums of both cohorts in one scan, r = ln t - ln c where both are positive."""
    s = rows.groupBy(F.col("order_date").alias("d"), "cur").agg(F.sum(F.when(treated, F.col(measure))).alias("t"), F.sum(F.when(~treated, F.col(measure))).alias("c"))
    return s.withColumn("r", F.when((F.col("t") > 0) & (F.col("c") > 0), F.ln("t") - F.ln("c")))


def difference_in_differences(fact: DataFrame, treated: Column, ws: date, we: date, measure: str = "net_revenue", days: int = 28) -> DataFrame:
    """One row: did, se, t, placebo, parallel, the attributable amount, and whether there was enough data."""
    bs, be = baseline(ws, days)
    r = log_ratio_series(two_windows(fact, ws, we, bs, be), treated, measure)
    pre = F.col("r").isNotNull() & ~F.col("cur")
    order = F.row_number().over(Window.partitionBy(pre).orderBy("d"))
    r = r.withColumn("k", F.when(pre, order)).withColumn("half", F.floor(F.sum(F.when(pre, 1).otherwise(0)).over(Window.partitionBy(F.lit(1))) / 2))
    post_r, pre_r = F.when(F.col("cur"), F.col("r")), F.when(~F.col("cur"), F.col("r"))
    out = r.agg(
        F.avg(post_r).alias("m1"), F.avg(pre_r).alias("m0"), F.var_samp(post_r).alias("s1"), F.var_samp(pre_r).alias("s0"), F.count(post_r).alias("n1"), F.count(pre_r).alias("n0"), F.max("half").alias("half"),
        F.avg(F.when(F.col("k") <= F.col("half"), F.col("r"))).alias("early"), F.avg(F.when(F.col("k") > F.col("half"), F.col("r"))).alias("late"),
        *[F.count(F.when(F.col("cur") == flag, F.col(c))).alias(f"rows_{c}{int(flag)}") for c in "tc" for flag in (True, False)],
        *[F.avg(F.when(F.col("cur") == flag, F.col(c))).alias(f"avg_{c}{int(flag)}") for c in "tc" for flag in (True, False)],
    )
    did, placebo = F.col("m1") - F.col("m0"), F.when(F.col("half") >= 3, F.col("late") - F.col("early")).otherwise(F.lit(0.0))
    se = F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0"))
    enough = F.least(*[F.col(f"rows_{c}{f}") for c in "tc" for f in (0, 1)]) >= MIN_ROWS
    control = F.try_divide(F.col("avg_c1"), F.col("avg_c0"))
    span = (we - ws).days + 1
    return out.select(
        enough.alias("enough"), "n1", "n0", did.alias("did"), se.alias("se"), F.try_divide(did, se).alias("t_stat"), placebo.alias("placebo"),
        (F.abs(placebo) < F.greatest(F.lit(0.04), 0.5 * F.abs(did))).alias("parallel"), ((F.col("avg_t1") - F.col("avg_t0") * control) * span).alias("attributable"),
    )


def with_p_value(did: DataFrame) -> DataFrame:
    return did.withColumn("p_value", normal_two_sided_p(F.col("t_stat")))


def exposure_table(fact: DataFrame, shipments: DataFrame, ws: date, we: date, measure: str = "net_revenue", days: int = 28) -> DataFrame:
    """account_id, late (late shipments from the baseline's start to the window's end), change of the
    account's mean line value from baseline to window. Accounts without shipments have 0 late."""
    bs, be = baseline(ws, days)
    span = fact.where(F.col("order_date").between(F.lit(bs), F.lit(we)))
    late = span.select("order_id", "line_no", "account_id").join(shipments.where(~F.col("on_time")).select("order_id", "line_no"), ["order_id", "line_no"]).groupBy("account_id").agg(F.count(F.lit(1)).alias("late"))
    d = F.col("order_date")
    change = span.groupBy("account_id").agg(F.avg(F.when(d.between(F.lit(ws), F.lit(we)), F.col(measure))).alias("post"), F.avg(F.when(d.between(F.lit(bs), F.lit(be)), F.col(measure))).alias("pre"))
    both = change.where("pre > 0 and post is not null").join(late, "account_id", "left").fillna(0, ["late"])
    return both.select("account_id", "late", (F.col("post") / F.col("pre") - 1).alias("change"))


def dose_buckets(exposure: DataFrame, least: int = 3) -> DataFrame:
    """Mean change by exposure: none, 1-2, 3-5, more; buckets with fewer accounts than `least` go."""
    bucket = F.when(F.col("late") <= 0.5, 0).when(F.col("late") <= 2.5, 1).when(F.col("late") <= 5.5, 2).otherwise(3)
    return exposure.groupBy(bucket.alias("bucket")).agg(F.avg("change").alias("mean_change"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def monotone(buckets: DataFrame) -> DataFrame:
    """Whether the mean falls from bucket to bucket."""
    step = F.col("mean_change") - F.lag("mean_change").over(Window.orderBy("bucket"))
    return buckets.withColumn("step", step).agg(F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(False)).alias("monotone"), F.count(F.lit(1)).alias("buckets"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """column, name: the rank of each distinct value, ties sharing their mean."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [column], "n").select(column, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where a side does not vary (corr divides by zero there, an error)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    pairs = stored(df.select(F.col(x).alias("x"), F.col(y).alias("y")), "pairs")
    ranked = pairs.join(average_ranks(pairs, "x", "rx"), "x").join(average_ranks(pairs, "y", "ry"), "y")
    return ranked.agg(correlation("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_p(rho: float | None, n: int) -> float | None:
    if rho is None or n < 3:
        return None
    return student_two_sided_p(rho * ((n - 2) / max(1e-12, 1 - rho * rho)) ** 0.5, n - 2)


def sustained_break(series: DataFrame, ws: date, factor: float | None = 1.02, shift: float | None = None, lookback: int = 45, run: int = 3) -> DataFrame:
    """First day of a run of `run` days beyond the reference, from `lookback` days before the window.

    The 7-row mean is held against the median of its first 21 values: above factor times it, or (with
    shift) below it by more than shift. Needs over 20 rows.
    """
    s = series.withColumn("m", rolling_mean("v", (), -6, 0, 4)).where("m is not null")
    s = s.where(F.col("d") >= F.date_sub(F.lit(ws), lookback)).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("d")))
    ref = F.percentile(F.when(F.col("k") <= 21, F.col("m")), F.lit(0.5)).over(Window.partitionBy(F.lit(1)))
    hit = F.col("m") < ref - shift if shift is not None else F.col("m") > ref * factor
    w = Window.partitionBy(F.lit(1)).orderBy("d").rowsBetween(1 - run, 0)
    s = s.withColumn("hit", hit.cast("int")).withColumn("runs", F.sum("hit").over(w)).withColumn("seen", F.count("hit").over(w))
    out = s.agg(F.min(F.when((F.col("runs") == run) & (F.col("seen") == run), F.col("d"))).alias("last"), F.count(F.lit(1)).alias("rows"))
    return out.select(F.when(F.col("rows") > 20, F.date_sub("last", run - 1)).alias("onset"), "rows")


def effect_onset(band: DataFrame, ws: date, we: date, sigma: float, days_before: int = 28, gap: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Start of the last run of days under -sigma in the window and the days before it; days that
    recover for one row do not end a run."""
    part = list(by) or [F.lit(1)]
    rows = band.where(F.col("d").between(F.date_sub(F.lit(ws), days_before), F.lit(we)) & F.col("resid").isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy("d")))
    breach = rows.where(F.col("resid") < -sigma)
    w = Window.partitionBy(*part).orderBy("rn")
    new = F.coalesce((F.col("rn") - F.lag("rn").over(w) > gap).cast("int"), F.lit(1))
    island = breach.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(*by, "island").agg(F.min("d").alias("onset"), F.max("d").alias("last"), F.count(F.lit(1)).alias("days"))
    return spans.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("island")))).where("r = 1").drop("r", "island")


def consistent_gap(gap_days: int | None, lag_days: int) -> bool:
    """A cause may start three days after its effect was seen at most, and ten beyond its lag before."""
    return gap_days is not None and -3 <= gap_days <= lag_days + 10


def cohort_change(fact: DataFrame, cohort: Column, ws: date, we: date, measure: str = "net_revenue", days: int = 28) -> DataFrame:
    """Current and scaled baseline of a cohort and the others."""
    bs, be = baseline(ws, days)
    rows, scale = two_windows(fact, ws, we, bs, be), scale_of(ws, we, bs, be)
    return rows.groupBy(cohort.alias("exposed")).agg(F.sum(F.when(F.col("cur"), F.col(measure)).otherwise(0.0)).alias("cur"), (F.sum(F.when(F.col("base"), F.col(measure)).otherwise(0.0)) * F.lit(scale)).alias("base"))
