"""Estate sweep and backtest: many slices and windows in one plan."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.contract import Contract, Metric
from gaugeworks.operators.sift import detect_many
from gaugeworks.sources.store import stored

#: Dimensions swept, and the sizes of the worklist and of the data-quality list.
SWEEP_DIMENSIONS = ("region", "segment", "channel", "category")
WORKLIST, DQ_LIST = 12, 6


def sweep_series(fact: DataFrame, metrics: list[Metric], dimensions: tuple[str, ...]) -> DataFrame:
    """metric, slice, d, v of every value of every dimension for all metrics: one scan, one
    pre-aggregation to the cube of dimensions, then sums by slice."""
    parts = [x for i, m in enumerate(metrics) for x in (m.parts()[0].alias(f"n{i}"), (m.parts()[1] if m.denominator else F.lit(1.0)).alias(f"m{i}"))]
    base = fact.groupBy(*dimensions, F.col("order_date").alias("d")).agg(*parts)
    names = [f"{k}{i}" for i in range(len(metrics)) for k in "nm"]
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in dimensions]))
    s = base.select("d", *names, pairs.alias("slice")).groupBy("slice", "d").agg(*[F.sum(c).alias(c) for c in names])
    value = lambda i, m: F.col(f"n{i}") if m.kind == "additive" else F.try_divide(f"n{i}", f"m{i}")
    values = F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), value(i, m).cast("double").alias("v")) for i, m in enumerate(metrics)]))
    return s.select("slice", "d", values.alias("x")).select("x.metric", "slice", "d", "x.v")


def sweep(fact: DataFrame, contract: Contract, metrics: list[str], ws: date, we: date, dimensions: tuple[str, ...] = SWEEP_DIMENSIONS) -> DataFrame:
    """Verdicts of all slices of all metrics; metrics are only cut by dimensions of their grain.

    The fact is read once for all metrics of equal grain; their daily series by slice, which no longer
    grow with the fact, are stored, and everything after reads these."""
    by_grain: dict[tuple[str, ...], list[Metric]] = {}
    for name in metrics:
        dims = tuple(d for d in dimensions if contract.sliceable(name, d))
        if contract.metric(name).kind != "derived" and dims:
            by_grain.setdefault(dims, []).append(contract.metric(name))
    found = []
    for dims, own in by_grain.items():
        every = stored(sweep_series(fact.where(F.col("order_date") <= F.lit(we)), own, dims), "sweep-series")
        for metric in own:
            mine = every.where(F.col("metric") == metric.name).drop("metric")
            found.append(detect_many(mine, ws, we, metric, ("slice",)).withColumn("metric", F.lit(metric.name)))
    return reduce(DataFrame.unionByName, found) if found else None


def worklist(swept: DataFrame, n: int = WORKLIST) -> DataFrame:
    return swept.where("verdict = 'MATERIAL'").orderBy(F.desc(F.abs("z")), "metric", "slice").limit(n)


def suppression(swept: DataFrame) -> DataFrame:
    """How many immaterial slices each failed gate held back."""
    gates = [("rupee floor", "gate_abs"), ("share of plan", "gate_plan"), ("persistence", "gate_persistence"), ("sigma", "gate_z")]
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(n)) for n, c in gates]), lambda x: x.isNotNull())
    return swept.where("verdict = 'NOT_MATERIAL'").select(F.explode(failed).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def windows_spine(spark, first: date, last: date, days: int = 14, step: int = 7) -> DataFrame:
    """ws, we of all windows of `days` days that fit, `step` days apart."""
    n = max(0, ((last - timedelta(days=days - 1)) - first).days // step + 1)
    return spark.range(n).select(F.expr(f"date_add(date'{first}', cast(id * {step} as int))").alias("ws")).withColumn("we", F.date_add("ws", days - 1))


def backtest(series: DataFrame, metric: Metric, first: date, last: date, days: int = 14, step: int = 7) -> DataFrame:
    """Verdict of every rolling window from the data before it, all in one plan: each window sees the
    series to its own end as one slice (windows by days rows: bounded by the period's length). The
    daily series is stored, then every day is sent to the windows that end on it or later."""
    n = max(0, ((last - timedelta(days=days - 1)) - first).days // step + 1)
    if not n:
        return _detect_by_window(series.limit(0).withColumn("ws", F.lit(first)).withColumn("we", F.lit(last)).withColumn("slice", F.col("ws")), metric)
    ends = F.lit(first + timedelta(days=days - 1))
    least = F.greatest(F.lit(0), F.ceil(F.datediff("d", ends) / step).cast("int"))
    daily = stored(series, "backtest-series").where(least < n)
    sent = daily.withColumn("_k", F.explode(F.sequence(least, F.lit(n - 1)))).withColumn("ws", F.expr(f"date_add(date'{first}', _k * {step})")).drop("_k")
    sliced = sent.withColumn("we", F.date_add("ws", days - 1)).withColumn("slice", F.col("ws"))
    return _detect_by_window(sliced, metric)


def _detect_by_window(sliced: DataFrame, metric: Metric) -> DataFrame:
    out = detect_windows(sliced, metric)
    floor = (F.abs("delta") >= metric.abs_floor) if metric.unit == "INR" else F.lit(True)
    alert = F.coalesce(~F.col("sparse") & floor & (F.abs("z") >= metric.warn_sigma) & (F.col("persistence") >= metric.persistence_days), F.lit(False))
    return out.select(F.col("slice").alias("ws"), "actual", "expected", "delta", "z", "persistence", alert.alias("alert"))


def detect_windows(sliced: DataFrame, metric: Metric) -> DataFrame:
    """detect_many with the window in the rows instead of in parameters: slice, actual, expected, delta,
    pct_change, z, sigma, n_days, persistence, history_days and sparse of each slice.

    sliced: slice, d, v, ws, we; a slice has one window and no days after it."""
    from gaugeworks.operators.sift import MAD, MIN_HISTORY, SPARSE_CV, SPARSE_WIDTH, window_sums, with_persistence
    from gaugeworks.operators.series import expected_band

    by = ("slice",)
    band = expected_band(sliced, by)
    before, inside = F.col("d") < F.col("ws"), F.col("d").between(F.col("ws"), F.col("we"))
    whole = Window.partitionBy("slice")
    rows = band.withColumn("_c", F.percentile(F.when(before, F.col("resid")), F.lit(0.5)).over(whole)).withColumn("_dev", F.when(before, F.abs(F.col("resid") - F.col("_c"))))
    rows = rows.withColumn("_rank", F.when(before, F.row_number().over(Window.partitionBy("slice", before).orderBy(F.desc("d")))))
    stats = rows.groupBy("slice").agg((F.percentile("_dev", F.lit(0.5)) * MAD).alias("mad"), F.stddev_samp(F.when(before, F.col("resid"))).alias("sd"), F.count(F.when(before, F.col("v"))).alias("history_days"), F.avg(F.when(F.col("_rank") <= 28, F.col("v"))).alias("level"), *window_sums(inside))
    sparse = F.col("history_days") < MIN_HISTORY
    sigma = F.when(F.coalesce("mad", F.lit(0.0)) > 0, F.col("mad")).otherwise(F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))) * F.when(sparse, SPARSE_WIDTH).otherwise(1.0)
    stats = stats.withColumn("sparse", sparse).withColumn("sigma", F.when(sparse, F.greatest(sigma, SPARSE_CV * F.abs(F.coalesce("level", F.lit(0.0))))).otherwise(sigma))
    delta = F.col("actual") - F.col("expected")
    out = with_persistence(stats, metric).withColumn("delta", delta).withColumn("z", F.try_divide("delta", F.col("sigma") * F.sqrt("n_days")))
    return out.select("slice", "actual", "expected", "delta", F.try_divide("delta", F.abs("expected")).alias("pct_change"), "z", "sigma", "n_days", "persistence", "history_days", "sparse")


def confusion(windows: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """events: start_date, end_date. Precision, recall and alert rate against windows that overlap one."""
    from gaugeworks.operators.cohorts import touching

    spans = windows.select("ws", F.date_add("ws", days - 1).alias("we"), F.lit(None).cast("string").alias("region")).distinct()
    known = touching(events.select("start_date", "end_date", F.lit(None).cast("string").alias("region")), spans, 0).select("ws").distinct().withColumn("known", F.lit(True))
    j = windows.join(known, "ws", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    a = j.agg(F.count(F.lit(1)).alias("windows"), F.count_if("alert").alias("alerts"), F.count_if(F.col("alert") & F.col("known")).alias("tp"), F.count_if(F.col("alert") & ~F.col("known")).alias("fp"), F.count_if(~F.col("alert") & F.col("known")).alias("fn"))
    return a.select("*", F.try_divide("alerts", "windows").alias("alert_rate"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))
