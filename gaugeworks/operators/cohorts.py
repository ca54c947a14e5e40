"""Cohorts of hypotheses as rows: events by interval join, batched counterfactuals, onsets of many causes.

A hypothesis names the values of some dimensions that were exposed, and those that serve as control.
Everything here takes any number of hypotheses or questions at once, each with its own window, and
reads the fact once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.causal import MIN_ROWS
from gaugeworks.operators.series import rolling_mean

#: Days in a bucket of the interval join.
BUCKET_DAYS = 16
#: Days before a window in which an event still counts, and the type that makes a hypothesis.
EVENT_LAG, COMPETITOR = 14, "competitor_promo"


def _buckets(lo: Column, hi: Column) -> Column:
    """The buckets of days that an interval touches."""
    number = lambda d: F.floor(F.unix_date(d) / BUCKET_DAYS).cast("long")
    return F.sequence(number(lo), number(hi))


def touching(events: DataFrame, windows: DataFrame, lag_days: int = EVENT_LAG) -> DataFrame:
    """Pairs of an event (event_id, start_date, end_date, region, ..) and a window (window, ws, we, region)
    whose days meet, the lag before the window included; a window without region meets events of all.

    An interval join by equality: both sides go to the buckets of days that they touch, and a pair is kept
    in the first bucket that both have, so it comes once. Events that end before they start, or lack a
    date, touch nothing."""
    e = events.where("start_date <= end_date").withColumn("_eb", _buckets(F.col("start_date"), F.col("end_date"))).withColumn("_b", F.explode("_eb"))
    w = windows.where("ws <= we").withColumn("_lo", F.date_sub("ws", lag_days)).withColumn("_wb", _buckets(F.col("_lo"), F.col("we"))).withColumn("_b", F.explode("_wb"))
    w = w.withColumnRenamed("region", "_region")
    pairs = e.join(w, "_b").where((F.col("start_date") <= F.col("we")) & (F.col("end_date") >= F.col("_lo")))
    pairs = pairs.where(F.col("_b") == F.greatest(F.get("_eb", F.lit(0)), F.get("_wb", F.lit(0))))
    return pairs.where(F.col("_region").isNull() | (F.col("_region") == F.col("region"))).drop("_eb", "_wb", "_b", "_lo", "_region")


def event_hypotheses(events: DataFrame, windows: DataFrame, channels: DataFrame, lag_days: int = EVENT_LAG) -> DataFrame:
    """window, hyp, event_id, start_date, role ('t' or 'c'), dim, value, need: the cohorts of every competitor
    event that touches a window. Exposed is the event's region and channel; control are the same region's
    other channels (channels: channel). Only competitor promotions make hypotheses, all of them do."""
    hit = touching(events.where(F.col("event_type") == COMPETITOR), windows, lag_days)
    hit = hit.withColumn("hyp", F.concat(F.lit("H-COMP-"), F.col("event_id").cast("string")))
    all_ = channels.agg(F.array_sort(F.collect_set("channel")).alias("_channels"))
    entry = lambda role, dim, value: F.struct(F.lit(role).alias("role"), F.lit(dim).alias("dim"), value.alias("value"))
    others = F.transform(F.filter("_channels", lambda c: c != F.col("channel")), lambda c: entry("c", "channel", c))
    rows = hit.join(F.broadcast(all_)).withColumn("m", F.concat(F.array(entry("t", "region", F.col("region")), entry("t", "channel", F.col("channel")), entry("c", "region", F.col("region"))), others))
    return rows.select("window", "hyp", "event_id", "start_date", "ws", "we", F.explode("m").alias("m")).select("window", "hyp", "event_id", "start_date", "ws", "we", "m.role", "m.dim", "m.value", F.lit(2).alias("need"))


def cohort_rows(spark, hypotheses: list[dict], members: dict[str, list[str]] | None = None):  # noqa: ANN001, ANN201
    """Rows for batched tests from hypotheses with id, ws, we, exposure and control (dimension to value or
    values). Without a control the other members of the one exposed dimension serve."""
    many = lambda v: list(v) if isinstance(v, (list, tuple)) else [v]
    rows = []
    for h in hypotheses:
        control = h.get("control")
        if not control and len(h["exposure"]) == 1:
            (dim, value), = h["exposure"].items()
            control = {dim: [m for m in (members or {}).get(dim, ()) if m not in many(value)]}
        for role, cohort in (("t", h["exposure"]), ("c", control or {})):
            rows += [(h["id"], h["ws"], h["we"], role, dim, str(v), len(cohort)) for dim, vs in cohort.items() for v in many(vs)]
    return spark.createDataFrame(rows, "hyp string, ws date, we date, role string, dim string, value string, need int")


def cohort_series(fact: DataFrame, cohorts: DataFrame, dimensions: tuple[str, ...], measure: str = "net_revenue", days: int = 28) -> DataFrame:
    """hyp, d, cur, t, c: daily sums of both cohorts of every hypothesis from its baseline to its window's end.

    One scan: the fact is added up to days by `dimensions`, a table that does not grow with the lines of a
    day, and these cells meet the cohorts by equality of (dimension, value); a cell belongs to a cohort
    whose every dimension it matches. cohorts: hyp, ws, we, role, dim, value, need (how many dimensions)."""
    span = cohorts.agg(F.date_sub(F.min("ws"), days + 1).alias("lo"), F.max("we").alias("hi")).first()
    if span is None or span["lo"] is None:
        return fact.sparkSession.createDataFrame([], "hyp string, d date, cur boolean, t double, c double")
    inside = fact.where(F.col("order_date").between(F.lit(span["lo"]), F.lit(span["hi"])))
    cells = inside.groupBy(F.col("order_date").alias("d"), *dimensions).agg(F.sum(measure).alias("v"))
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).cast("string").alias("value")) for x in dimensions]))
    flat = cells.withColumn("cell", F.struct(*dimensions)).select("d", "cell", "v", pairs.alias("p")).select("d", "cell", "v", "p.dim", "p.value")
    met = flat.join(cohorts, ["dim", "value"]).where(F.col("d").between(F.date_sub("ws", days + 1), F.col("we")))
    member = met.groupBy("hyp", "ws", "we", "role", "need", "d", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).where("n = need")
    return member.groupBy("hyp", "d", (F.col("d") >= F.col("ws")).alias("cur"), F.datediff("we", "ws").alias("span")).agg(F.sum(F.when(F.col("role") == "t", F.col("v"))).alias("t"), F.sum(F.when(F.col("role") == "c", F.col("v"))).alias("c"))


def counterfactuals(series: DataFrame) -> DataFrame:
    """hyp, enough, n1, n0, did, se, t_stat, placebo, parallel, attributable of every hypothesis of a
    cohort_series: difference in differences of ln t - ln c on days where both are positive, and the
    placebo between the halves of the baseline. A hypothesis' days are its window and baseline: bounded."""
    r = F.when((F.col("t") > 0) & (F.col("c") > 0), F.ln("t") - F.ln("c"))
    rows = series.withColumn("r", r)
    pre = F.col("r").isNotNull() & ~F.col("cur")
    rows = rows.withColumn("k", F.when(pre, F.row_number().over(Window.partitionBy("hyp", pre).orderBy("d")))).withColumn("half", F.floor(F.sum(F.when(pre, 1).otherwise(0)).over(Window.partitionBy("hyp")) / 2))
    post_r, pre_r = F.when(F.col("cur"), F.col("r")), F.when(~F.col("cur"), F.col("r"))
    out = rows.groupBy("hyp").agg(
        F.max("span").alias("span"), F.avg(post_r).alias("m1"), F.avg(pre_r).alias("m0"), F.var_samp(post_r).alias("s1"), F.var_samp(pre_r).alias("s0"), F.count(post_r).alias("n1"), F.count(pre_r).alias("n0"), F.max("half").alias("half"),
        F.avg(F.when(F.col("k") <= F.col("half"), F.col("r"))).alias("early"), F.avg(F.when(F.col("k") > F.col("half"), F.col("r"))).alias("late"),
        *[f(F.when(F.col("cur") == bool(flag), F.col(c))).alias(f"{name}_{c}{flag}") for name, f in (("rows", F.count), ("avg", F.avg)) for c in "tc" for flag in (0, 1)],
    )
    did, placebo = F.col("m1") - F.col("m0"), F.when(F.col("half") >= 3, F.col("late") - F.col("early")).otherwise(F.lit(0.0))
    se = F.sqrt(F.try_divide("s1", "n1") + F.try_divide("s0", "n0"))
    enough = F.least(*[F.col(f"rows_{c}{f}") for c in "tc" for f in (0, 1)]) >= MIN_ROWS
    control = F.try_divide("avg_c1", "avg_c0")
    return out.select(
        "hyp", enough.alias("enough"), "n1", "n0", did.alias("did"), se.alias("se"), F.try_divide(did, se).alias("t_stat"), placebo.alias("placebo"),
        F.coalesce(F.abs(placebo) < F.greatest(F.lit(0.04), 0.5 * F.abs(did)), F.lit(False)).alias("parallel"), ((F.col("avg_t1") - F.col("avg_t0") * control) * (F.col("span") + 1)).alias("attributable"),
    )


def onsets(series: DataFrame, asks: DataFrame, factor: float | None = None, shift: float | None = None, lookback: int = 45, run: int = 3) -> DataFrame:
    """ask, onset, rows: for every question the first day of `run` days in a row beyond its reference.

    series: slice, d, v; asks: ask, slice, ws, we. A question sees its slice from `lookback` days before its
    window to the window's end. The mean of 7 rows (of 4 at least) is held against the median of its first
    21: above `factor` times it, those of days before the window (a rise in price); or below it by more than
    `shift`, those of any day (a fall in a rate). With 20 rows or fewer, or no such run, onset is null."""
    inside = series.join(asks.select("ask", "slice", "ws", "we"), "slice").where(F.col("d").between(F.date_sub("ws", lookback), F.col("we")))
    rows = inside.withColumn("m", rolling_mean("v", ("ask",), -6, 0, 4))
    # rows are numbered with those that have no mean yet
    before = F.col("d") < F.col("ws") if shift is None else F.lit(True)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("ask").orderBy("d")))
    ref = F.percentile(F.when(before & (F.col("k") <= 21), F.col("m")), F.lit(0.5)).over(Window.partitionBy("ask"))
    hit = F.coalesce(F.col("m") < ref - shift if shift is not None else F.col("m") > ref * factor, F.lit(False)).cast("int")
    last = Window.partitionBy("ask").orderBy("d").rowsBetween(1 - run, 0)
    rows = rows.withColumn("hit", hit).withColumn("runs", F.sum("hit").over(last))
    found = rows.groupBy("ask").agg(F.min(F.when(F.col("runs") == run, F.col("d"))).alias("end"), F.count(F.lit(1)).alias("rows"))
    return asks.select("ask").join(found, "ask", "left").select("ask", F.when(F.col("rows") > 20, F.date_sub("end", run - 1)).alias("onset"), F.coalesce("rows", F.lit(0)).alias("rows"))


def price_onsets(fact: DataFrame, asks: DataFrame, slice_of: Column, lookback: int = 45) -> DataFrame:
    """Onsets of a rise of the realised price (revenue over units) by two hundredths, for every question."""
    span = asks.agg(F.date_sub(F.min("ws"), lookback).alias("lo"), F.max("we").alias("hi")).first()
    rows = fact.where(F.col("order_date").between(F.lit(span["lo"]), F.lit(span["hi"])))
    price = rows.groupBy(slice_of.alias("slice"), F.col("order_date").alias("d")).agg(F.try_divide(F.sum("net_revenue"), F.sum("units")).alias("v"))
    return onsets(price, asks, factor=1.02, lookback=lookback)
