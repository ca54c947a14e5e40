"""Decomposition of a movement: price, volume, mix; contributions over a lattice of dimensions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("region", "city", "segment", "channel", "category", "tier", "warehouse_id", "account_id")


def baseline(ws: date, days: int = 28) -> tuple[date, date]:
    """The days before a window: days + 1 of them, both ends included."""
    return ws - timedelta(days=days + 1), ws - timedelta(days=1)


def scale_of(ws: date, we: date, bs: date, be: date) -> float:
    return ((we - ws).days + 1) / ((be - bs).days + 1)


def two_windows(fact: DataFrame, ws: date, we: date, bs: date, be: date, column: str = "order_date") -> DataFrame:
    """Rows of both windows with `cur` and `base` flags: everything below sums conditionally in this one scan."""
    d = F.col(column)
    return fact.where(d.between(F.lit(bs), F.lit(be)) | d.between(F.lit(ws), F.lit(we))).withColumn("cur", d.between(F.lit(ws), F.lit(we))).withColumn("base", d.between(F.lit(bs), F.lit(be)))


def _sums(column: str, scale: float | Column) -> tuple[Column, Column]:
    cur = F.sum(F.when(F.col("cur"), F.col(column)).otherwise(0.0))
    if isinstance(scale, Column):
        return cur, F.sum(F.when(F.col("base"), F.col(column)).otherwise(0.0) * scale)
    return cur, F.sum(F.when(F.col("base"), F.col(column)).otherwise(0.0)) * F.lit(scale)


def price_volume_mix(rows: DataFrame, scale: float | Column, revenue: str = "net_revenue", units: str = "units", tier: str = "tier", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key of by): volume, mix and rate effects, the total and what they leave.

    volume = (v1 - v0) p0; mix = v1 sum (s1 - s0) p0_t; rate = v1 sum s1 (p1_t - p0_t); a tier without
    units in a window has price 0 there.
    """
    (r1, r0), (v1, v0) = _sums(revenue, scale), _sums(units, scale)
    tiers = rows.groupBy(*by, tier).agg(r1.alias("r1"), r0.alias("r0"), v1.alias("v1"), v0.alias("v0"))
    all_ = Window.partitionBy(*(by or [F.lit(1)]))
    total = lambda c: F.sum(c).over(all_)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), total(c)), F.lit(0.0))
    price = lambda r, v: F.when(F.col(v) > 0, F.col(r) / F.col(v)).otherwise(F.lit(0.0))
    t = tiers.select(*by, "r1", "r0", "v1", "v0", share("v1").alias("s1"), share("v0").alias("s0"), price("r1", "v1").alias("p1"), price("r0", "v0").alias("p0"))
    s = t.groupBy(*by).agg(F.sum("r1").alias("r1"), F.sum("r0").alias("r0"), F.sum("v1").alias("v1"), F.sum("v0").alias("v0"), F.sum((F.col("s1") - F.col("s0")) * F.col("p0")).alias("m"), F.sum(F.col("s1") * (F.col("p1") - F.col("p0"))).alias("k"))
    volume = (F.col("v1") - F.col("v0")) * F.coalesce(F.try_divide("r0", "v0"), F.lit(0.0))
    mix, rate, move = F.col("v1") * F.col("m"), F.col("v1") * F.col("k"), F.col("r1") - F.col("r0")
    return s.select(*by, F.col("r1").alias("current"), F.col("r0").alias("baseline"), move.alias("total"), volume.alias("volume_effect"), mix.alias("mix_effect"), rate.alias("rate_effect"), (move - volume - mix - rate).alias("residual"))


def lattice(rows: DataFrame, scale: float | Column, measure: str = "net_revenue", dimensions: tuple[str, ...] = DIMENSIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """by.., dimension, value, cur, base, move, explanatory power, share shift and score of every value.

    One pass: every row goes to its value of each dimension, and each task adds these up before the one
    shuffle, so what is shuffled is as many rows as a dimension has values, not as the windows have.
    """
    c, b = F.when(F.col("cur"), F.col(measure)).otherwise(0.0), F.when(F.col("base"), F.col(measure)).otherwise(0.0)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    flat = rows.select(*by, c.alias("c"), (b * F.lit(scale)).alias("b"), pairs.alias("p")).groupBy(*by, "p.dimension", "p.value").agg(F.sum("c").alias("cur"), F.sum("b").alias("base"))
    # totals are a row a dimension: no task sees all values of one
    totals = flat.groupBy(*by, "dimension").agg(F.sum("cur").alias("_cur"), F.sum("base").alias("_base"))
    flat = flat.join(totals, [*by, "dimension"])
    total_cur, total_base = F.col("_cur"), F.col("_base")
    move = F.col("cur") - F.col("base")
    out = flat.select(*by, "dimension", "value", "cur", "base", move.alias("move"), F.try_divide(move, total_cur - total_base).alias("explanatory_power"), (F.coalesce(F.try_divide("cur", total_cur), F.lit(0.0)) - F.coalesce(F.try_divide("base", total_base), F.lit(0.0))).alias("share_shift"))
    return out.where(F.abs("move") >= 1e-9).withColumn("score", F.abs("explanatory_power") * (1 + 4 * F.abs("share_shift")))


def top_contributors(cells: DataFrame, n: int = 8) -> DataFrame:
    return cells.orderBy(F.desc("score"), "dimension", "value").limit(n)


def top_per_dimension(cells: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("score"), "value"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= n)


def js_divergence(cells: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (natural log) between a dimension's two distributions."""
    w = Window.partitionBy("dimension")
    clip = lambda c: F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)), F.lit(1e-12))
    p = cells.select("dimension", clip("cur").alias("p"), clip("base").alias("q"))
    p = p.select("dimension", (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = 0.5 * (F.col("p") * F.ln(F.col("p") / F.col("m")) + F.col("q") * F.ln(F.col("q") / F.col("m")))
    return p.groupBy("dimension").agg(F.sum(term).alias("js"))


def split(fact: DataFrame, ws: date, we: date, days: int = 28) -> dict[str, DataFrame]:
    """Price-volume-mix, lattice and divergences of a window against its baseline."""
    bs, be = baseline(ws, days)
    rows, scale = two_windows(fact, ws, we, bs, be), scale_of(ws, we, bs, be)
    cells = lattice(rows, scale)
    return {"identity": price_volume_mix(rows, scale), "cells": cells, "top": top_contributors(cells), "per_dimension": top_per_dimension(cells), "divergence": js_divergence(cells)}
