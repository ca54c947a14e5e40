"""Distribution drift of dimensions, and drift of the model's inputs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRIFT_DIMENSIONS = ("region", "segment", "channel", "category", "tier")


def share_table(fact: DataFrame, ws: date, we: date, reference_days: int = 120, dimensions: tuple[str, ...] = DRIFT_DIMENSIONS, measure: str = "units") -> DataFrame:
    """dimension, value and its shares of the measure in the reference days before ws and in the window."""
    d = F.col("order_date")
    ref, cur = d.between(F.lit(ws - timedelta(days=reference_days + 1)), F.lit(ws - timedelta(days=1))), d.between(F.lit(ws), F.lit(we))
    narrow = fact.where(ref | cur).select(*[F.col(x).cast("string").alias(x) for x in dimensions], cur.alias("cur"), measure).groupBy(*dimensions, "cur").agg(F.sum(measure).alias("m"))
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in dimensions]))
    flat = narrow.select("cur", "m", pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.sum(F.when(~F.col("cur"), F.col("m")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("cur"), F.col("m")).otherwise(0.0)).alias("a"))
    w = Window.partitionBy("dimension")
    return flat.select("dimension", "value", F.coalesce(F.try_divide("e", F.sum("e").over(w)), F.lit(0.0)).alias("expected"), F.coalesce(F.try_divide("a", F.sum("a").over(w)), F.lit(0.0)).alias("actual"))


def psi(shares: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Population stability index by dimension: shares clipped at eps, normalised, sum (a - e) ln(a / e)."""
    w = Window.partitionBy("dimension")
    clipped = shares.select("dimension", F.greatest("expected", F.lit(eps)).alias("e"), F.greatest("actual", F.lit(eps)).alias("a"))
    n = clipped.select("dimension", (F.col("e") / F.sum("e").over(w)).alias("e"), (F.col("a") / F.sum("a").over(w)).alias("a"))
    out = n.groupBy("dimension").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") < 0.10, "STABLE").when(F.col("psi") < 0.25, "SHIFTING").otherwise("DRIFTED"))


def largest_shifts(shares: DataFrame, n: int = 3) -> DataFrame:
    """The values of each dimension whose share moved most."""
    s = shares.withColumn("shift", F.col("actual") - F.col("expected"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc(F.round(F.abs("shift"), 12)), "value"))).where(F.col("rank") <= n)


def worst(psi_rows: DataFrame) -> DataFrame:
    return psi_rows.agg(F.max_by("dimension", "psi").alias("dimension"), F.max("psi").alias("psi"))


def outside_shares(rows: DataFrame, reference: DataFrame, by: tuple[str, ...], features: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """by, n, outside_share, status, withdrawn of every group of rows: the share of rows with a feature outside the
    reference's range between two percentiles, and what it does to a model's authority there (model_status).

    Percentiles are exact, of values counted by value: features should be of bounded variety (binned amounts). A
    null feature is outside; without reference rows nothing is inside, and without rows there is no group."""
    ends = reference.agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in features])
    inside = lambda c: F.coalesce(F.col(c).between(F.get(f"_{c}", F.lit(0)), F.get(f"_{c}", F.lit(1))), F.lit(False))
    every = inside(features[0])
    for c in features[1:]:
        every = every & inside(c)
    shares = rows.join(F.broadcast(ends)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((~every).cast("double")).alias("outside_share"))
    return shares.withColumn("status", authority(F.col("outside_share"))).withColumn("withdrawn", F.col("status").isin("DRIFTED", "NO_MODEL"))


def authority(outside_share: Column) -> Column:
    """The status that model_status gives."""
    return F.when(outside_share.isNull(), "NO_MODEL").when(outside_share > 0.35, "DRIFTED").when(outside_share > 0.15, "SHIFTING").otherwise("STABLE")


def model_status(outside_share: float | None) -> dict:
    """What the share of out-of-distribution candidates does to the ranker's authority."""
    if outside_share is None:
        return {"status": "NO_MODEL", "withdrawn": True}
    status = "DRIFTED" if outside_share > 0.35 else "SHIFTING" if outside_share > 0.15 else "STABLE"
    return {"status": status, "withdrawn": status == "DRIFTED"}
