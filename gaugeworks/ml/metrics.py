"""Ranking and calibration metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.store import numbered


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mann-Whitney AUC with tied scores sharing ranks.

    Equal scores are counted first; the ranks before each distinct score are summed range by range."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("double").alias("p"))
    ranked = numbered(counts, ["s"], "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    out = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum("n").cast("double").alias("all"))
    return out.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("all") - F.col("pos"))).alias("auc"))


def _ranked(df: DataFrame, episode: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(episode).orderBy(F.desc(score), tie)))


def ndcg(df: DataFrame, k: int = 3, episode: str = "episode_id", score: str = "score", label: str = "label", tie: str = "candidate_id") -> DataFrame:
    """Mean NDCG@k over episodes that have a positive."""
    r = _ranked(df, episode, score, tie).withColumn("ideal", F.row_number().over(Window.partitionBy(episode).orderBy(F.desc(label), tie)))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col(label) / F.log2(F.col(c) + 1)).otherwise(0.0))
    per = r.groupBy(episode).agg(gain("rank").alias("dcg"), gain("ideal").alias("best")).where("best > 0")
    return per.agg(F.avg(F.col("dcg") / F.col("best")).alias("ndcg"), F.count(F.lit(1)).alias("episodes"))


def rank_metrics(df: DataFrame, k: int = 3, episode: str = "episode_id", score: str = "score", label: str = "label", tie: str = "candidate_id") -> DataFrame:
    """top-1, hit@k and MRR over episodes that have a positive."""
    first = _ranked(df, episode, score, tie).groupBy(episode).agg(F.min(F.when(F.col(label) > 0, F.col("rank"))).alias("r")).where("r is not null")
    return first.agg(F.avg((F.col("r") == 1).cast("double")).alias("top1"), F.avg((F.col("r") <= k).cast("double")).alias("hit_k"), F.avg(1.0 / F.col("r")).alias("mrr"), F.count(F.lit(1)).alias("episodes"))


def brier(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), F.lit(2))).alias("brier"))


def reliability(df: DataFrame, bins: int = 10, label: str = "label", p: str = "p") -> DataFrame:
    """bin, n, mean probability and mean label."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("mean_y"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))), F.sum("n")).alias("ece"))


def abstention_quality(df: DataFrame, p: str = "p", label: str = "label", episode: str = "episode_id") -> DataFrame:
    """AUC of an episode's best probability for whether it has a true driver at all."""
    per = df.groupBy(episode).agg(F.max(p).alias("score"), F.max(label).alias("label"))
    return auc(per).withColumnRenamed("auc", "abstention_auc")


def by_driver_type(df: DataFrame, episode: str = "episode_id", score: str = "score", label: str = "label", kind: str = "driver_type", tie: str = "candidate_id") -> DataFrame:
    """top-1 by the type of the episode's true driver."""
    r = _ranked(df, episode, score, tie)
    per = r.groupBy(episode).agg(F.min_by(kind, F.when(F.col(label) > 0, F.col("rank"))).alias("true_type"), F.min(F.when(F.col(label) > 0, F.col("rank"))).alias("first")).where("first is not null")
    return per.groupBy("true_type").agg(F.avg((F.col("first") == 1).cast("double")).alias("top1"), F.count(F.lit(1)).alias("episodes"))


def candidate_recall(candidates: DataFrame, truth: DataFrame, episode: str = "episode_id", kind: str = "driver_type") -> DataFrame:
    """By true type: share of episodes whose candidates have it."""
    hit = truth.join(candidates.select(episode, kind).distinct().withColumn("hit", F.lit(1)), [episode, kind], "left")
    return hit.groupBy(kind).agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.count(F.lit(1)).alias("episodes"))


def time_split(df: DataFrame, train: float = 0.65, calib: float = 0.15, episode: str = "episode_id", at: str = "window_start") -> DataFrame:
    """df with `part`: whole episodes in order of time, the first `train` share to train, then calib, then test."""
    eps = df.groupBy(episode).agg(F.min(at).alias("_at"))
    eps = numbered(eps, ["_at", episode])
    n, order = eps.count(), F.col("before") + 1
    part = F.when(order <= F.lit(int(n * train)), "train").when(order <= F.lit(int(n * (train + calib))), "calib").otherwise("test")
    return df.join(eps.select(episode, part.alias("part")), episode)


def calibration_metrics(df: DataFrame, label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """One row: brier, ece and n, from one pass over df and the few bins it leaves."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    table = df.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("p"), F.sum(label).alias("y"), F.sum(F.pow(F.col(p) - F.col(label), F.lit(2))).alias("e"))
    return table.agg(F.try_divide(F.sum("e"), F.sum("n")).alias("brier"), F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def compare(df: DataFrame, arms: dict[str, str], k: int = 3, label: str = "label") -> DataFrame:
    """arm, ndcg, top1, hit_k, mrr, episodes of several scores (arm to column) over the same candidates."""
    out = None
    for arm, column in arms.items():
        row = rank_metrics(df, k, score=column, label=label).crossJoin(ndcg(df, k, score=column, label=label).select("ndcg")).select(F.lit(arm).alias("arm"), "ndcg", "top1", "hit_k", "mrr", "episodes")
        out = row if out is None else out.unionByName(row)
    return out
