"""Structured Streaming counterparts: freshness, windowed series, late rows, breach runs, duplicates, priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators.feedback import ACCEPT, CAP, FLOOR, REJECT


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream; the stored timestamps have no zone, and watermarks need one."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling days; rows later than the watermark are left out, as rows after the decision are."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.to_date("w.start").alias("d"), "event_type", "n", "v")


def sliding_totals(events: DataFrame, length: str = "14 days", step: str = "7 days", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("ws"), F.col("w.end").alias("we"), "v", "n")


def breach_runs(breaches: DataFrame, gap: str = "2 days", late: str = "2 days") -> DataFrame:
    """Runs of breach days of a slice; a run bridges one day without a breach (see causal.effect_onset)."""
    return breaches.withWatermark("ts", late).groupBy("slice", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("days")).select("slice", F.to_date("w.start").alias("onset"), "days")


def without_duplicates(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def freshness(events: DataFrame, sla_minutes: int, sink: list, now: str, every: str | None = None):
    """A writer (every: its polling interval, such as `30 seconds`) that keeps the latest event time and flags a breached limit, batch by batch."""

    def update(batch: DataFrame, batch_id: int) -> None:
        latest = batch.agg(F.max("ts").alias("t")).first()["t"]
        known = max([x["latest"] for x in sink if x["latest"] is not None] + ([latest] if latest is not None else []), default=None)
        lag = None if known is None else (pd.Timestamp(now) - pd.Timestamp(known)).total_seconds() / 60
        sink.append({"batch": batch_id, "latest": known, "lag_minutes": lag, "breached": lag is None or lag > sla_minutes})

    writer = events.writeStream.foreachBatch(update)
    return writer.trigger(processingTime=every) if every else writer


def prior_updates(feedback: DataFrame) -> DataFrame:
    """metric, hypothesis_id, prior after each batch of grades, kept as state by key.

    A batch's grades of a key come in several frames, in no order across them: those that change a prior are kept
    as two numbers (nine bytes) each and folded in order of seq, ties as in feedback.priors, after the last frame."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prior = state.get[0] if state.exists else 1.0
        decided = [(f["seq"].to_numpy(), (f["grade"] == "reject").to_numpy()) for f in (f[f["grade"].isin(("accept", "reject"))] for f in frames)]
        seq, rejected = (np.concatenate(x) for x in zip(*decided, strict=True))
        for down in rejected[np.lexsort((rejected, seq))]:
            prior = max(FLOOR, prior * REJECT) if down else min(CAP, prior * ACCEPT)
        state.update((prior,))
        yield pd.DataFrame({"metric": [key[0]], "hypothesis_id": [key[1]], "prior": [prior]})

    return feedback.groupBy("metric", "hypothesis_id").applyInPandasWithState(step, "metric string, hypothesis_id string, prior double", "prior double", "update", GroupStateTimeout.NoTimeout)
