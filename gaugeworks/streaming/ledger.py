"""Streams that notice silence, and daily totals that late and repeated rows cannot spoil."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def silences(events: DataFrame, source: str, sla_minutes: int, late: str = "0 seconds") -> DataFrame:
    """source, last, due, ended: a row for each time that a source sent nothing for longer than its limit.

    events: ts and a source column. A timer of event time runs for each source from its last event: it goes
    off when the others' events carry the watermark past it, so a source that falls silent is reported
    without a batch of its own (ended is null then); a gap that lies inside one batch is reported with
    its end. Each silence is reported once. State is two numbers a source."""
    limit = pd.Timedelta(minutes=sla_minutes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((last, None))
            told = True
        else:
            for t in sorted(t for f in frames for t in f["ts"]):
                if last is not None and t - last > limit and not told:
                    out.append((last, t))
                if last is None or t > last:
                    last, told = t, False
        state.update((last.value // 1000, told))
        if not told:
            due = (last + limit).value // 1_000_000
            state.setTimeoutTimestamp(max(due + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"source": [key[0]] * len(out), "last": [a for a, _ in out], "due": [a + limit for a, _ in out], "ended": pd.Series([z for _, z in out], dtype="datetime64[ns]")})

    known = events.withWatermark("ts", late).select(F.col(source).cast("string").alias("source"), "ts")
    return known.groupBy("source").applyInPandasWithState(step, "source string, last timestamp, due timestamp, ended timestamp", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


class Ledger:
    """Daily totals of an event stream in a shared folder, right however late or often rows arrive.

    Every batch writes what it adds under its own number and overwrites that alone, so a batch that is run
    again after a failure changes nothing. Rows behind the watermark are added like others, and are kept
    in a side table too. An event counts once, by event_id and day: ids of a day are looked up on that day."""

    def __init__(self, spark: SparkSession, path: str, late: timedelta = timedelta(days=2)) -> None:
        self.spark, self.path, self.late = spark, path.rstrip("/"), late

    def _table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col("batch") < before)

    _DELTAS = "d date, event_type string, late boolean, n long, v double, latest timestamp, batch long"
    _IDS = "event_id long, batch long, d date"
    _LATE = "event_id long, ts timestamp, event_type string, value double, batch long"

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: events (event_id, ts, event_type, value) of one batch."""
        latest = self._table("deltas", self._DELTAS, number).agg(F.max("latest")).first()[0]
        rows = batch.select("event_id", "ts", "event_type", "value", F.to_date("ts").alias("d")).dropDuplicates(["event_id", "d"])
        rows = rows.join(self._table("ids", self._IDS, number).select("event_id", "d"), ["event_id", "d"], "left_anti")
        rows = rows.withColumn("late", F.lit(False) if latest is None else F.col("ts") < F.lit(latest - self.late)).persist()
        put = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/batch={number}") if by else df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        put(rows.where("late").select("event_id", "ts", "event_type", "value"), "late")
        put(rows.groupBy("d", "event_type", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("ts").alias("latest")), "deltas")
        # last: a batch that fails before this is run again with its own ids still unknown
        put(rows.select("event_id", "d"), "ids", "d")
        rows.unpersist()

    def run(self, events: DataFrame, checkpoint: str):
        """The stream that keeps the ledger, over all that is there."""
        return events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def totals(self) -> DataFrame:
        """d, event_type, n, v, n_late."""
        return self._table("deltas", self._DELTAS).groupBy("d", "event_type").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))

    def late_rows(self) -> DataFrame:
        return self._table("late", self._LATE)
