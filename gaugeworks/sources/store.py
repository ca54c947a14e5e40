"""Tables that are made once and read many times: in the folder that the session shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stored frames by application, input folder, name and the state of the folder's files.
_KEPT: dict[tuple[str, str, str, str], tuple[str, object]] = {}
#: Lists of the tables written since each open scope began.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master without it gets a folder of its own, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeworks-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this session: it goes when the scope ends in which it was made, or else with
    the session's process (the file system deletes it then)."""
    path = f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    return path


@contextmanager
def scope(spark: SparkSession):  # noqa: ANN201
    """Drops, at its end, every table written inside but for those that are kept for the session: for callers
    who have written or collected what they asked for."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]
        held = {path for path, _ in _KEPT.values()}
        for path in paths:
            if path not in held:
                target, fs = _path(spark, path)
                fs.delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: what several branches of a plan read, they read once.

    This runs a job when a plan is built. The table lasts as scratch_path says."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, folder: str) -> str:
    """What tells whether the tables of a folder have changed: files, bytes and the latest change of each table."""
    target, fs = _path(spark, folder)
    total = fs.getContentSummary(target)
    return f"{total.getFileCount()}/{total.getLength()}/" + ",".join(str(x.getModificationTime()) for x in fs.listStatus(target))


def kept(spark: SparkSession, sf_dir: str, name: str, make, order: str, also: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """The frame of make(), stored at its first use in this application, in ranges of `order`: files hold
    disjoint ranges of it (and of `also` within equal values, so a peak day is not one file), so a filter
    on it skips files and row groups by their statistics. When the
    folder's files have changed it is made anew."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _KEPT:
        df = make()
        path = scratch_path(spark, name)
        df.repartitionByRange(order, *also).sortWithinPartitions(order).write.parquet(path)
        for old in [k for k in _KEPT if k[:3] == key[:3]]:
            del _KEPT[old]
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """df with `before`: how many rows (or how much of weight) come before each row in the order of
    some columns, over all rows.

    Rows are dealt to ranges of the order and written; a row count a range (as many as partitions)
    gives each range its offset, and a window runs within one range at a time."""
    parted = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    amount = F.col(weight) if weight else F.lit(1)
    totals = parted.groupBy("_range").agg(F.sum(amount).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return parted.join(F.broadcast(offsets), "_range").withColumn("before", F.col("_offset") + within).drop("_range", "_offset")
