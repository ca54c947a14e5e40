"""Shared helpers: table access, shared scratch tables and vectorised token hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x09-0x0D and 0x20 separate words.
WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_array(values: list, suffix: str) -> Column:
    """A constant array as one folded literal (suffix: L for bigint, D for double)."""
    return F.expr("array(" + ",".join(f"{v}{suffix}" for v in values) + ")")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir).

    Only a local master without that setting gets a folder of its own, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeworks-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the queries inside go when each query ends (Spark's own setting); else they
    stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once as Parquet into the shared folder and read it back: cuts the lineage and
    survives the loss of any executor. Returns the frame and its path (see drop_scratch)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Lists of the scratch tables written since each open scope began.
_OPEN: list[list[str]] = []


class Scratch:
    """The scratch tables of one operator or stage: all are dropped at the end, but for those that
    its result reads (keep). Whoever has written the result drops these (see scope)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*list(self.paths.values()))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        frame, path = materialise(df, name)
        self.paths[path] = frame
        return frame

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name)[0]

    def drop(self, *frames: DataFrame) -> None:
        for path in [p for p, f in self.paths.items() if any(f is x for x in frames)]:
            drop_scratch(self.spark, path)
            del self.paths[path]


@contextmanager
def scope(spark: SparkSession):
    """Drops, at its end, every scratch table written inside (the list it yields): for callers who
    have written what they need."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]
        for path in paths:
            drop_scratch(spark, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more; nothing happens if it is gone."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unpacked(docs: DataFrame, name: str = "row", **other: Column) -> list[Column]:
    """The columns of whole_row again, some of them replaced."""
    return [other.get(c, F.col(name).getField(c)).alias(c) for c in docs.columns]


def bit_filter(slots: DataFrame, bits: int) -> np.ndarray:
    """slots: s below `bits`. A packed bit array with every slot set, for a broadcast.

    Executors put slots together in words of 32 bits, so at most bits / 32 rows come to the driver
    whatever the input; a filter only lets rows through, and joins decide.
    """
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(31)).cast("int")))
    rows = slots.groupBy(F.shiftright("s", 5).cast("int").alias("cell")).agg(word.alias("v")).toArrow()
    out = np.zeros(bits // 32, dtype="<u4")
    out[np.asarray(rows.column("cell"))] = np.asarray(rows.column("v")).astype(np.uint32)
    return out.view(np.uint8)


def passes(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each slot is set in a filter."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(12, n - 1).bit_length() if n > 1 else 4096
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            if base == _BASE:
                _POWERS = np.cumprod(steps, dtype=np.uint64)
            else:
                _INVERSES = np.cumprod(steps, dtype=np.uint64)
    return _POWERS, _INVERSES


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every maximal run of non-space bytes.

    A prefix sum of bytes times powers of an odd base gives any word's polynomial as a
    difference, times the inverse power of its start: no loop over words.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    bounds = np.concatenate(([0], edge, [n])) if not gap[0] else np.concatenate((edge, [n]))
    if gap[-1]:
        bounds = bounds[:-1] if len(bounds) % 2 else bounds
    starts, ends = bounds[0 : len(bounds) // 2 * 2 : 2], bounds[1::2]
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverses[starts]
    return mix64(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of `size` words; the whole sequence when it is shorter."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out + np.uint64(size)))


def text_bytes(column) -> list[np.ndarray | None]:
    """Byte views of an Arrow string column, without copies; None for null."""
    return [np.frombuffer(x.as_buffer(), dtype=np.uint8) if x.is_valid else None for x in column]


def binary_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of data (bytes) of the given sizes as an Arrow binary column, without a loop."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column without nulls, and the size of each piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, np.diff(ends).astype(np.int64)
