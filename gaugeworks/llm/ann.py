"""Nearest neighbours by inner product: inverted lists and an adaptive scan of rotated dimensions.

Directions are dealt to lists of near centroids, split by the vectors' lengths. A query first scans
one block or so of its best lists, which bounds its k-th score from below, then more lists in growing
waves that raise the bound; with it the last scan leaves out the lists that are unlikely to hold more than a small share of its neighbours. Inside a probed
list vectors are stored rotated at random, in blocks of columns: after each block a candidate goes
if its partial distance says that it is beyond the bound, by the law of the squared length that a
random rotation puts into so many columns. What is left is scored exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import Scratch, table

#: Rows that the centroids are fitted on at most, those of least hash; every row is indexed.
FIT_ROWS = 16_384
#: Vectors a list should have, and how many lists at most (before lists are split by length).
LIST_ROWS, LISTS = 2_048, 1_024
#: Lists are split by the power of two of the length, from so many below the median to so many above.
BANDS = 8
#: Vectors in a block of a list, queries in a block of a list's queries, and their components at most.
BLOCK, BLOCK_VALUES = 1_024, 1 << 18
#: Candidates that the first scan of a query sees at least, where its lists hold so many; each further
#: scan before the last sees so many times more, so that scores above the bound stay few however many rows.
SEEDS, WAVE = 1_024, 4
#: Share of a query's neighbours that the lists it leaves out may be expected to hold.
LOST_LISTS = 0.01
#: Factor on the spread of a list's scores, for lists whose vectors are not spread alike everywhere.
SPREAD = 1.15
#: Chance that one test gives up a candidate beyond the bound, and blocks of columns.
LOST_TEST, COLUMN_BLOCKS = 1e-3, 4
#: Share of pairs still open from which the next columns are multiplied for all pairs.
DENSE = 0.08
#: Relative slack of single precision.
SLACK = 1e-5


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 20_240_229) -> np.ndarray:
    """A random rotation of d dimensions, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def columns(d: int) -> list[int]:
    """Ends of the blocks of columns."""
    return sorted({max(1, round(d * (k + 1) / COLUMN_BLOCKS)) for k in range(COLUMN_BLOCKS)} | {d})


def length_bounds(d: int, lost: float = LOST_TEST) -> list[float]:
    """For each block end m < d: the share of the squared length in the first m of d randomly rotated
    columns that is passed with chance `lost`: the upper quantile of Beta(m / 2, (d - m) / 2)."""
    out = []
    x = (np.arange(200_000) + 0.5) / 200_000
    for m in columns(d):
        if m == d:
            out.append(1.0)
            continue
        a, b = m / 2, (d - m) / 2
        density = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        upper = np.cumsum(density[::-1])[::-1] / density.sum()
        out.append(float(x[min(np.searchsorted(-upper, -lost), len(x) - 1)]))
    return out


@dataclass
class Model:
    """What tasks need to know of the lists: broadcast, and bounded by LISTS and BANDS."""

    d: int
    middle: int
    centroids: np.ndarray
    spread: np.ndarray
    keys: np.ndarray | None = None
    rows: np.ndarray | None = None
    splits: np.ndarray | None = None
    longest: np.ndarray | None = None
    scatter: np.ndarray | None = None

    def lists(self, units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """List of each vector: nearest centroid, then the band of its length."""
        near = np.concatenate([(units[i : i + 4096] @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(units), 4096)]) if len(units) else np.zeros(0, np.int64)
        return near * (2 * BANDS + 1) + np.clip(np.frexp(lengths)[1] - self.middle, -BANDS, BANDS) + BANDS

    def reach(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean cosine of each query with each list, and the spread about it."""
        mean = (units @ self.centroids.T)[:, self.keys // (2 * BANDS + 1)]
        along = np.sqrt(np.maximum(((units @ self.spread) * units).sum(axis=1), 1e-12))
        return mean, SPREAD * along[:, None] * self.scatter[None, :]


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow."""
    top = np.abs(x).max(axis=1, initial=0.0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))


def vectors(frame: DataFrame, key: str, column: str) -> DataFrame:
    """r (a key of the row), id, v (doubles) of the rows that take part: id and vector not null, all
    components finite numbers, not all of them zero."""
    v = F.col(column).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = frame.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(~odd & F.exists("v", lambda x: x != 0))
    return rows.withColumn("r", F.monotonically_increasing_id()).select("r", "id", "v")


def fit(rows: DataFrame, total: int) -> Model:
    """Centroids of unit vectors by Lloyd's method on a bounded sample, of the least hashes."""
    sample = rows.orderBy(F.xxhash64(F.lit(7), "id"), "id", "r").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    x = np.asarray(sample.values, dtype=np.float64).reshape(len(sample), -1)
    lengths = _lengths(x)
    units = x / lengths[:, None]
    k = int(np.clip(total // LIST_ROWS, 1, min(LISTS, max(1, len(x) // 8))))
    centroids = units[np.random.default_rng(11).permutation(len(units))[:k]]
    for _ in range(12):
        near = (units @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
        many = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        centroids = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centroids)
    rest = units - centroids[near]
    mean = (rest**2).sum() / len(rest)
    # the mean residual covariance for a list whose mean squared residual is 1
    return Model(x.shape[1], int(np.median(np.frexp(lengths)[1])), centroids, rest.T @ rest / len(rest) / max(mean, 1e-12))


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _assigned(rows: DataFrame, model: Model) -> DataFrame:
    """r, id, v, list, length, off (squared distance of the direction from its centroid)."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), model.d)
            lengths = _lengths(x)
            units = x / lengths[:, None]
            at = model.lists(units, lengths)
            off = ((units - model.centroids[at // (2 * BANDS + 1)]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(lengths), pa.array(off)], names=["r", "id", "v", "list", "length", "off"])

    return rows.mapInArrow(run, "r long, id long, v array<double>, list int, length double, off double")


def _measured(assigned: DataFrame, model: Model) -> Model:
    """The model with rows, length and scatter of each list: one row a list comes to the driver."""
    t = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.avg("off").alias("off")).orderBy("list").toArrow()
    model.keys, model.rows = np.asarray(t.column("list")).astype(np.int64), np.asarray(t.column("n"))
    model.splits = -(-model.rows // _block(model.d))
    model.longest, model.scatter = np.asarray(t.column("longest")), np.sqrt(np.maximum(np.asarray(t.column("off")), 1e-12))
    return model


def _block(d: int) -> int:
    return max(16, min(BLOCK, BLOCK_VALUES // d))


class _Stacks:
    """Rows gathered by key, given out in blocks; the fullest go first where too many wait."""

    def __init__(self, size: int) -> None:
        self.size, self.waiting, self.stacks = size, 0, {}

    def add(self, key: int, part: tuple):
        held = self.stacks.setdefault(key, [])
        held.append(part)
        self.waiting += len(part[0])
        if sum(len(p[0]) for p in held) >= self.size:
            yield from self.give(key)
        elif self.waiting >= 64 * self.size:
            yield from self.give(max(self.stacks, key=lambda k: sum(len(p[0]) for p in self.stacks[k])))

    def give(self, key: int):
        parts = [np.concatenate(x) for x in zip(*self.stacks.pop(key), strict=True)]
        self.waiting -= len(parts[0])
        for i in range(0, len(parts[0]), self.size):
            yield key, [p[i : i + self.size] for p in parts]

    def rest(self):
        for key in sorted(self.stacks):
            yield from self.give(key)


_STORED = "list int, split int, block long, rs binary, ids binary, original binary, rotated binary, lengths binary"
_STORED_NAMES = ["list", "split", "block", "rs", "ids", "original", "rotated", "lengths"]


def _stored(assigned: DataFrame, model: Model) -> DataFrame:
    """The lists' blocks. A list's rows are dealt to splits of a block's size each, so a list that
    holds much of the table is many keys."""
    size = _block(model.d)
    splits = np.ones(LISTS * (2 * BANDS + 1), dtype=np.int64)
    splits[model.keys] = model.splits

    def dealt(batches):
        for b in batches:
            many = splits[np.asarray(b.column(3))]
            r = np.asarray(b.column(0)).astype(np.uint64)
            part = ((r * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(part.astype(np.int32))], names=["r", "id", "v", "list", "length", "split"])

    def run(batches):
        turn, stacks, number = rotation(model.d), _Stacks(size), TaskContext.get().partitionId() << 40
        ends = columns(model.d)

        def out(given):
            nonlocal number
            for key, (r, ids, x, lengths) in given:
                turned = ((x / lengths[:, None]) @ turn).astype("<f4")
                # a block of columns at a time, each with the rows side by side
                blocks = b"".join(np.ascontiguousarray(turned[:, a:z].T).tobytes() for a, z in zip([0, *ends], ends, strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key >> 32, pa.int32()), (key & 0xFFFFFFFF, pa.int32()), (number, pa.int64()), (r.tobytes(), pa.binary()), (ids.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (blocks, pa.binary()), (lengths.tobytes(), pa.binary()))], names=_STORED_NAMES)
                number += 1

        for b in batches:
            r, ids, x, lengths = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), model.d), np.asarray(b.column(4))
            key = (np.asarray(b.column(3)).astype(np.int64) << 32) | np.asarray(b.column(5)).astype(np.int64)
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                yield from out(stacks.add(int(k), (r[at], ids[at], x[at], lengths[at])))
        yield from out(stacks.rest())

    spread = assigned.mapInArrow(dealt, "r long, id long, v array<double>, list int, length double, split int")
    return spread.repartition("list", "split").mapInArrow(run, _STORED)


def _probes(queries: DataFrame, model: Model, k: int, seeds: int | None = None) -> DataFrame:
    """The queries in blocks by probed list: list, splits, part (a number of the block), rs, ids, original, bounds.

    With seeds, a query's most promising lists until they hold so many rows. Without, lists by falling
    expected number of rows above the bound, until the rest is expected to hold LOST_LISTS of k; a list
    whose longest vector cannot reach the bound is never probed.
    """

    size = _block(model.d)

    def chosen(units, lengths, bounds):
        mean, spread = model.reach(units)
        if seeds:
            order = np.argsort(-(mean + spread) * model.longest[None, :], axis=1, kind="stable")
            # the first scan reads one block of a list
            seen = np.cumsum((np.minimum(model.rows, size) if seeds == SEEDS else model.rows)[order], axis=1)
            take = np.concatenate((np.ones((len(units), 1), bool), seen[:, :-1] < seeds), axis=1)
        else:
            # below a bound that is not positive even the shortest vectors count
            need = np.where(bounds[:, None] > 0, (bounds / lengths)[:, None] / model.longest[None, :], float("-inf"))
            hits = np.where(need > 1 + SLACK, 0.0, model.rows[None, :] * _upper((need - mean) / spread))
            order = np.argsort(-hits, axis=1, kind="stable")
            ranked = np.take_along_axis(hits, order, axis=1)
            after = np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1]
            take = (after > LOST_LISTS * k) & (ranked > 0)
        row, col = np.nonzero(take)
        return row, order[row, col]

    def run(batches):
        stacks, number = _Stacks(size), TaskContext.get().partitionId() << 32

        def out(given):
            nonlocal number
            for key, (r, ids, x, bounds) in given:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((int(model.keys[key]), pa.int32()), (int(model.splits[key]), pa.int32()), (number, pa.int64()), (r.tobytes(), pa.binary()), (ids.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (bounds.tobytes(), pa.binary()))], names=["list", "splits", "part", "q_rs", "q_ids", "q_original", "bounds"])
                number += 1

        for b in batches:
            r, ids, x, bounds = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), model.d), np.asarray(b.column(3))
            lengths = _lengths(x)
            for lo in range(0, len(r), 256):
                s = slice(lo, lo + 256)
                row, col = chosen(x[s] / lengths[s, None], lengths[s], bounds[s])
                row += lo
                for key in np.unique(col):
                    at = row[col == key]
                    yield from out(stacks.add(int(key), (r[at], ids[at], x[at], bounds[at])))
        yield from out(stacks.rest())

    return queries.select("r", "id", "v", "bound").mapInArrow(run, "list int, splits int, part long, q_rs binary, q_ids binary, q_original binary, bounds binary")


def _upper(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, absolute error 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-0.5 * np.minimum(z * z, 1400)) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, tail, 1 - tail)


_SCANNED = ["rs", "ids", "original", "rotated", "lengths", "q_rs", "q_ids", "q_original", "bounds"]


def _floats(value, dtype: str, d: int = 0) -> np.ndarray:
    x = np.frombuffer(value.as_buffer(), dtype=dtype)
    return x.reshape(-1, d) if d else x


def _scan(model_d: int, k: int):
    """A batch function: blocks of a list against blocks of queries; each query's k best of the block."""
    ends, bounds_of = columns(model_d), length_bounds(model_d)

    def scan(b, row):
        col = {n: b.column(i)[row] for i, n in enumerate(b.schema.names)}
        rs, ids, x, lengths = _floats(col["rs"], "<i8"), _floats(col["ids"], "<i8"), _floats(col["original"], "<f8", model_d), _floats(col["lengths"], "<f8")
        packed = _floats(col["rotated"], "<f4")
        q_rs, q_ids, q, bound = _floats(col["q_rs"], "<i8"), _floats(col["q_ids"], "<i8"), _floats(col["q_original"], "<f8", model_d), _floats(col["bounds"], "<f8")
        q_lengths = _lengths(q)
        turned = ((q / q_lengths[:, None]) @ rotation(model_d)).astype("<f4")
        # cosine that a pair needs, and the squared distance of directions that goes with it
        with np.errstate(over="ignore"):
            need = ((bound / q_lengths)[:, None] / lengths[None, :]).astype("<f4")
        open_ = need <= 1 + SLACK
        open_ &= q_rs[:, None] != rs[None, :]
        far = np.maximum(2 - 2 * need, 0) + SLACK
        i = j = None
        dot = np.zeros(need.shape, dtype="<f4")
        part_x, part_q = np.zeros(len(rs), dtype="<f4"), np.zeros(len(q_rs), dtype="<f4")
        start = 0
        for end, most in zip(ends, bounds_of, strict=True):
            cols = packed[start * len(rs) : end * len(rs)].reshape(end - start, len(rs))
            part_x, part_q = part_x + (cols**2).sum(axis=0), part_q + (turned[:, start:end] ** 2).sum(axis=1)
            if i is None:
                dot += turned[:, start:end] @ cols
                open_ &= part_q[:, None] + part_x[None, :] - 2 * dot <= far * np.float32(most)
                if open_.sum() <= DENSE * open_.size:
                    i, j = np.nonzero(open_)
                    dot, far = dot[i, j], far[i, j]
            elif len(i):
                dot = dot + np.einsum("ij,ij->i", turned[i, start:end], cols.T[j])
                on = part_q[i] + part_x[j] - 2 * dot <= far * np.float32(most)
                i, j, dot, far = i[on], j[on], dot[on], far[on]
            start = end
        if i is None:
            i, j = np.nonzero(open_)
        found = [[], [], [], [], []]
        # pairs are in order of queries: whole queries at a time
        cuts = np.searchsorted(i, np.arange(0, len(q_rs) + 64, 64))
        for a, z in zip(cuts, cuts[1:], strict=False):
            p, c = i[a:z], j[a:z]
            score = np.einsum("ij,ij->i", q[p], x[c])
            on = score >= bound[p]
            p, c, score = p[on], c[on], score[on]
            order = np.lexsort((rs[c], ids[c], -score, p))
            p, c, score = p[order], c[order], score[order]
            on = np.arange(len(p)) - np.searchsorted(p, p, "left") < k
            for held, new in zip(found, (q_rs[p[on]], q_ids[p[on]], rs[c[on]], ids[c[on]], score[on]), strict=True):
                held.append(new)
        return [np.concatenate(x) for x in found]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in scan(b, row)], names=["q_r", "query_id", "r", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_r").orderBy(F.col("score").desc(), "vec_id", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(frame: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product found for every row whose
    key is divisible by `every`, among all rows but itself; ties go to the smaller key.

    Takes no part: a row whose key or vector is null, whose vector is empty or zero or holds a null or
    a component that is not finite, or has another number of components than most vectors (of equally
    frequent numbers the largest counts). Repeated keys are rows of their own, candidates of each
    other. Other columns are not read; an empty table gives an empty result.
    """
    spark = frame.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    with Scratch(spark) as scratch:
        rows = scratch.write(vectors(frame, key, column), "vectors")
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        if not sizes:
            return spark.createDataFrame([], out)
        rows = rows.where(F.size("v") == sizes[0].d)
        model = fit(rows, sizes[0].n)
        assigned = scratch.write(_assigned(rows, model), "assigned")
        model = _measured(assigned, model)
        lists = scratch.write(_stored(assigned, model), "lists")
        queries = rows.where(F.col("id") % every == 0)
        scan = _scan(model.d, k)
        schema = "q_r long, query_id long, r long, vec_id long, score double"

        bounds, held, seeds = queries.withColumn("bound", F.lit(float("-inf"))), None, SEEDS
        while True:
            last = seeds > SEEDS and 2 * seeds > sizes[0].n
            probes = _probes(bounds, model, k, None if last else seeds)
            if seeds == SEEDS:
                # each block of queries reads one block of the list, so that the queries of a large list are dealt over its blocks
                probes = probes.withColumn("split", F.expr("CAST(pmod(part, splits) AS INT)"))
            else:
                probes = probes.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
            found = lists.join(probes, ["list", "split"]).select(*_SCANNED).mapInArrow(scan, schema)
            best = _best(found if held is None else found.unionByName(held.drop("rank")).dropDuplicates(["q_r", "r"]), k)
            if last:
                break
            before, held = (bounds, held), scratch.write(best, "best")
            least = held.groupBy(F.col("q_r").alias("r")).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
            bounds = scratch.write(queries.join(least, "r", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), "bounds")
            scratch.drop(*[x for x in before if x is not None])
            seeds *= WAVE
        best = best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return scratch.keep(best, "neighbours")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"))
