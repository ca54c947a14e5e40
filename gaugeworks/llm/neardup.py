"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.components import connected_components
from gaugeworks.llm.shared import ASCII_LOWER, Scratch, bit_filter, mix64, passes, shingle_hashes, table, text_bytes, word_hashes

#: A pair with similarity 0.8 shares one of BANDS bands of ROWS values but for (1 - 0.8**ROWS)**BANDS = 1e-7.
ROWS, BANDS = 6, 53
HASHES = ROWS * BANDS
#: Signature values compared at a time, and the posterior probability below which a pair is given up.
BATCH, MISS = 53, 1e-6
#: Link from intersection * 100 >= PERCENT * union.
PERCENT = 80
#: In buckets of more documents, how many shingles each has alone, and of the common ones, bounds what a pair can share.
CROWD = 32
#: Cells of a set's parities: two sets differ in at least as many members as cells. A power of two, 64 at least.
CELLS = 1024
#: Parts that the classes of a component are dealt to when they get its least document.
PARTS = 32
#: Bits of the broadcast filter of documents that exact verification reads (4 MB): bounded, only a filter.
FILTER_BITS = 1 << 25

_MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSETS = mix64(np.arange(7_000, 7_000 + HASHES, dtype=np.uint64))


def shingle_set(data: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of a text's bytes, sorted; A-Z count as a-z."""
    return shingle_hashes(word_hashes(ASCII_LOWER[data])[0], size)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each of HASHES minimum values."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[k : k + 2048, None] * _MULTIPLIERS + _OFFSETS).min(axis=0), out=least)
    return (mix64(least ^ _OFFSETS) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of CELLS cells of the hash holds an odd number of members, packed into longs."""
    cells = (shingles >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=CELLS) & 1).astype(np.uint8), bitorder="little").view("<i8")


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums of its mixed members."""
    with np.errstate(over="ignore"):
        one, two = mix64(shingles).sum(dtype=np.uint64), mix64(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "little") + int(two).to_bytes(8, "little")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For n compared values the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is
    P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h (hash of the text), n, c (set digest, null for an empty set), sig and bits (parities) of each whole text."""

    def run(batches):
        empty = np.zeros(0, dtype=np.uint8)
        for b in batches:
            sizes, digests, signatures, bits = [], [], [], []
            for data in text_bytes(b.column(2)):
                s = shingle_set(empty if data is None else data, size)
                sizes.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
                bits.append(parities(s))
            flat = pa.array(np.concatenate(bits) if bits else np.zeros(0, dtype=np.int64), pa.int64())
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (CELLS // 64)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), packed], names=["doc_id", "h", "n", "c", "sig", "bits"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, n long, c binary, sig binary, bits array<long>")


def survivors(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, matches of the pairs that sequential Bayesian comparison of signatures leaves.

    Pairs whose set sizes rule out the threshold go first; then BATCH values at a time are compared,
    and a pair goes as soon as the posterior chance of its reaching the threshold is below MISS.
    """
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    wide = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "sig_a", "sig_b")
    bounds = least_matches(percent)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u2").reshape(b.num_rows, HASHES) for k in (2, 3))
            rows, matches = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                matches[rows] += (x[rows, n - BATCH : n] == y[rows, n - BATCH : n]).sum(axis=1)
                rows = rows[matches[rows] >= bounds[n]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(matches[rows])], names=["a", "b", "matches"])

    return wide.mapInArrow(run, "a long, b long, matches long")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """id and members (its whole set, packed) of some classes.

    Sets are built from one text of each of these classes alone (that of least hash, h): a bit filter of
    bounded size, broadcast, lets those through (and few others); joins then match them exactly.
    """
    spark = docs.sparkSession
    wanted = scratch.write(classes.join(ids, "id").select("id", "c", "h"), "verify")
    shared = spark.sparkContext.broadcast(bit_filter(wanted.select(F.pmod("h", F.lit(FILTER_BITS)).alias("s")), FILTER_BITS))

    def run(batches):
        packed = shared.value
        for b in batches:
            rows = pa.array(np.flatnonzero(passes(packed, np.asarray(b.column(0)) & (FILTER_BITS - 1))))
            sets = [shingle_set(t, size) if t is not None else np.zeros(0, dtype=np.uint64) for t in text_bytes(b.column(1).take(rows))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h", "c", "members"])

    text = F.col("text").cast("string")
    sets = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "h long, c binary, members binary")
    found = scratch.write(wanted.join(sets, ["h", "c"]).select("id", "members").dropDuplicates(["id"]), "verify-sets")
    scratch.drop(wanted)
    return found


def crowd_profile(members: DataFrame, scratch: Scratch) -> DataFrame:
    """id, own and core: how many members of each set are in no other of these sets, and in over CROWD."""

    def run(batches):
        for b in batches:
            sets = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), [len(x) for x in sets])), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["id", "h"])

    rows = members.mapInArrow(run, "id long, h long")
    counts = scratch.write(rows.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")).where(f"k = 1 OR k > {CROWD}"), "crowd-shingles")
    own = counts.where("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    core = rows.join(counts.where("k > 1").select("h"), "h", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("core"))
    return own.join(core, "id", "full")


def exact_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b of classes) whose full sets meet the threshold."""
    members = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, docs, size, scratch)
    one, two = (members.select(F.col("id").alias(k), F.col("members").alias(f"m_{k}")) for k in "ab")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared_ = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared_ * 100 >= percent * (len(p) + len(q) - shared_))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    links = scratch.write(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "m_a", "m_b").mapInArrow(compare, "a long, b long"), "links")
    scratch.drop(members)
    return links


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = PERCENT) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of `size` words (ASCII-lower-cased runs of non-space), or
    its whole sequence when shorter; documents without words have an empty set and are linked with
    nothing. Equal sets form a class. Classes that share a band are candidates: first each with three
    leaders of its bucket, of which the most similar is verified; then, between the components found so, all pairs of a bucket. In crowded buckets an
    exact bound on what a pair can share (crowd_profile) comes first, and in all of them an exact bound
    on how far a pair is apart (parities). So copies never meet all against all, and no link between different
    components that a band shows is left out. Candidates pass sequential Bayesian verification and are
    then compared on full sets.

    One row per input row. Repeated rows are copies of each other; a document without doc_id gets the
    least doc_id of its group (null if there is none); kept is true where doc_id is the component_id
    or both are null. Extra columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _grouped(docs, size, percent, scratch)


def _grouped(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    sets = scratch.write(document_sets(docs, size), "shingle-sets")
    some = sets.where("c IS NOT NULL")
    merged = some.groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = scratch.write(merged.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    bands = classes.select("id", "n", band.alias("band"))
    pick = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "id"), F.struct("id", "n").alias("e")))["e"]
    leaders = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.array_distinct(F.array(F.min(F.struct("id", "n")), pick(1), pick(2))).alias("lead")).where("m > 1").select("band", "lead")
    buckets = scratch.write(bands.join(leaders, "band"), "buckets")
    sized = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = buckets.select("id", "n", F.explode("lead").alias("to")).where((F.col("id") != F.col("to.id")) & sized("n", F.col("to.n"))).select(*pair("id", F.col("to.id"))).distinct()

    def verify_best(candidates: DataFrame) -> DataFrame:
        """Links among each document's most similar candidate."""
        close = scratch.write(survivors(candidates, classes, percent), "close")
        best = close.groupBy("b").agg(F.max(F.struct("matches", "a"))["a"].alias("a")).unionByName(close.groupBy("a").agg(F.max(F.struct("matches", "b"))["b"].alias("b"))).select("a", "b").distinct()
        return exact_links(best, classes, docs, size, scratch, percent)

    found = verify_best(star)
    first = connected_components(found, scratch)
    labelled = scratch.write(buckets.select("band", "id", "n").join(first, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component")), "bucket-components")
    scratch.drop(buckets)
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), (F.count(F.lit(1)) > CROWD).alias("crowd")).where("lo < hi").select("band", "crowd")
    rest = scratch.write(labelled.join(mixed, "band").select("band", "id", "n", "component", "crowd"), "mixed-buckets")
    scratch.drop(labelled)
    crowded = rest.where("crowd").select("id").distinct()
    profile = crowd_profile(full_sets(crowded, classes, docs, size, scratch), scratch)
    only = lambda c: F.when(F.col("crowd"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
    rest = rest.join(profile, "id", "left").select("band", "id", "n", "component", only("own").alias("own"), only("core").alias("core"))
    rest = rest.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent).join(classes.select("id", "bits"), "id")
    other = rest.select("band", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "own", "core", "bits")])
    # a set's own members and its surplus of the crowd's core are not in the other set
    shared = F.least(F.col("n") - F.col("own") - F.greatest(F.lit(0), F.col("core") - F.col("core2")), F.col("n2") - F.col("own2") - F.greatest(F.lit(0), F.col("core2") - F.col("core")))
    reach = shared * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    # cells of different parity are members that only one of the sets has
    apart = F.expr(" + ".join(f"bit_count(bits[{k}] ^ bits2[{k}])" for k in range(CELLS // 64)))
    alike = apart * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)
    across = rest.join(other, "band").where((F.col("component") < F.col("component2")) & sized("n", "n2") & reach & alike).select(*pair("id", "id2")).distinct()
    more = scratch.write(survivors(across, classes, percent), "close")
    if more.limit(1).count():
        found = found.unionByName(exact_links(more, classes, docs, size, scratch, percent))
        first = connected_components(found, scratch)
    scratch.drop(rest)
    ends = classes.select("id", "c", "rep").join(first, "id", "left").select("id", "c", "rep", "component")
    grouped = ends.where("component IS NOT NULL")
    # a component may hold a third of all classes: its least document goes to them by a part of their id as well
    least = grouped.groupBy("component").agg(F.min("rep").alias("least")).select("component", "least", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    spread = grouped.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(least, ["component", "part"]).select("c", F.col("least").alias("component_id"))
    groups = spread.unionByName(ends.where("component IS NULL").select("c", F.col("rep").alias("component_id")))
    out = sets.select("doc_id", "n", "c").join(groups, "c", "left")
    own = F.coalesce("component_id", "doc_id")
    return scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")), "near-duplicates")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
