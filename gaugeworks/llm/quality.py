"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import ASCII_LOWER, table, text_bytes, word_hashes
from gaugeworks.ml.gbdt import BoostedTrees, FlatTrees

#: Labelled rows that the trees are fitted on, at most (those of least hash).
TRAIN_ROWS = 40_000
#: A document is kept from this probability on.
KEEP_FROM = 0.3

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "upper", "lower", "digit", "non_ascii",
    "space", "exclaim", "percent_amp", "star_hash", "dollar", "pipe", "other_punct", "full_stop", "distinct_words",
    "top_word", "adjacent_repeats", "lines_per_word", "distinct_lines", "short_words", "capital_starts",
)
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def statistics(data: np.ndarray) -> np.ndarray:
    """The statistics of one whole text (UTF-8 bytes), in the order of FEATURES; zeros if empty."""
    n = len(data)
    if n == 0:
        return np.zeros(len(FEATURES))
    c = np.bincount(data, minlength=256)
    share = lambda *codes: c[list(codes)].sum() / n
    words, starts, ends = word_hashes(ASCII_LOWER[data])
    k = max(1, len(words))
    sizes = (ends - starts).astype(float) if len(words) else np.zeros(1)
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.ones(1)
    lines = word_hashes(data, _NEWLINE)[0]
    capitals = ((data[starts] >= 65) & (data[starts] <= 90)).mean() if len(words) else 0.0
    return np.array([
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), c[65:91].sum() / n,
        c[97:123].sum() / n, c[48:58].sum() / n, c[128:].sum() / n, share(32), share(33), share(37, 38),
        share(42, 35), share(36), share(124), share(*range(58, 65), *range(91, 97), 34, 39, 40, 41, 43, 45, 47),
        share(46), len(counts) / k, counts.max() / k, (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0,
        len(lines) / k, len(np.unique(lines)) / max(1, len(lines)), (sizes <= 3).mean(), capitals,
    ])


def _stack(texts: list) -> np.ndarray:
    """Statistics of several texts (bytes; None counts as empty), a row each, in the precision kept."""
    empty = np.zeros(0, dtype=np.uint8)
    rows = [statistics(empty if t is None else t) for t in texts]
    return (np.stack(rows) if rows else np.zeros((0, len(FEATURES)))).astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; null texts count as empty."""

    def run(batches):
        for b in batches:
            stats = pa.FixedSizeListArray.from_arrays(pa.array(_stack(text_bytes(b.column(1))).ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), stats], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


def held_out(doc_id) -> F.Column:
    """Rows never trained on: crc32 of the id's text divisible by 5; a missing id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> FlatTrees:
    """Trees for P(quality = 1), from labelled rows outside the held-out fold.

    Several labels of a document count as their mean; null labels are ignored. The labelled ids of
    least hash, max_rows at most (so they are broadcast), are chosen before their texts are read.
    Without usable labels the model is a constant: the base rate, or one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    stats = document_statistics(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("stats", "quality").toArrow()
    y = np.asarray(rows.column("quality"), dtype=float)
    x = np.array(rows.column("stats").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    return BoostedTrees(rounds=60, depth=4, rate=0.15, min_leaf=10, min_child_weight=1.0).fit(x, y)


def apply(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    trees = model.to_json()

    def run(batches):
        flat = FlatTrees.from_json(trees)
        for b in batches:
            x = _stack(text_bytes(b.column(1))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat.probability(x))], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document.

    One row per input row: doc_id, held_out, score, predicted. Empty and null texts are scored on
    zero statistics; repeated rows are scored alike; without labels every score is the prior; extra
    columns are ignored; an empty table gives no rows.
    """
    return apply(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns of docs unchanged, whatever their names.
    Empty and null texts are scored on zero statistics; repeated rows are judged alike; an empty table
    gives no rows."""
    trees, at = fit(docs, labels).to_json(), docs.columns.index("text")

    def run(batches):
        flat = FlatTrees.from_json(trees)
        for b in batches:
            x = _stack(text_bytes(b.column(at))).astype(np.float64)
            yield b.filter(pa.array(flat.probability(x) >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the classifier never learns from."""
    return table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"))
