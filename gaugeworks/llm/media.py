"""Media columns: payloads stored as lossless WebP, read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import webp
from gaugeworks.llm.shared import table, text_bytes

UNIT = 64


def payload_of(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def features(images: list[np.ndarray]) -> str:
    """Size, channel means (in thousandths) and an 8-bin histogram of all samples of the images."""
    n = sum(p.size for p in images)
    counts = np.zeros((4, 256), dtype=np.int64)
    for p in images:
        samples = np.ascontiguousarray(p).view(np.uint8).reshape(-1, 4)
        for k in range(4):
            counts[k] += np.bincount(samples[:, k], minlength=256)
    means = [int(c @ np.arange(256)) * 1000 // n for c in counts]
    histogram = counts.sum(axis=0).reshape(8, 32).sum(axis=1)
    return f"px={n};rows={sum(len(p) for p in images)};mean_bgra={','.join(map(str, means))};hist={','.join(map(str, histogram))}"


#: Bytes of payloads that a task holds at a time.
HELD = 1 << 24


def _bounded(rows, size):  # noqa: ANN001
    """Lists of consecutive items of about HELD bytes."""
    held, total = [], 0
    for x in rows:
        held.append(x)
        total += size(x)
        if total >= HELD:
            yield held
            held, total = [], 0
    if held:
        yield held


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's payload as lossless WebP (see webp.store).

    Null texts count as empty and give one block of zero bytes; very long texts become several
    strips; a task holds about HELD bytes of payloads or one text; equal texts give equal bytes; repeated rows are kept;
    extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            rows = ((i, b"" if t is None else t.tobytes()) for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True))
            for part in _bounded(rows, lambda x: len(x[1])):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([len(t) for _, t in part], pa.int64()), pa.array([webp.store(payload_of(t)) for _, t in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """doc_id, strip, width, height and pixels (ARGB words) of every stored image."""

    def run(batches):
        for b in batches:
            for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                images = webp.load(blob) if blob else []
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [doc_id] * len(images), "strip": list(range(len(images))), "width": [p.shape[1] for p in images], "height": [p.shape[0] for p in images], "pixels": [p.ravel().view(np.int32) for p in images]},
                    schema=pa.schema([("doc_id", pa.int64()), ("strip", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int32()))]),
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, strip int, width int, height int, pixels array<int>")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, all computed from the bytes read back."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            out = []
            for blob in b.column(2):
                blob = blob.as_py()
                images = webp.load(blob)
                payload = webp.samples_of(images)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), features(images)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_column(table(spark, sf_dir, "documents")))
