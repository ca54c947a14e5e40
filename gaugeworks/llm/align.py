"""Alignment of two tokenisers: minimal groups of overlapping tokens, links, and counts of linked pairs.

Both tokenisers are given the same bytes, a space and the text. Tokens are the nodes of a bipartite
graph whose edges are overlaps in bytes; its connected components are the minimal groups that cover
the same bytes on either side. Texts are cut at places that neither tokeniser's tokens can cross,
so that each distinct segment is encoded and grouped once a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import Scratch, binary_array, binary_parts, table

try:  # where the vocabulary files lie by default; always parameters, never copied
    import public_tokenizers

    BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
except ModuleNotFoundError:
    BYTE_BPE = PIECE_BPE = ""

#: Segments in a block of documents, but for one longer text: what a task holds at once.
BLOCK_SEGMENTS = 1 << 20
#: Segments, and linked pairs, in a row of a block's tables.
CHUNK = 1 << 13
#: Characters of the segments that a task remembers before it forgets the rare ones.
KEPT_CHARS = 1 << 22

#: Spaces and what follows them up to the next space; spaces at the end go with what is before them.
_SEGMENT = re.compile(r"\x20+[^\x20]*(?:\x20+\Z)?")
#: Other white space before two spaces is one run for the byte tokeniser, which a cut would part.
_JOINED = re.compile(r"[^\S\x20]\x20\x20")
_SPACE = "▁"
#: Segments that keep their tokens when put together: one space, no other, and no white space at the end.
_PLAIN = re.compile(rf"\x20[^\x20{_SPACE}]*[^\s{_SPACE}]")


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for
    themselves, the others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component: union-find over all edges at once. Roots are hooked
    to the smaller root of an edge and paths halved until no edge joins two roots."""
    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def overlap_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component (from 0, in order of bytes) of each token of A and of B, by the ends of their byte ranges.

    Both sides cover the same bytes from 0 without gaps, and no range is empty.
    """
    starts_a = np.concatenate(([0], ends_a[:-1])) if len(ends_a) else ends_a
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    many = last - first + 1
    u = np.repeat(np.arange(len(ends_a)), many)
    v = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(many) else u
    root = components(len(ends_a) + len(ends_b), u, len(ends_a) + v)
    _, group = np.unique(root, return_inverse=True)
    return group[: len(ends_a)], group[len(ends_a) :]


class Aligner:
    """Segments to their groups and links; each distinct segment once while it is remembered."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of_char()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.written = _Written(max(len(names), len(pieces)))
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: no piece goes on into a space, so spaces after other characters begin a piece
        self.cuts = all(_SPACE not in x.lstrip(_SPACE) for x in pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.texts: list[bytes | None] = []
        #: by segment: tokens of A and B, groups, links; then the links themselves, and where each segment's end
        self.sizes = [np.zeros((0, 4), np.int64)]
        self.links, self.ends = array("q"), array("q")
        self.times = np.zeros(0, np.int64)

    def used(self, at: np.ndarray, times: np.ndarray) -> None:
        """Notes how often a block has some segments."""
        self.times = np.append(self.times, np.zeros(len(self.at) - len(self.times), np.int64))
        self.times[at] += times

    def forget(self, chars: int) -> None:
        """Keeps of the segments had more than once the most frequent ones, of so many characters; places change."""
        self.used(np.zeros(0, np.int64), np.zeros(0, np.int64))
        names = list(self.at)
        size = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-self.times, kind="stable")
        order = order[self.times[order] > 1]
        kept = np.sort(order[np.cumsum(size[order]) <= chars])
        links, many = self.links_of(kept)
        sizes, times, texts = np.concatenate(self.sizes)[kept], self.times[kept] // 2, [self.texts[i] for i in kept.tolist()]
        self.clear()
        self.at = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.chars, self.texts, self.sizes, self.times = int(size[kept].sum()), texts, [sizes], times
        self.links.frombytes(links.tobytes())
        self.ends.frombytes(np.cumsum(many).tobytes())

    def segments(self, text: str) -> list[str]:
        """Parts of space and text that no token of either side crosses."""
        text = " " + text
        return _SEGMENT.findall(text) if self.cuts and not _JOINED.search(text) else [text]

    def learn(self, segments: set[str]) -> None:
        """Encodes and groups the segments not known yet."""
        new = [s for s in segments if s not in self.at]
        plain = [s for s in new if _PLAIN.fullmatch(s)] if self.cuts else []
        odd = [s for s in new if not _PLAIN.fullmatch(s)] if self.cuts else new
        for kind, encoded in ((plain, self._together), (odd, self._apart)):
            for lo in range(0, len(kind), 8192):
                part = kind[lo : lo + 8192]
                self._add(part, *(encoded(part) or self._apart(part)))

    def _together(self, part: list[str]) -> tuple | None:
        """Tokens of A and B, how many each segment has, and that all give their bytes again: plain segments one after
        the other are encoded at once. None if a token goes over an end or the bytes differ."""
        whole = "".join(part)
        a, b = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.b.encode(whole[1:])
        if not b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == whole.encode():
            return None
        ends, out = np.cumsum(np.fromiter((len(s.encode()) for s in part), np.int64, len(part))), []
        for ids, size in ((np.array(a, np.int64), self.size_a), (np.array(b, np.int64), self.size_b)):
            end = np.cumsum(size[ids])
            at = np.searchsorted(end, ends)
            if (end[at] != ends).any():
                return None
            out.append((ids, np.diff(at, prepend=-1)))
        return *out[0], *out[1], np.ones(len(part), bool)

    def _apart(self, part: list[str]) -> tuple:
        """The same by segment; those whose bytes differ have no tokens."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in part], num_threads=1)
        name_a, name_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        ok = np.array([b"".join(map(name_a, x)) == b"".join(map(name_b, y)) == s.encode() for s, x, y in zip(part, ids_a, ids_b, strict=True)])
        a, b = (np.array([i for x, k in zip(ids, ok, strict=True) if k for i in x], np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter((len(x) if k else 0 for x, k in zip(ids, ok, strict=True)), np.int64, len(part)) for ids in (ids_a, ids_b))
        return a, n_a, b, n_b, ok

    def _add(self, part: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, ok: np.ndarray) -> None:
        # segments lie one after the other, so no token of one overlaps another's
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        group_a, group_b = overlap_groups(end_a, end_b)
        # within a component, the members that end together
        _, p, q = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        of = np.repeat(np.arange(len(part)), n_a)
        n_links = np.bincount(of[p], minlength=len(part))
        n_groups = np.bincount(of[np.unique(group_a, return_index=True)[1]], minlength=len(part))
        self.links.frombytes(((a[p] << 32) | b[q]).tobytes())
        self.ends.frombytes((np.cumsum(n_links) + (self.ends[-1] if self.ends else 0)).tobytes())
        self.sizes.append(np.stack((n_a, n_b, n_groups, n_links), axis=1))
        self.texts += [t if k else None for t, k in zip(self.written(a, b, group_a, group_b, n_a, n_b), ok.tolist(), strict=True)]
        self.at.update(zip(part, range(len(self.at), len(self.at) + len(part)), strict=True))
        self.chars += sum(map(len, part))

    def links_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some segments, one after the other, and how many each has."""
        links, ends = np.frombuffer(self.links, np.int64), np.frombuffer(self.ends, np.int64)
        many = np.diff(ends, prepend=0)[at]
        first = ends[at] - many
        return links[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


class _Written:
    """The groups of consecutive segments: A's ids, |, B's ids; groups parted by ;. Ids are below `size`."""

    def __init__(self, size: int) -> None:
        digits = np.array([str(i).encode() for i in range(size)])
        self.length = np.char.str_len(digits)
        self.digits = digits.view(np.uint8).reshape(size, -1)

    def __call__(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        side = np.concatenate((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)))
        key = np.concatenate((group_a, group_b)) * 2 + side
        order = np.argsort(key, kind="stable")
        key, ids, side = key[order], np.concatenate((a, b))[order], side[order]
        length, rows = self.length[ids], np.arange(len(ids))
        signs = np.zeros((len(ids), self.digits.shape[1] + 1), np.uint8)
        signs[:, :-1] = self.digits[ids]
        signs[rows, length] = np.frombuffer(b",|;", np.uint8)[np.where(np.diff(key, append=-1) == 0, 0, 1 + side)]
        flat = signs[np.arange(signs.shape[1]) <= length[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(length + 1)))[np.cumsum(n_a + n_b)].tolist()
        return [flat[lo : max(lo, hi - 1)] for lo, hi in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, chunk int, pairs array<long>, times array<long>, link_counts binary, links binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("groups_sha256", pa.string()), ("segments", pa.binary()), ("chunk", pa.int32()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("link_counts", pa.binary()), ("links", pa.binary())])


def aligned_blocks(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """Blocks of whole documents, in rows that do not grow with the block. A row a document: its figures, and its
    segments as places in the block's table of segments. Rows of CHUNK entries each (`chunk` is their number) with
    the block's linked pairs (A id * 2**32 + B id) and their times in the block, and with its table of segments:
    how many links each has, and these as places among the block's pairs."""

    def run(batches):
        known, number, held, size = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40, [], 0

        def block():
            nonlocal number
            yield from _packed(number, held, known, CHUNK)
            number += 1

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, texts = b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist()
                split = [known.segments(t) if t else [] for t in texts]
                if held and (size >= BLOCK_SEGMENTS or known.chars >= KEPT_CHARS):
                    yield from block()
                    held, size = [], 0
                if known.chars >= KEPT_CHARS:
                    known.forget(KEPT_CHARS // 2)
                known.learn({s for x in split for s in x})
                for doc_id, segments in zip(ids, split, strict=True):
                    at = np.fromiter(map(known.at.__getitem__, segments), np.int64, len(segments))
                    held.append((doc_id, at))
                    size += len(at)
        if held:
            yield from block()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _BLOCKS)


def _packed(number: int, held: list, known: Aligner, chunk: int):
    figures, shas, kept = [], [], []
    sizes = np.concatenate(known.sizes)
    known.sizes = [sizes]
    for _, at in held:
        texts = list(map(known.texts.__getitem__, at.tolist()))
        ok = len(at) > 0 and None not in texts
        kept.append(at if ok else at[:0])
        figures.append(sizes[kept[-1]].sum(axis=0))
        shas.append(hashlib.sha256(b";".join(texts)).hexdigest() if ok else "")
    used, places, times = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
    known.used(used, times)
    # frequent segments get small numbers, which pack well
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    links, many = known.links_of(used[order])
    pairs, where = np.unique(links, return_inverse=True)
    weight = np.bincount(where, weights=np.repeat(times[order], many), minlength=len(pairs)).astype(np.int64)
    figures = np.array(figures, np.int64).reshape(-1, 4)
    segments = binary_array(rank[places].astype("<u4").view(np.uint8), 4 * np.fromiter(map(len, kept), np.int64, len(kept)))
    docs = {"block": np.full(len(held), number), "doc_id": [d for d, _ in held], **{c: figures[:, k] for k, c in enumerate(_FIGURES)}, "groups_sha256": shas, "segments": segments}
    ends = np.concatenate(([0], np.cumsum(many)))
    lows = range(0, max(len(pairs), len(many)), chunk)
    tables = {
        "block": np.full(len(lows), number), "chunk": np.arange(len(lows)), "pairs": [pairs[lo : lo + chunk] for lo in lows], "times": [weight[lo : lo + chunk] for lo in lows],
        "link_counts": [many[lo : lo + chunk].astype("<u4").tobytes() for lo in lows],
        "links": [where[ends[min(lo, len(many))] : ends[min(lo + chunk, len(many))]].astype("<u4").tobytes() for lo in lows],
    }
    for columns in (docs, tables):
        n = len(columns["block"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCK_SCHEMA], schema=_BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (links of it in the whole corpus), best (no pair of its B id has more)."""
    entries = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").alias("n"))
    counts = entries.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Texts null or empty, and those whose tokens' bytes do not give space and text again (a text with
    U+2581 in it), have no tokens: zeros and ''. Rows are taken as they are: repeated and null
    doc_ids give a row each; other columns are not read; an empty table gives an empty result.
    Memory of a task is bounded by BLOCK_SEGMENTS and KEPT_CHARS, or by its longest text.
    """
    with Scratch(docs.sparkSession) as scratch:
        blocks = scratch.write(aligned_blocks(docs, path_a, path_b), "aligned")
        counts = scratch.write(pair_counts(blocks), "pair-counts")
        pairs = blocks.where("chunk IS NOT NULL").select("block", "chunk", F.posexplode("pairs").alias("at", "pair"))
        wanted = pairs.join(counts, "pair").select(F.col("block").alias("block"), (F.col("chunk") * CHUNK + F.col("at")).alias("at"), "count", "best")
        rows = blocks.drop("pairs", "times").groupBy("block").cogroup(wanted.groupBy("block"))
        return scratch.keep(rows.applyInArrow(_scored, _RESULT), "alignment")


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """Counts of the block's pairs, summed by segment, then by document."""
    docs, tables = rows.filter(pc.is_null(rows["chunk"])), rows.filter(pc.is_valid(rows["chunk"])).sort_by("chunk")
    many, links = (np.frombuffer(b"".join(tables[c].to_pylist()), "<u4").astype(np.int64) for c in ("link_counts", "links"))
    data, size = binary_parts(docs["segments"])
    at, sums = wanted["at"].to_numpy(), []
    for name in ("best", "count"):
        value = np.zeros(len(at), np.int64)
        value[at] = wanted[name].to_numpy()
        sums.append(_runs(_runs(value[links], many)[np.ascontiguousarray(data).view("<u4")], size // 4))
    return pa.table({**{c: docs[c] for c in ("doc_id", *_FIGURES)}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})


def _runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents."""
    return align(table(spark, sf_dir, "documents"))
