"""Line dedup: an exact set-similarity join of lines, with prefix, positional and length filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import ASCII_LOWER, Scratch, binary_array, binary_parts, bit_filter, mix64, passes, table, text_bytes, unpacked, whole_row, word_hashes

#: Two lines match from intersection * 100 >= PERCENT * union of their distinct words on.
PERCENT = 80
#: Lines of fewer distinct words have no set to compare: only those without words are left alone.
LEAST_WORDS = 1
#: Lines of under so many distinct words match none but those of equal sets.
FREE_WORDS = 4
#: Bits of a word's hash, and the bytes it is kept in.
WORD_BITS, WORD_BYTES = 44, 6
#: Cells of the table of word frequencies (a byte each when broadcast) and its slices.
RARITY_BITS, SLICES = 24, 256
#: Words in more lines than this are hot: their groups go through leaders first.
HOT = 1024
#: Words in more lines than this (by the table) are dealt out by line as well, so that none fills a task.
SPREAD = 1 << 16
#: Of a set whose earliest candidates all failed, so many times more are tried next.
MORE = 256
#: Bits of the broadcast filter of lines that verification reads (4 MB).
FILTER_BITS = 1 << 25
#: Text bytes, and prefix entries, worked on at a time.
CHUNK, FLUSH = 1 << 20, 1 << 20
_END = (1 << 63) - 1
_WORD = np.uint64((1 << WORD_BITS) - 1)


def _packed(words: np.ndarray) -> np.ndarray:
    """Words in WORD_BYTES bytes each."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).ravel()


def _unpacked(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // WORD_BYTES, 8), dtype=np.uint8)
    wide[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
    return wide.view("<u8").ravel()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return sizes.cumsum() - sizes


class _Lines:
    """The lines of some pieces of texts as sorted distinct words, all in flat arrays.

    pieces: (document, number of the first line, bytes) each."""

    def __init__(self, pieces: list) -> None:
        data = np.concatenate([x for _, _, t in pieces for x in (t, np.array([10], dtype=np.uint8))])
        breaks = data == 10
        words, starts, _ = word_hashes(ASCII_LOWER[data])
        ends = np.cumsum([len(t) + 1 for _, _, t in pieces])
        after = np.cumsum(breaks, dtype=np.int32)
        first_line = np.concatenate(([0], after[ends - 1]))
        line, words = after[starts].astype(np.int64), words >> np.uint64(64 - WORD_BITS)
        if after[-1] < 1 << 64 - WORD_BITS:  # both in one number, which sorts fastest
            both = np.sort(line.astype(np.uint64) << np.uint64(WORD_BITS) | words)
            both = both[np.concatenate((np.ones(min(1, len(both)), dtype=bool), both[1:] != both[:-1]))]
            line, self.words = (both >> np.uint64(WORD_BITS)).astype(np.int64), both & _WORD
        else:
            order = np.lexsort((words, line))
            words, line = words[order], line[order]
            new = np.ones(len(words), dtype=bool)
            new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
            self.words, line = words[new], line[new]
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(line)), dtype=bool), line[1:] != line[:-1])))
        line = line[self.starts]
        self.n = np.diff(np.append(self.starts, len(self.words)))
        piece = np.searchsorted(first_line, line, side="right") - 1
        self.doc = np.array([d for d, _, _ in pieces], dtype=np.int64)[piece]
        self.line_no = line - first_line[piece] + np.array([k for _, k, _ in pieces], dtype=np.int64)[piece]
        sums = lambda v: np.add.reduceat(v, self.starts) if len(self.starts) else np.zeros(0, dtype=np.uint64)
        self.id = sums(mix64(self.words)).view(np.int64)
        self.id2 = sums(mix64(self.words ^ np.uint64(0xA0761D6478BD642F))).view(np.int64)


def _pieces(doc_id: int, text: np.ndarray):
    """A text cut after line ends, about CHUNK bytes a piece (a longer line stays whole)."""
    if len(text) <= CHUNK:
        yield doc_id, 0, text
        return
    ends = np.flatnonzero(text == 10) + 1
    at, line = 0, 0
    while at < len(text):
        k = int(np.searchsorted(ends, at + CHUNK))
        end = int(ends[k]) if k < len(ends) else len(text)
        yield doc_id, line, text[at : end - (k < len(ends))]
        at, line = end, k + 1


def _chunks(batches):
    """Lines of some documents of each batch, about CHUNK bytes at a time."""
    for b in batches:
        found, size = [], 0
        for doc_id, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
            for piece in _pieces(doc_id, t) if t is not None and len(t) else ():
                found.append(piece)
                size += len(piece[2])
                if size >= CHUNK:
                    yield _Lines(found)
                    found, size = [], 0
        if found:
            yield _Lines(found)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_END)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan_lines(docs: DataFrame) -> DataFrame:
    """A row per line of LEAST_WORDS or more: id, id2 (digest of its set), doc, line, n, words (its set,
    in the first of equal lines of a chunk; else empty); and, from each task, slices of its word
    frequencies (lines that hold a word, by cell). The only pass over the texts."""
    schema = pa.schema([("id", pa.int64()), ("id2", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("slice", pa.int32()), ("body", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << RARITY_BITS, dtype=np.uint16)
        for lines in _chunks(batches):
            cells, k = np.unique(lines.words >> np.uint64(WORD_BITS - RARITY_BITS), return_counts=True)
            counts[cells] = np.minimum(counts[cells].astype(np.uint32) + k, 65535)
            m = len(lines.n)
            order = np.lexsort((lines.line_no, lines.doc, lines.id))
            ids = lines.id[order]
            first = np.zeros(m, dtype=bool)
            first[order] = np.concatenate((np.ones(min(1, m), dtype=bool), ids[1:] != ids[:-1]))
            first &= lines.n >= FREE_WORDS
            sizes = np.where(first, lines.n * WORD_BYTES, 0)
            words = binary_array(_packed(lines.words[np.repeat(first, lines.n)]), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(lines.id), pa.array(lines.id2), pa.array(lines.doc), pa.array(lines.line_no.astype(np.int32)), pa.array(lines.n.astype(np.int32)), words, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        for s, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"id": [None], "id2": [None], "doc": [None], "line": [None], "n": [None], "words": [None], "slice": [s], "body": [zlib.compress(part.tobytes(), 1)]}, schema=schema)

    return _source(docs).mapInArrow(run, "id long, id2 long, doc long, line int, n int, words binary, slice int, body binary")


def rarity_table(slices: DataFrame) -> np.ndarray:
    """Rank by cell of word hash: quarter octaves of the frequency up to 255; exact up to 4.

    The sums are made slice by slice on the executors; 2**RARITY_BITS bytes come to the driver,
    whatever the input."""

    def run(batches):
        now, total = None, None
        done = lambda: pa.RecordBatch.from_pydict({"slice": [now], "ranks": [zlib.compress(_ranks(total).tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("ranks", pa.binary())]))
        for b in batches:
            for s, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(body), dtype=np.uint16)
                if s != now:
                    if now is not None:
                        yield done()
                    now, total = s, np.zeros(len(part), dtype=np.uint64)
                total += part
        if now is not None:
            yield done()

    out = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
    size = len(out) // SLICES
    rows = slices.select("slice", "body").repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(run, "slice int, ranks binary").toArrow()
    for at, ranks in zip(rows.column("slice").to_pylist(), rows.column("ranks").to_pylist(), strict=True):
        out[at * size : (at + 1) * size] = np.frombuffer(zlib.decompress(ranks), dtype=np.uint8)
    return out


def _ranks(count: np.ndarray) -> np.ndarray:
    return np.where(count <= 4, count, np.minimum(255, 4 * np.log2(np.maximum(count, 1)) - 3)).astype(np.uint8)


def _need(n, percent: int):
    """Least number of common words with a line of the same or a larger set: ceil(percent/100 * n)."""
    return -(-n * percent // 100)


#: A prefix entry: the word, the line's set (id, parity of its words by 64 cells: how many of them differ
#: bounds the difference of two sets; size), the word's place in the order by rarity, and the set's first place.
_ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("bits", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("doc", "<i8"), ("line", "<u4")])
#: Sets of so many words have their parities by 256 cells as well (three words more): 64 tell too little.
LONG = 88
#: Sets worked on at a time: their number and a word with its rank fit one integer of 64 bits.
_GROUP = 1 << (64 - WORD_BITS - 8)


def _entries_of(ids, docs_, line_nos, n: np.ndarray, words: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest words of each of some sets, as many as any match must share one of; and for each of
    these entries the set's finer parities."""
    start = _starts(n)
    cell = mix64(words + np.uint64(77))
    bit = np.uint64(1) << (cell & np.uint64(63))
    quarter = cell >> np.uint64(6) & np.uint64(3)
    parity = np.bitwise_xor.reduceat(bit, start)
    fine = np.stack([np.bitwise_xor.reduceat(np.where(quarter == k, bit, np.uint64(0)), start) for k in range(1, 4)], axis=1)
    rank = rarity[words >> np.uint64(WORD_BITS - RARITY_BITS)].astype(np.uint64)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    words = np.sort(row << np.uint64(WORD_BITS + 8) | rank << np.uint64(WORD_BITS) | words) & _WORD
    size = n - _need(n, percent) + 1
    row = np.repeat(np.arange(len(n)), size)
    pos = np.arange(len(row)) - np.repeat(_starts(size), size)
    out = np.empty(len(row), dtype=_ENTRY)
    for name, v in (("token", words[start[row] + pos]), ("id", ids[row]), ("bits", parity[row]), ("n", n[row]), ("pos", pos), ("doc", docs_[row]), ("line", line_nos[row])):
        out[name] = v
    return out, fine[row]


def _squeezed(rows: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T) if len(rows) else np.zeros(0, dtype=np.uint8)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _from_planes(body: bytes, m: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(body, decompressed_size=m * width, asbytes=True) if m else b"", dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, m).T)


def _blob(entries: np.ndarray, fine: np.ndarray) -> bytes:
    body, more = _squeezed(entries), _squeezed(fine[entries["n"] >= LONG])
    return b"".join(x.to_bytes(4, "little") for x in (len(entries), len(body))) + body + more


def _from_blob(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    m, size = (int.from_bytes(body[k : k + 4], "little") for k in (0, 4))
    entries = _from_planes(body[8 : 8 + size], m, _ENTRY.itemsize).view(_ENTRY).ravel()
    fine, long_ = np.zeros((m, 3), dtype=np.uint64), entries["n"] >= LONG
    fine[long_] = _from_planes(body[8 + size :], int(long_.sum()), 24).view("<u8").reshape(-1, 3)
    return entries, fine


def _slot(x: np.ndarray) -> np.ndarray:
    """Places in a filter of FILTER_BITS."""
    return (x & x.dtype.type(FILTER_BITS - 1)).astype(np.int64)


def _filter(spark: SparkSession, values: DataFrame, column: str):  # noqa: ANN202
    """A broadcast filter of a column of numbers."""
    return spark.sparkContext.broadcast(bit_filter(values.select(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("s")), FILTER_BITS))


def _prefix_words(sets: DataFrame, rarity, asked, percent: int) -> DataFrame:
    """token: the prefix words of the sets (id, words) that a filter of ids lets through."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(passes(asked.value, _slot(np.asarray(b.column(0))))))
            if b.num_rows:
                ids, (words, size) = np.asarray(b.column(0)), binary_parts(b.column(1))
                words, n, none = _unpacked(words), size // WORD_BYTES, np.zeros(len(ids), dtype=np.int64)
                ends = np.cumsum(n)
                for k in range(0, len(n), _GROUP):
                    part = slice(k, k + _GROUP)
                    found, _ = _entries_of(ids[part], none[part], none[part], n[part], words[ends[k] - n[k] : ends[part][-1]], rarity.value, percent)
                    yield pa.RecordBatch.from_pydict({"token": np.unique(found["token"]).view(np.int64)})

    return sets.mapInArrow(run, "token long")


def prefix_blobs(lines: DataFrame, rarity, buckets: int, percent: int = PERCENT, tokens=None) -> DataFrame:
    """bucket, body: the prefix entries of all sets, packed, dealt out by their word; those of very
    common words by their set as well. Sets of under FREE_WORDS words match none but equal ones.
    tokens: a broadcast filter of the words whose entries are wanted (None: of all)."""
    spread_from = int(_ranks(np.array([SPREAD]))[0])

    def flush(parts: list) -> pa.RecordBatch:
        entries, fine = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        by = entries["token"] >> np.uint64(WORD_BITS - 32)
        wide = rarity.value[entries["token"] >> np.uint64(WORD_BITS - RARITY_BITS)] > spread_from
        by[wide] = mix64(entries["token"][wide] ^ entries["id"][wide].view(np.uint64)) >> np.uint64(32)
        bucket = (by * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((entries["token"], bucket))
        entries, fine, bucket = entries[order], fine[order], bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        return pa.RecordBatch.from_pydict({"bucket": bucket[edges[:-1]].astype(np.int32), "body": [_blob(entries[a:z], fine[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]})

    def run(batches):
        parts, held = [], 0
        for b in batches:
            ids, docs_, line_nos, n = (np.asarray(b.column(k)) for k in range(4))
            words = _unpacked(binary_parts(b.column(4))[0])
            start = _starts(n.astype(np.int64))
            if tokens is not None and len(n):  # only sets with a wanted word at any place
                some = np.logical_or.reduceat(passes(tokens.value, _slot(words)), start)
                words = words[np.repeat(some, n)]
                ids, docs_, line_nos, n = ids[some], docs_[some], line_nos[some], n[some]
                start = _starts(n.astype(np.int64))
            for k in range(0, len(n), _GROUP):
                part = slice(k, k + _GROUP)
                size = n[part].astype(np.int64)
                a = int(start[k])
                entries, fine = _entries_of(ids[part], docs_[part], line_nos[part], size, words[a : a + int(size.sum())], rarity.value, percent)
                if tokens is not None:
                    want = passes(tokens.value, _slot(entries["token"]))
                    entries, fine = entries[want], fine[want]
                if len(entries):
                    parts.append((entries, fine))
                held += len(entries)
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    some = lines.where(F.octet_length("words") > 0).select("id", "doc", "line", "n", "words")
    return some.mapInArrow(run, "bucket int, body binary")


def _pairs_of(e: np.ndarray, fine: np.ndarray, percent: int):
    """Indices of entries (sorted by token, then n) that share a word and pass the length, positional
    and parity filters, some at a time."""
    token, n, left, bits = e["token"].copy(), e["n"].astype(np.int64), e["n"].astype(np.int64) - e["pos"], e["bits"].copy()
    at, d = np.arange(len(e) - 1), 1
    while len(at):
        at = at[at + d < len(e)]
        to = at + d
        go = (token[at] == token[to]) & (n[at] * 100 >= n[to] * percent)
        at, to = at[go], to[go]
        need = -(-percent * (n[at] + n[to]) // (100 + percent))
        apart = n[at] + n[to] - 2 * need
        hit = (np.minimum(left[at], left[to]) >= need) & (np.bitwise_count(bits[at] ^ bits[to]) <= apart)
        x, y, apart = at[hit], to[hit], apart[hit]
        if len(x):
            both = fine[x] ^ fine[y]  # the first of four words is what is left of the coarse one
            rest = bits[x] ^ bits[y] ^ both[:, 0] ^ both[:, 1] ^ both[:, 2]
            close = (n[x] < LONG) | (np.bitwise_count(both).sum(axis=1) + np.bitwise_count(rest) <= apart)
            yield x[close], y[close]
        d += 1


def _earliest(e: np.ndarray, pairs, most: int, asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the later and of the earlier set of each pair: of every later set (of those asked for) its
    `most` earliest partners. No more pairs are held than these and FLUSH others."""

    def least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((e["id"][v], e["line"][v], e["doc"][v], e["id"][u]))
        u, v = u[order], v[order]
        mine, other = e["id"][u], e["id"][v]
        new = np.concatenate((np.ones(min(1, len(u)), dtype=bool), (mine[1:] != mine[:-1]) | (other[1:] != other[:-1])))
        u, v, mine = u[new], v[new], mine[new]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(u)), dtype=bool), mine[1:] != mine[:-1])))
        some = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u)))) < most
        return u[some], v[some]

    none = np.zeros(0, dtype=np.int64)
    held, size, base = [(none, none)], 0, 0
    for i, j in pairs:
        earlier = (e["doc"][i] < e["doc"][j]) | ((e["doc"][i] == e["doc"][j]) & (e["line"][i] < e["line"][j]))
        later = (e["doc"][j] < e["doc"][i]) | ((e["doc"][i] == e["doc"][j]) & (e["line"][j] < e["line"][i]))
        u, v = np.where(earlier, j, i), np.where(earlier, i, j)
        go = earlier | later if asked is None else (earlier | later) & asked[u]
        held.append((u[go], v[go]))
        size += int(go.sum())
        if size >= base + FLUSH:
            held = [least(*map(np.concatenate, zip(*held, strict=True)))]
            size = base = len(held[0][0])
    return least(*map(np.concatenate, zip(*held, strict=True)))


_PAIRS = "u long, v long, doc long, line int, token long, bits long, n int, pos int"


def candidates(blobs: DataFrame, rarity, buckets: int, percent: int = PERCENT, most: int = 1, asked=None) -> DataFrame:
    """Of the words in at most HOT sets: u, v, doc, line: a pair that may match, of which v (first at doc, line)
    is the earlier; of each set u the `most` earliest in a bucket, so there are never more than `most` times the entries.
    Of every other word its entries again (v is null, u the set), once a set. asked: a broadcast filter
    of ids; then only pairs of these u come."""
    spread_from, hot = int(_ranks(np.array([SPREAD]))[0]), HOT
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("token", pa.int64()), ("bits", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def rows(u, v, doc, line, extra) -> pa.RecordBatch:
        m = len(u)
        more = [pa.nulls(m, t) for t in schema.types[4:]] if extra is None else [pa.array(x.astype(t)) for x, t in zip(extra, (np.int64, np.int64, np.int32, np.int32), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(m, pa.int64()) if v is None else pa.array(v), pa.array(doc), pa.array(line.astype(np.int32)), *more], schema=schema)

    def run(batches):
        held = [_from_blob(body) for b in batches for body in b.column(1).to_pylist()]
        if held:
            yield from solve(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

    def solve(e, fine):
        order = np.lexsort((e["line"], e["doc"], e["id"], e["n"], e["token"]))
        e = e[order]
        new = np.concatenate(([True], (e["token"][1:] != e["token"][:-1]) | (e["id"][1:] != e["id"][:-1])))
        e, fine = e[new], fine[order][new]
        edges = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1], [True])))
        size = np.repeat(np.diff(edges), np.diff(edges))
        many = size > hot
        many |= rarity.value[e["token"] >> np.uint64(WORD_BITS - RARITY_BITS)] > spread_from  # their other sets are elsewhere
        if many.any():
            if asked is None:
                h = e[many]
                yield rows(h["id"], None, h["doc"], h["line"], (h["token"].view(np.int64), h["bits"].view(np.int64), h["n"], h["pos"]))
            e, fine = e[~many], fine[~many]
        if len(e) < 2:
            return
        u, v = _earliest(e, _pairs_of(e, fine, percent), most, None if asked is None else passes(asked.value, _slot(e["id"])))
        for k in range(0, len(u), 1 << 20):
            part = slice(k, k + (1 << 20))
            yield rows(e["id"][u[part]], e["id"][v[part]], e["doc"][v[part]], e["line"][v[part]], None)

    return blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _PAIRS)


def verified(pairs: DataFrame, lines: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The rows of pairs (u, v, doc, line) whose sets match in full."""
    members = _sets_of(pairs, lines, scratch)
    out = _matching(pairs, members, scratch, percent)
    scratch.drop(members)
    return out


def _sets_of(pairs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """id, words of the sets of some pairs. These alone are looked up (a bit filter of bounded size lets them
    through, joins decide)."""
    spark = lines.sparkSession
    wanted = scratch.write(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "line-ids")
    shared = _filter(spark, wanted, "id")

    def pick(batches):
        for b in batches:
            hit = passes(shared.value, _slot(np.asarray(b.column(0))))
            yield b.filter(pa.array(hit))

    some = lines.where(F.octet_length("words") > 0).select("id", "words").mapInArrow(pick, "id long, words binary")
    members = scratch.write(some.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "line-sets")
    scratch.drop(wanted)
    return members


def _matching(pairs: DataFrame, members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The rows of pairs whose sets, all among members, match in full."""

    def compare(batches):
        for b in batches:
            (x, x_size), (y, y_size) = (binary_parts(b.column(k)) for k in (4, 5))
            p, q = x_size // WORD_BYTES, y_size // WORD_BYTES
            row = np.arange(len(p), dtype=np.uint64) << np.uint64(WORD_BITS)
            both = np.sort(np.concatenate((np.repeat(row, p) | _unpacked(x), np.repeat(row, q) | _unpacked(y))))
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(WORD_BITS)
            shared_ = np.bincount(twice.astype(np.int64), minlength=len(p))
            keep = shared_ * 100 >= percent * (p + q - shared_)
            yield b.select(["u", "v", "doc", "line"]).filter(pa.array(keep))

    one, two = (members.select(F.col("id").alias(k), F.col("words").alias(f"w_{k}")) for k in "uv")
    both = pairs.select("u", "v", "doc", "line").join(two, "v").join(one, "u").select("u", "v", "doc", "line", "w_u", "w_v")
    return scratch.write(both.mapInArrow(compare, "u long, v long, doc long, line int"), "line-links")


def _later_tries(lines: DataFrame, sets: DataFrame, left: DataFrame, rarity, buckets: int, scratch: Scratch, percent: int) -> list[DataFrame]:
    """Links of the sets u of `left` (all among sets), whose earliest candidate failed: MORE of their candidates, then MORE times
    as many and so on, until one of each matches or it has no others. Entries of other words are not dealt out again."""
    spark, found, most = lines.sparkSession, [], 1
    left = scratch.write(left, "line-open")
    while left.limit(1).count():
        most *= MORE
        asked = _filter(spark, left, "u")
        tokens = _filter(spark, _prefix_words(sets, rarity, asked, percent), "token")
        met = candidates(prefix_blobs(lines, rarity, buckets, percent, tokens), rarity, buckets, percent, most, asked).where("v IS NOT NULL").select("u", "v", "doc", "line")
        order = F.row_number().over(Window.partitionBy("u").orderBy("doc", "line", "v"))
        tried = scratch.write(met.join(left, "u", "left_semi").distinct().withColumn("k", order).where(F.col("k") <= most), "line-tries")
        found.append(verified(tried, lines, scratch, percent))
        rest = scratch.write(tried.where(F.col("k") == most).select("u").join(found[-1].select("u"), "u", "left_anti"), "line-open")
        scratch.drop(left, tried)
        asked.destroy()
        tokens.destroy()
        left = rest
    return found


def _hot_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """Pairs of hot words' entries with four leaders of their group, the earliest line among them."""
    lead = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "id"), F.struct("id", "bits", "n", "pos", "at").alias("e")))["e"]
    earliest = F.min(F.struct("at", F.struct("id", "bits", "n", "pos", "at").alias("e")))["e"]
    leaders = hot.groupBy("token", "size").agg(F.array_distinct(F.array(earliest, lead(1), lead(2), lead(3))).alias("lead")).select("token", "size", F.explode("lead").alias("l"))
    star = hot.join(leaders, ["token", "size"]).where((F.col("id") != F.col("l.id")) & (F.col("at") != F.col("l.at")) & _alike("n", "l.n", "bits", "l.bits", percent))
    swap = F.col("at") < F.col("l.at")
    at = F.when(swap, F.col("at")).otherwise(F.col("l.at"))
    return star.select(F.when(swap, F.col("l.id")).otherwise(F.col("id")).alias("u"), F.when(swap, F.col("id")).otherwise(F.col("l.id")).alias("v"), at["doc"].alias("doc"), at["line"].alias("line"))


def _alike(n: str, m: str, bits: str, other: str, percent: int) -> Column:
    """Length and parity filters."""
    return F.expr(f"least({n}, {m}) * 100 >= greatest({n}, {m}) * {percent} and bit_count({bits} ^ {other}) <= {n} + {m} - 2 * ceil({percent} * ({n} + {m}) / {100 + percent})")


def later_matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc, line, exact, match_doc of every line that matches an earlier one (by doc_id, then line).

    Lines with equal sets form a class. Classes meet by the words of their prefixes; of each class the
    earliest candidate is verified, then, of the classes whose earliest one failed, the next ones. Groups
    of words in over HOT sets are compared with four leaders first (the earliest line among them), and
    then with all of the group that are earlier than the least match so far (than the class itself, if
    none): copies of a line seldom meet all against all, and match_doc is the least of all matches.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        scanned = scratch.write(scan_lines(docs), "lines")
        rarity = spark.sparkContext.broadcast(rarity_table(scanned.where("slice IS NOT NULL")))
        lines = scanned.where("slice IS NULL").select("id", "id2", "doc", "line", "n", "words")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        met = scratch.write(candidates(prefix_blobs(lines, rarity, buckets, percent), rarity, buckets, percent), "line-candidates")
        near = met.where("v IS NOT NULL").select("u", "v", "doc", "line")
        bucket = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
        hot = scratch.write(met.where("v IS NULL").groupBy("token", F.col("u").alias("id"), "bits", "n", "pos").agg(F.min(F.struct("doc", "line")).alias("at")).withColumn("size", bucket), "hot-entries")
        crowded = hot.limit(1).count() > 0
        pairs = near.unionByName(_hot_pairs(hot, percent)) if crowded else near
        best = F.min(F.struct("doc", "line", "v")).alias("b")
        first = scratch.write(pairs.groupBy("u").agg(best).select("u", "b.v", "b.doc", "b.line"), "line-pairs")
        sets = _sets_of(first, lines, scratch)
        links = _matching(first, sets, scratch, percent)
        failed = first.join(links.select("u"), "u", "left_anti").select("u", F.col("v").alias("tried"))
        for more in _later_tries(lines, sets, failed.select("u"), rarity, buckets, scratch, percent):
            links = links.unionByName(more)
        if crowded:
            others = scratch.write(_hot_pairs(hot, percent).join(failed, "u").where("v <> tried").select("u", "v", "doc", "line").distinct(), "line-pairs")
            if others.limit(1).count():
                links = links.unionByName(verified(others, lines, scratch, percent))
        least = lambda x: x.groupBy(F.col("u").alias("id")).agg(F.min("doc").alias("match_doc"))
        matches = scratch.write(least(links), "line-matches")
        if crowded:
            probe = hot.join(matches, "id", "left").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
            close = _alike("u.n", "v.n", "u.bits", "v.bits", percent) & F.expr(f"least(u.n - u.pos, v.n - v.pos) >= ceil({percent} * (u.n + v.n) / {100 + percent})")
            both = probe.alias("u").join(hot.alias("v"), (F.col("u.token") == F.col("v.token")) & (F.col("u.size") == F.col("v.size")) & (F.col("v.at") < F.col("u.at")) & (F.col("u.match_doc").isNull() | (F.col("v.at.doc") < F.col("u.match_doc"))) & close)
            more = scratch.write(both.select(F.col("u.id").alias("u"), F.col("v.id").alias("v"), F.col("v.at.doc").alias("doc"), F.col("v.at.line").alias("line")).distinct(), "line-pairs")
            if more.limit(1).count():
                matches = scratch.write(least(links.unionByName(verified(more, lines, scratch, percent))), "line-matches")
        rarity.destroy()
        classes = lines.groupBy("id", "id2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("m")).join(matches, "id", "left").where("m > 1 OR match_doc IS NOT NULL")
        exact = F.struct("doc", "line") != F.col("first")
        marked = lines.select("id", "id2", "doc", "line").join(classes, ["id", "id2"]).where(exact | F.col("match_doc").isNotNull())
        return scratch.keep(marked.select("doc", "line", exact.alias("exact"), F.least(F.col("first.doc"), "match_doc").alias("match_doc")), "line-removals")


def _cleaned(docs: DataFrame, percent: int) -> DataFrame:
    """row (the row of docs), text, and gone: the lines to drop (numbers, exact and near counts, least matching doc)."""
    gone = later_matches(docs, percent).groupBy(F.col("doc").alias("key")).agg(
        F.struct(F.array_sort(F.collect_set("line")).alias("lines"), F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("near"), F.min("match_doc").alias("match_doc")).alias("gone")
    )
    rows = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(_END)).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.join(gone, "key", "left")


def _kept_text(text: Column, gone: Column) -> Column:
    """text without the lines that are gone: the stretches between them, each cut out once."""
    def stretches(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), gone["lines"])
        after = F.concat(gone["lines"], F.array(F.size(parts)))
        cut = F.transform(F.zip_with(before, after, lambda a, z: F.slice(parts, a + 2, F.greatest(z - a - 1, F.lit(0)))), lambda x: x)
        return F.array_join(F.flatten(cut), "\n")

    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n", -1)), stretches), F.lit(0)))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with later matching lines taken out of the texts; documents none of whose lines with
    words is left, but had some, go. All columns stay, whatever their names.

    Rows with one doc_id are one document (a line does not match its own copy there); documents
    without doc_id come last. Null and empty texts stay as they are; an empty table gives no rows.
    """
    rows = _cleaned(docs, percent).select("row", "gone", _kept_text(F.col("text"), F.col("gone")).alias("kept"))
    return rows.where(F.col("gone").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]")).select(*unpacked(docs, text=F.col("kept")))


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, class_id (the least document with an earlier match of a line,
    itself if none), n_links (lines taken out), n_exact, n_near, n_lines, kept_chars, text_sha256."""
    rows = _cleaned(docs.select("doc_id", "text"), percent).select("row.doc_id", "text", "gone", F.coalesce(_kept_text(F.col("text"), F.col("gone")), F.lit("")).alias("kept"))
    own = F.col("doc_id").cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        own.alias("doc_id"), F.coalesce(F.least(own, F.col("gone.match_doc")), F.col("gone.match_doc")).alias("class_id"),
        (zero("gone.exact") + zero("gone.near")).alias("n_links"), zero("gone.exact").alias("n_exact"), zero("gone.near").alias("n_near"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.col("kept").cast("binary"), 256).alias("text_sha256"),
    )


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
