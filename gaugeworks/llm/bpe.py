"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import Scratch, materialise, table

try:  # where the tokenizer's file lies by default; always a parameter, never copied
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ModuleNotFoundError:
    TOKENIZER = ""
#: Word positions in a block of documents: what bounds a row of blocks and its dictionary.
BLOCK_WORDS = 1 << 22

#: Texts of these characters alone are their own NFC, lower-cased by the same one-to-one rules
#: everywhere, and split alike by any regex library; all others go through the tokenizer's parts.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]*")
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
#: Fixed value: the split pattern in the tokenizer's file that _PLAIN_WORD stands for.
_EXPECTED_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Splitter:
    """Whole text to words, exactly as the tokenizer's normaliser and splitter do it."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = split["pattern"]["Regex"]
        self.split = pre_tokenizers.Split(Regex(self.pattern), split["behavior"].lower(), invert=split["invert"])
        self.plain = self.pattern == _EXPECTED_SPLIT and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        if self.special and "<|" in text and (parts := self.cut.split(text))[1:]:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.plain and _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]


class _Encoder:
    """One word to ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        piece = word if word.isascii() and word.isalnum() else self.bytes.pre_tokenize_str(word)[0][0]
        return [t.id for t in self.model.tokenize(piece)]


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """The id-to-piece table, by position."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]


class _Index(dict):
    """Word to its position in the block's dictionary, new words at the end."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


#: Parts that a block's dictionary is dealt to by a hash of the word.
PARTS = 256
_BLOCKS = "block long, part int, body binary, doc_ids array<long>, counts array<int>"
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, compressed: a byte each for those under 255, what is above in byte planes."""
    numbers = np.asarray(numbers, dtype="<u4")
    over = numbers[numbers >= 255] - np.uint32(255)
    packed = b""
    for part in (np.minimum(numbers, 255).astype(np.uint8), np.ascontiguousarray(over.view(np.uint8).reshape(-1, 4).T)):
        body = pa.Codec("zstd", compression_level=3).compress(part.tobytes(), asbytes=True) if part.size else b""
        packed += part.size.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    return packed


def _expand(packed: bytes) -> np.ndarray:
    parts, at = [], 0
    for _ in range(2):
        size, n = int.from_bytes(packed[at : at + 4], "little"), int.from_bytes(packed[at + 4 : at + 8], "little")
        body = pa.Codec("zstd").decompress(packed[at + 8 : at + 8 + n], decompressed_size=size, asbytes=True) if size else b""
        parts.append(np.frombuffer(body, dtype=np.uint8))
        at += 8 + n
    out = parts[0].astype(np.uint32)
    out[parts[0] == 255] += np.ascontiguousarray(parts[1].reshape(4, -1).T).view("<u4").ravel()
    return out


def _block_rows(key: int, doc_ids: list, counts: list, codes: array, index: dict):
    """A block as rows: part -1 has the documents, for each word position the word's place in the
    dictionary (places by frequency), and the places of the words in the order of the other rows;
    every other part has some words."""
    coded = np.frombuffer(codes, dtype=np.uint32)
    order = np.argsort(-np.bincount(coded, minlength=len(index)), kind="stable") if len(index) else np.zeros(0, dtype=np.int64)
    place = np.empty(len(index), dtype=np.uint32)
    place[order] = np.arange(len(index), dtype=np.uint32)
    parts: dict[int, list] = {}
    for at, word in enumerate(index):
        raw = word.encode("utf-8", "surrogatepass")
        parts.setdefault(zlib.crc32(raw) % PARTS, []).append((raw, at))
    rows = {"block": [key], "part": [-1], "body": [None], "doc_ids": [doc_ids], "counts": [counts]}
    listed = []
    for part, words in sorted(parts.items()):
        words.sort()
        listed += [at for _, at in words]
        sizes, spoken = _squeeze(np.array([len(w) for w, _ in words])), b"".join(w for w, _ in words)
        rows["block"].append(key), rows["part"].append(part), rows["doc_ids"].append(None), rows["counts"].append(None)
        rows["body"].append(_framed(sizes, len(spoken).to_bytes(4, "little") + pa.Codec("zstd", compression_level=3).compress(spoken, asbytes=True)))
    rows["body"][0] = _framed(_squeeze(place[coded]) if len(coded) else _squeeze(coded), _squeeze(place[listed]) if listed else _squeeze(coded))
    return pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


def _framed(one: bytes, two: bytes) -> bytes:
    """Two byte strings as one, with the length of the first in front."""
    return len(one).to_bytes(4, "little") + one + two


def _unframed(body: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(body[:4], "little")
    return body[4 : 4 + n], body[4 + n :]


def word_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents as blocks: for each word position the word's place in the block's dictionary of
    distinct words, and that dictionary in parts by hash. A block never holds more than block_words
    positions and one document. (Compressed: it is what the later joins carry in place of texts.)"""

    def run(batches):
        splitter = _Splitter(tokenizer)
        part, serial = TaskContext.get().partitionId(), 0
        ids, counts, codes, index = [], [], array("I"), _Index()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = splitter.words(text) if text else []
                codes.extend(map(index.__getitem__, words))
                ids.append(doc_id)
                counts.append(len(words))
                if len(codes) >= block_words or len(ids) >= block_words:
                    yield _block_rows((part << 32) + serial, ids, counts, codes, index)
                    ids, counts, codes, index, serial = [], [], array("I"), _Index(), serial + 1
        if ids:
            yield _block_rows((part << 32) + serial, ids, counts, codes, index)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def _words_of(body: bytes) -> list[str]:
    """The words of a dictionary part: their lengths in bytes come first, so any character may be in them."""
    sizes, spoken = _unframed(body)
    n = int.from_bytes(spoken[:4], "little")
    raw = pa.Codec("zstd").decompress(spoken[4:], decompressed_size=n, asbytes=True) if n else b""
    ends = np.cumsum(_expand(sizes), dtype=np.int64).tolist()
    return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip([0, *ends], ends, strict=False)]


def encode_words(parts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """block, part, sizes and ids (packed, in the order of the part's words) and kinds (the distinct
    ids) of dictionary parts. All rows of a part meet in one task, where each distinct word is encoded
    once however many blocks hold it; a word has one entry a block at most, so no word is hot."""

    def run(batches):
        encoder, known = _Encoder(tokenizer), {}
        part_now = None
        for b in batches:
            out = {"block": [], "part": [], "sizes": [], "ids": [], "kinds": []}
            for block, part, body in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                if part != part_now:
                    known, part_now = {}, part
                found = []
                for w in _words_of(body):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = encoder.ids(w)
                    found.append(ids)
                flat = np.array([i for x in found for i in x], dtype=np.int64)
                out["block"].append(block)
                out["part"].append(part)
                out["sizes"].append(_squeeze(np.array([len(x) for x in found])))
                out["ids"].append(_squeeze(flat))
                out["kinds"].append(np.unique(flat).astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary()), ("kinds", pa.list_(pa.int32()))]))

    return parts.select("block", "part", "body").repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, "block long, part int, sizes binary, ids binary, kinds array<int>")


def _unpack(b, i: int) -> tuple[list, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Of a block: doc ids, words a document, place of every word position; of every place where its
    ids start and how many they are; and all ids."""
    codes, places = map(_expand, _unframed(b.column(1)[i].as_py()))
    found = sorted(b.column(4)[i].as_py() or [], key=lambda x: x["part"])
    sizes = [_expand(x["sizes"]).astype(np.int64) for x in found]
    flat = np.concatenate([_expand(x["ids"]) for x in found]) if found else np.zeros(0, dtype=np.uint32)
    size, first = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
    if len(places):
        counts = np.concatenate(sizes)
        size[places], first[places] = counts, counts.cumsum() - counts
    return b.column(2)[i].as_py(), np.array(b.column(3)[i].as_py(), dtype=np.int64), codes, (first, size), flat.astype("<u4")


def _gather(own: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids at some word positions, in order."""
    took = size[own]
    return flat[np.repeat(first[own] - (took.cumsum() - took), took) + np.arange(int(took.sum()))]


def _encoded_blocks(blocks: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with their encoded dictionary parts; and the distinct ids of each block's words."""
    words = encode_words(blocks.where("part >= 0"), tokenizer)
    found = words.select("block", "part", "sizes", "ids").groupBy("block").agg(F.collect_list(F.struct("part", "sizes", "ids")).alias("found"))
    kinds = words.select("block", F.explode("kinds").alias("id")).distinct()
    return blocks.where("part < 0").select("block", "body", "doc_ids", "counts").join(found, "block", "left"), kinds


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id and ids of every document, equal to the tokenizers library's encode without added tokens.

    Words are split in Spark into blocks with a dictionary each; the dictionaries' words meet by
    hash, each distinct word is encoded once, and its ids go back to the word's place in each block
    and so to every position. Null and empty texts have no ids; strings of special tokens in a text
    become those tokens; repeated rows give equal rows; an empty table gives no rows; extra columns
    are ignored.
    """

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, counts, codes, (first, size), flat = _unpack(b, i)
                ends = counts.cumsum().tolist()
                out = [_gather(codes[z - n : z], first, size, flat).astype(np.int32) for n, z in zip(counts.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "ids": out}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    blocks, _ = materialise(word_blocks(docs, tokenizer, block_words), "bpe-blocks")
    return _encoded_blocks(blocks, tokenizer)[0].mapInArrow(run, "doc_id long, ids array<int>")


def piece_table(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, piece: as many rows as the vocabulary has."""
    return spark.createDataFrame(list(enumerate(_pieces(tokenizer))), "id int, piece string")


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """key and text of ids: every position joins its piece in the id-to-piece table (of the
    vocabulary's size, so it is broadcast), and the pieces of a key come together in order."""
    spark = encoded.sparkSession
    rows = encoded.select(key, F.posexplode_outer("ids").alias("at", "id"))
    pieces = rows.join(F.broadcast(piece_table(spark, tokenizer)), "id", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return pieces.select(key, F.array_join("p.piece", " ").alias("text"))


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """encode, then decode, with digests in place of ids and text: one row per document.

    The ids that a block's words use join the id-to-piece table (broadcast: it has the vocabulary's
    size); the text of every document is put together from these pieces alone."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, counts, codes, (first, size), flat = _unpack(b, i)
                pieces = {x["id"]: x["piece"] for x in b.column(5)[i].as_py() or []}
                spoken = [" ".join([pieces[k] for k in flat[a : a + n].tolist()]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                out = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                end = 0
                for n in counts.tolist():
                    own = codes[end : (end := end + n)]
                    ids = _gather(own, first, size, flat)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(" ".join([spoken[c] for c in own.tolist()]).encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        blocks = scratch.write(word_blocks(docs, tokenizer, block_words), "bpe-blocks")
        encoded, kinds = _encoded_blocks(blocks, tokenizer)
        pieces = kinds.join(F.broadcast(piece_table(spark, tokenizer)), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
        out = encoded.join(pieces, "block", "left").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        return scratch.keep(out, "bpe-digests")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
