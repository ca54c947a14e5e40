"""Operators 11 to 13 against brute force and SQL; edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import align, ann, queries, variants

# ---------------------------------------------------------------- nearest neighbours


def exact(vectors: dict, every: int, k: int) -> dict:
    """query to its k nearest by inner product, ties to the smaller id."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, vectors: dict):
    return spark.createDataFrame([(int(i), [float(v) for v in x], 1) for i, x in vectors.items()], "vec_id long, embedding array<double>, score int")


def recall(got, want) -> float:
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    for q, rows in found.items():
        assert len(rows) == len(want[q]) and rows == sorted(rows, key=lambda x: (-x[1], x[0])) and q not in {v for v, _ in rows}
    return sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths", "copies"])
def test_neighbours_against_brute_force(spark, monkeypatch, kind):
    """Directions without structure, tight clusters, lengths over many powers of two, a third of copies."""
    for name, value in (("LIST_ROWS", 150), ("SEEDS", 128), ("BLOCK", 64)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clustered":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.15 * x
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(3000, 1)) * 2)
    if kind == "copies":
        x[:1000] = x[0]
    vectors = dict(enumerate(x))
    got = ann.nearest(frame(spark, vectors).repartition(7), every=50, k=20).collect()
    want = exact(vectors, 50, 20)
    assert recall(got, want) >= 0.97
    for r in got:
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), rel=1e-12, abs=1e-12)


def test_ties_go_to_the_smaller_id_and_few_candidates_all_come(spark):
    same = {i: [1.0, 2.0] for i in range(30)}
    got = ann.nearest(frame(spark, same), every=20, k=5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 20] == [0, 1, 2, 3, 4]
    few = ann.nearest(frame(spark, {0: [1.0, 0.0], 1: [-1.0, 0.5], 2: [0.5, 0.5]}), every=20, k=20).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(2, 0.5), (1, -1.0)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, [2.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (20, [0.0, -0.0]), (1, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("r", F.lit("x")).withColumn("list", F.lit("y"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 4.0), (0, 2, 1, 4.0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 0")).count() == 0


def test_length_bounds_are_quantiles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40_000, 16))
    share = np.cumsum(x**2, axis=1) / (x**2).sum(axis=1, keepdims=True)
    for m, bound in zip(ann.columns(16), ann.length_bounds(16, 0.05), strict=True):
        assert m == 16 or (share[:, m - 1] > bound).mean() == pytest.approx(0.05, abs=0.01)


# ---------------------------------------------------------------- spelling variants


def plain_variants(docs) -> dict:
    import re

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            n[run if doc_id is None or h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def told(df) -> dict:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["colour", "colours", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "ébcde", "ÀÀÀÀÀ", "centre", "center", "banana"]
    words = list(stems)
    for w in stems * 8:
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿé") + w[k:], w[:k] + rng.choice("abcÿé") + w[k + 1 :]]))
    docs = [(i if i % 19 else None, " ".join(rng.choice(words) for _ in range(40)) + rng.choice(["", "!", " Colour-COLOURS_x9colour"])) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "x" * 3 + " " + "y" * 3000), (503, "y" * 3000 + " " + "y" * 2999), (504, "y" * 3000), (505, ("y" * 2999 + " ") * 2), (0, docs[1][1]), (0, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got, want = told(variants.variant_groups(df)), plain_variants(docs)
    assert len(want) > 60 and got == want and any(v[0] for v in want.values()) and any(v[1] not in (w, v[0]) for w, v in want.items() if v[0])
    assert told(variants.variant_groups(df.limit(0))) == {}


def test_each_pair_is_found_once(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(150)})
    from gaugeworks.llm.shared import Scratch

    with Scratch(spark) as scratch:
        pairs = [tuple(sorted(r)) for r in variants.near_pairs(spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "id long, word string, n long"), scratch).collect()]
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(9))
    want = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]
    assert sorted(pairs) == sorted(want) and len(want) > 200


def test_variants_equal_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op12_variants"])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES["op12_variants"](spark, small)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


# ---------------------------------------------------------------- alignment


def plain_alignment(texts) -> list:
    """Whole texts through both libraries, cut at offsets where both end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_, b_ = Tokenizer.from_file(align.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)
    a_.encode_special_tokens = True
    of = align.byte_of_char()
    rows, links = [], []
    for text in texts:
        whole = f" {text}".encode() if text else b""
        a, b = (a_.encode(f" {text}", add_special_tokens=False).ids, b_.encode(text)) if text else ([], [])
        parts_a = [bytes(of[c] for c in a_.id_to_token(i)) for i in a]
        parts_b = [bytes([int(b_.id_to_piece(i)[3:5], 16)]) if b_.is_byte(i) else b_.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        cuts, groups, lo = sorted(set(ends_a) & set(ends_b)), [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((a, ends_a), (b, ends_b))))
            lo = hi
        links.append([(i, j) for i, e in zip(a, ends_a, strict=True) for j, f in zip(b, ends_b, strict=True) if e == f])
        rows.append((len(a), len(b), len(cuts), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


def test_alignment_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_SEGMENTS", 3000)
    rng = random.Random(2)
    odd = "ab é\n\t  ▁ 'sß中😀1239.,-_<|>　\u0085\x00\x1c​"
    texts = [None, "", " ", "  ", "a ", "a  ", "<|endoftext|> <s></s>", "a\n  b", "a \n  b", "x\t   y  ", "don't  'll \r\n  z", "a▁b"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(120).collect()] + ["long word " * 4000 + "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("block", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in align.align(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_alignment_in_rows_that_do_not_grow_with_the_block(spark, small, monkeypatch):
    """A row a document, tables of a block in pieces, and the same results where rare segments are forgotten."""
    monkeypatch.setattr(align, "CHUNK", 16)
    monkeypatch.setattr(align, "KEPT_CHARS", 3000)
    texts = [r["text"][:400] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    texts = [f"{t}{i}" for i in range(5) for t in texts] + [None, "a▁b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = align.aligned_blocks(df).collect()
    docs, tables = [r for r in rows if r["chunk"] is None], [r for r in rows if r["chunk"] is not None]
    assert sorted(r["doc_id"] for r in docs) == list(range(len(texts))) and len({r["block"] for r in docs}) > 1
    assert all(len(r["pairs"]) <= 16 and len(r["link_counts"]) <= 4 * 16 for r in tables)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in align.align(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_forgetting_keeps_frequent_segments_as_they_were():
    known = align.Aligner(align.BYTE_BPE, align.PIECE_BPE)
    names = [f" {w}{e}" for w in ("frequent", "Straße", "a", "naïve,\nnext") for e in ("", ".", "  ")]
    known.learn({*names, *(f" rare{i}" for i in range(300))})

    def told(s):
        at = known.at[s]
        return known.texts[at], np.concatenate(known.sizes)[at].tolist(), known.links_of(np.array([at]))[0].tolist()

    before = {s: told(s) for s in names}
    known.used(np.array(sorted(known.at.values())), np.array([3 if s in before else 1 for s in known.at]))
    known.forget(1000)
    assert known.at.keys() == before.keys() and known.chars == sum(map(len, names))
    assert {s: told(s) for s in names} == before
    known.learn({" rare1"})
    assert known.texts[known.at[" rare1"]] and {s: told(s) for s in names} == before


def test_alignment_of_repeated_and_missing_ids_and_of_nothing(spark):
    df = spark.createDataFrame([(None, "one text"), (None, "one text"), (3, "one text"), (3, None)], "doc_id long, text string")
    rows = sorted(map(str, align.align(df).collect()))
    assert len(rows) == 4 and rows[0] != rows[-1]
    assert align.align(df.limit(0)).count() == 0
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in align.align(df.where("text IS NULL")).collect())


def test_components_of_overlaps():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else np.zeros(0, int) for _ in range(2)]
        a, b = (np.append(e, n) for e in ends)
        group_a, group_b = align.overlap_groups(a, b)
        cuts = np.array(sorted(set(a) & set(b)))
        assert (group_a == np.searchsorted(cuts, a)).all() and (group_b == np.searchsorted(cuts, b)).all()
