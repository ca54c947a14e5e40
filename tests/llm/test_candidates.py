"""Candidates of line dedup: as many rows as entries at most, and none of the earliest matches lost by that."""

import random

import numpy as np

from gaugeworks.llm import linededup

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def near_copies(n: int, words: int, edits: tuple[int, int], seed: int) -> list[list[str]]:
    rng, base = random.Random(seed), [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(*edits)):
            w[at] = f"z{rng.randrange(5000)}"
        out.append(w)
    return out


def table_of(spark, lines):
    return spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(lines)], DOCS)


def test_candidates_of_a_group_do_not_grow_with_its_square(spark):
    made = []
    for n in (60, 300):
        scanned = linededup.scan_lines(table_of(spark, near_copies(n, 24, (1, 2), 3))).cache()
        rarity = spark.sparkContext.broadcast(linededup.rarity_table(scanned.where("slice IS NOT NULL")))
        lines = scanned.where("slice IS NULL").select("id", "id2", "doc", "line", "n", "words")
        made.append(linededup.candidates(linededup.prefix_blobs(lines, rarity, 4), rarity, 4).count())
        scanned.unpersist()
    assert 0 < made[0] < 4 * 60 and 0 < made[1] < 4 * 300


def test_matches_behind_candidates_that_fail(spark, monkeypatch):
    """Sets just under the threshold pass the filters and come first; the match is found in a later round."""
    monkeypatch.setattr(linededup, "MORE", 2)
    rounds = []
    old = linededup._prefix_words
    monkeypatch.setattr(linededup, "_prefix_words", lambda *a: rounds.append(1) or old(*a))
    lines = near_copies(150, 70, (1, 9), 9)
    sets = [frozenset(w) for w in lines]
    want = [next((j for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])), i) for i in range(len(sets))]
    got = {r["doc_id"]: r["class_id"] for r in linededup.line_report(table_of(spark, lines)).collect()}
    assert [got[i] for i in range(len(sets))] == want
    assert len(rounds) > 1


def test_earliest_partners_are_those_of_all_pairs():
    """However few pairs are held at a time."""
    rng = np.random.default_rng(4)
    e = np.zeros(200, dtype=linededup._ENTRY)
    e["id"], e["doc"], e["line"] = rng.permutation(200) - 100, rng.integers(0, 40, 200), rng.integers(0, 3, 200)
    i, j = rng.integers(0, 200, (2, 3000))
    old, linededup.FLUSH = linededup.FLUSH, 50
    try:
        u, v = linededup._earliest(e, ((i[k : k + 7], j[k : k + 7]) for k in range(0, 3000, 7)), 3, None)
    finally:
        linededup.FLUSH = old
    at = lambda k: (e["doc"][k], e["line"][k])
    want = {}
    for a, b in zip(i, j, strict=True):
        if at(a) != at(b):
            a, b = (a, b) if at(b) < at(a) else (b, a)
            want.setdefault(e["id"][a], set()).add((*at(b), e["id"][b]))
    got = {}
    for a, b in zip(u, v, strict=True):
        got.setdefault(e["id"][a], []).append((*at(b), e["id"][b]))
    assert got == {k: sorted(x)[:3] for k, x in want.items()}
