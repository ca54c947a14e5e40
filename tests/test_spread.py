"""Trees grown on the executors equal those of the local trainer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.ml import gbdt, ranker, spread


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.round(rng.normal(size=n), 1), np.ones(n), rng.random(n)], axis=1)
    x[::17, 4] = np.nan
    y = (x[:, 0] + 0.5 * x[:, 1] - x[:, 2] + rng.normal(size=n) > 1).astype(float)
    groups = np.array([f"e{k // 6:03}" for k in range(n)])
    df = spark.createDataFrame([(f"{k:04}", g, float(t), *[None if np.isnan(v) else float(v) for v in r]) for k, (g, t, r) in enumerate(zip(groups, y, x, strict=True))], "k string, g string, y double, a double, b double, c double, d double, e double").repartition(5)
    return df, x, y, groups


def test_bin_edges_equal_the_local_ones(table):
    df, x, _, _ = table
    got = spread.bin_edges(df.select(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in "abcde"]).alias("x")), "x", 5, 16)
    for j in range(5):
        assert got[j] == pytest.approx(gbdt.bin_edges(x[:, j], 16))


@pytest.mark.parametrize("objective", ["logistic", "lambdarank"])
def test_trees_equal_the_local_ones(table, objective):
    df, x, y, groups = table
    how = {"objective": objective, "rounds": 3, "depth": 3, "bins": 16, "min_child_weight": 0.05, "column_share": 0.8}
    local = gbdt.BoostedTrees(**how).fit(x, y, groups)
    other = spread.SpreadTrees(**how)
    far = other.fit(df, list("abcde"), "y", "g", order="k")
    for k in ("feature", "left", "right", "roots"):
        assert (getattr(local, k) == getattr(far, k)).all(), k
    assert far.threshold == pytest.approx(local.threshold) and far.value == pytest.approx(local.value) and far.base == pytest.approx(local.base)
    assert far.raw(x) == pytest.approx(local.raw(x))


def test_a_large_train_part_is_fitted_where_it_lies(spark):
    from gaugeworks.plans.catalogue import _candidates

    rows = ranker.featurize(_candidates(spark, "/root/testdata/sf0.001"))
    model, seen = ranker.train(rows, grid=((2, 0.3, 2),), max_rows=50)
    assert len(model.trees.roots) and 0 <= seen["test_ndcg"] <= 1


def test_no_rows_give_no_trees(table):
    df = table[0]
    assert len(spread.SpreadTrees(rounds=2).fit(df.limit(0), list("abcde"), "y", "g").roots) == 0


def test_scores_are_folded_into_the_rows(table, monkeypatch):
    """No round goes through FOLD past trees or more, and the trees stay the same."""
    df, x, y, groups = table
    monkeypatch.setattr(spread, "FOLD", 2)
    past, old = [], spread.SpreadTrees._grow
    monkeypatch.setattr(spread.SpreadTrees, "_grow", lambda self, binned, edges, before, *a: past.append(len(before)) or old(self, binned, edges, before, *a))
    how = {"objective": "lambdarank", "rounds": 5, "depth": 2, "bins": 16, "min_child_weight": 0.05}
    far = spread.SpreadTrees(**how).fit(df, list("abcde"), "y", "g", order="k")
    assert past == [0, 1, 0, 1, 0]
    assert far.raw(x) == pytest.approx(gbdt.BoostedTrees(**how).fit(x, y, groups).raw(x))


def test_groups_cost_one_sort():
    """Many groups: neither the gradients nor the measure compare all rows with each group."""
    import time

    rng = np.random.default_rng(5)
    n = 100_000
    y, s, groups = (rng.random(n) < 0.2).astype(float), rng.random(n), np.array([f"E{k}" for k in rng.integers(0, 10_000, n)], dtype=object)
    t = time.process_time()
    got = ranker._ndcg(y, s, groups)
    assert time.process_time() - t < 5
    one = [r for r in gbdt.rows_by_group(groups) if y[r].sum()]
    dcg = lambda v: (v[:3] / np.log2(np.arange(2, min(len(v), 3) + 2))).sum()
    assert got == pytest.approx(np.mean([dcg(y[r][np.argsort(-s[r])]) / dcg(np.sort(y[r])[::-1]) for r in one]))
