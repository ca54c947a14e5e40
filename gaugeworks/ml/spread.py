"""Boosted trees grown where the rows are: bin edges, gradients and histograms on the executors.

The driver sees sums only: per level of a tree, gradient sums by (node, feature, bin). Rows lie binned
in a shared table, whole episodes in one partition, so the pairs that LambdaRank compares meet in one
task. The trees are those of gbdt.BoostedTrees on the same rows, but for the order of summation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.ml.gbdt import FlatTrees, lambdarank_gradients, logistic_gradients
from gaugeworks.sources.store import numbered, stored


def bin_edges(rows: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """Cut points of each of `width` features: those of gbdt.bin_edges, from counts of distinct values.

    Values are numbered in ranges of (feature, value), so no feature is one task; a cut ends the first
    run of equal values that reaches its share of the rows, and lies halfway to the next value. What
    comes to the driver is `bins` numbers a feature at most."""
    flat = rows.select(F.posexplode(features).alias("j", "x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    counts = stored(flat.groupBy("j", "x").agg(F.count(F.lit(1)).alias("n")), "bin-counts")
    runs = stored(numbered(numbered(counts, ["j", "x"]).withColumnRenamed("before", "run"), ["j", "x"], "n"), "bin-runs")
    totals = runs.groupBy("j").agg(F.sum("n").alias("rows"), F.min("before").alias("first"), F.max("run").alias("last"))
    own = runs.join(F.broadcast(totals), "j").withColumn("end", F.col("before") - F.col("first") + F.col("n") - 1)
    # shares of the rows that are reached by the end of a run: i of rows * i // bins - 1 <= end
    reached = lambda e: F.least(F.lit(bins - 1), F.expr(f"(({e} + 2) * {bins} - 1) div rows"))
    start = F.when(F.col("before") == F.col("first"), F.lit(0)).otherwise(reached("(end - n)"))
    cut = (reached("end") > start) | ((F.col("run") == F.col("last") - 1) & (reached("end") < bins - 1))
    chosen = own.where((F.col("run") < F.col("last")) & cut).select("j", "x", (F.col("run") + 1).alias("run"))
    after = chosen.join(runs.select("run", F.col("x").alias("y")), "run")
    out: list[list[float]] = [[] for _ in range(width)]
    for r in after.orderBy("j", "x").collect():
        out[r["j"]].append(r["x"] + (r["y"] - r["x"]) * 0.5)
    return [np.array(x) for x in out]


#: Rounds after which the scores so far are written into the rows: no round goes through more past trees.
FOLD = 8


@dataclass
class SpreadTrees:
    """Trainer with the parameters of gbdt.BoostedTrees."""

    objective: str = "logistic"
    rounds: int = 60
    depth: int = 4
    rate: float = 0.1
    reg_lambda: float = 2.0
    gamma: float = 0.0
    bins: int = 64
    min_leaf: int = 8
    min_child_weight: float = 4.0
    row_share: float = 1.0
    column_share: float = 1.0
    early_stop: int = 0
    seed: int = 7
    gains: np.ndarray = field(default=None, repr=False)

    def fit(self, rows: DataFrame, features: list[str], label: str, group: str, weight: str | None = None, valid=None, order: str | None = None) -> FlatTrees:  # noqa: ANN001
        """rows: feature columns, label, group (rows of one are compared by lambdarank; a group is one
        decision's few candidates) and perhaps weight. Null features count as missing: they go right.
        valid: FlatTrees to a number, higher is better; early_stop rounds without gain end the fit.
        order: what parts rows of a group with equal scores (else their features do).

        With row_share, whole groups are drawn anew each round by hash. An empty table gives no trees."""
        vector = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features])
        plain = rows.select(F.col(group).cast("string").alias("grp"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), vector.alias("x"), (F.col(order).cast("string") if order else F.lit("")).alias("o"))
        m = len(features)
        self.gains = np.zeros(m)
        total = plain.agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w")).first()
        share = float(np.clip((total["wy"] or 0.0) / total["w"], 1e-6, 1 - 1e-6)) if total["w"] else 0.5
        base = float(np.log(share / (1 - share))) if self.objective == "logistic" else 0.0
        none = np.zeros(0, dtype=np.int64)
        if not total["w"]:
            return FlatTrees(none, np.zeros(0), none, none, np.zeros(0), none, self.depth, base)
        edges = bin_edges(plain, "x", m, self.bins)
        binned = stored(plain.repartition("grp").sortWithinPartitions("grp", "o", "x", "y", "w").mapInArrow(_binner(edges, base), _BINNED), "binned")
        folded = 0
        trees: list[dict[str, list]] = []
        rng, best, best_at = np.random.default_rng(self.seed), -np.inf, 0
        for turn in range(self.rounds):
            if self.row_share < 1:
                rng.random()
            columns = np.sort(rng.choice(m, max(1, round(m * self.column_share)), replace=False))
            if len(trees) - folded == FOLD:
                binned = stored(binned.mapInArrow(_folder(trees[folded:], self.depth), _BINNED), "binned")
                folded = len(trees)
            trees.append(self._grow(binned, edges, trees[folded:], columns, turn))
            if self.early_stop and valid is not None:
                score = valid(self._flat(trees, base))
                if score > best + 1e-12:
                    best, best_at = score, len(trees)
                elif len(trees) - best_at >= self.early_stop:
                    break
        return self._flat(trees[:best_at] if self.early_stop and valid is not None and best_at else trees, base)

    def _grow(self, binned: DataFrame, edges: list[np.ndarray], before: list[dict], columns: np.ndarray, turn: int) -> dict:
        """One tree, a level a job: sums by (node, feature, bin) of the open nodes come to the driver. before:
        the trees that are not yet in the rows' scores."""
        tree: dict[str, list] = {k: [] for k in ("feature", "cut", "threshold", "left", "right", "value")}
        width = max((len(e) for e in edges), default=0) + 1

        def add(g: float, h: float) -> int:
            me = len(tree["value"])
            for key, v in (("feature", 0), ("cut", width), ("threshold", np.inf), ("left", me), ("right", me), ("value", -self.rate * g / (h + self.reg_lambda))):
                tree[key].append(v)
            return me

        add(0.0, 0.0)
        opened = [0]
        for level in range(self.depth + 1):
            sums = self._sums(binned, before, tree, turn, opened, columns, level == self.depth)
            if level == 0:
                g, h, _ = sums[0]["all"]
                tree["value"][0] = -self.rate * g / (h + self.reg_lambda)
            if level == self.depth:
                break
            further = []
            for me in opened:
                total_g, total_h, total_n = sums[me]["all"]
                if total_n < 2 * self.min_leaf:
                    continue
                left_g, left_h, left_n = (sums[me][k].reshape(len(columns), -1).cumsum(axis=1) for k in "ghn")
                score = lambda a, b: a * a / (b + self.reg_lambda)
                gain = 0.5 * (score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)) - self.gamma
                fits = (left_n >= self.min_leaf) & (total_n - left_n >= self.min_leaf) & (left_h >= self.min_child_weight) & (total_h - left_h >= self.min_child_weight)
                gain = np.where(fits, gain, -np.inf)
                k, cut = np.unravel_index(np.argmax(gain), gain.shape)
                j = int(columns[k])
                if not gain[k, cut] > 1e-12 or cut >= len(edges[j]):
                    continue
                self.gains[j] += gain[k, cut]
                left, right = add(left_g[k, cut], left_h[k, cut]), add(total_g - left_g[k, cut], total_h - left_h[k, cut])
                tree["feature"][me], tree["cut"][me], tree["threshold"][me], tree["left"][me], tree["right"][me] = j, int(cut), float(edges[j][cut]), left, right
                further += [left, right]
            opened = further
            if not opened:
                break
        return _in_preorder(tree)

    def _sums(self, binned: DataFrame, before: list[dict], tree: dict, turn: int, opened: list[int], columns: np.ndarray, nothing: bool) -> dict:
        """all (g, h, n) and the histograms g, h, n of every open node."""
        if nothing:
            return {}
        spark, share, objective, depth = binned.sparkSession, self.row_share, self.objective, self.depth
        state = spark.sparkContext.broadcast((before, {k: list(v) for k, v in tree.items()}))
        width = 1 + self.bins
        size = width * len(columns)

        def run(batches):
            past, now = state.value
            sums = {node: np.zeros((3, size)) for node in opened}
            for groups, y, w, b, raw in _whole_groups(batches):
                raw = _added(raw, past, b, depth)
                g, h = logistic_gradients(y, raw) if objective == "logistic" else lambdarank_gradients(y, raw, groups)
                g, h = g * w, h * w
                node = _leaves(now, b, depth)
                if share < 1:
                    node = np.where(_drawn(groups, turn, share), node, -1)
                for me in opened:
                    at = np.flatnonzero(node == me)
                    slot = (b[np.ix_(at, columns)].astype(np.int64) + np.arange(len(columns)) * width).ravel()
                    for i, v in enumerate((g, h, np.ones(len(y)))):
                        sums[me][i] += np.bincount(slot, weights=np.repeat(v[at], len(columns)), minlength=size)
            for me in opened:
                used = np.flatnonzero(sums[me][2])
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), me, np.int32)), pa.array(used.astype(np.int32)), *(pa.array(sums[me][i][used]) for i in range(3))], names=["node", "slot", "g", "h", "n"])

        found = binned.mapInArrow(run, "node int, slot int, g double, h double, n double").groupBy("node", "slot").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        state.destroy()
        node, slot = np.asarray(found.column("node")), np.asarray(found.column("slot"))
        out = {}
        for me in opened:
            at, own = node == me, {}
            for c in "ghn":
                own[c] = np.zeros(size)
                own[c][slot[at]] = np.asarray(found.column(c))[at]
            own["all"] = tuple(float(own[c][:width].sum()) for c in "ghn")
            out[me] = own
        return out

    def _flat(self, trees: list[dict], base: float) -> FlatTrees:
        """The trees one after the other; children's places move with their tree."""
        starts = np.cumsum([0, *(len(t["value"]) for t in trees)])[:-1]
        join = lambda k, kind, move: np.concatenate([np.asarray(t[k], dtype=kind) + (s if move else 0) for t, s in zip(trees, starts, strict=True)]) if trees else np.zeros(0, kind)
        return FlatTrees(join("feature", np.int64, False), join("threshold", float, False), join("left", np.int64, True), join("right", np.int64, True), join("value", float, False), starts.astype(np.int64), self.depth, base)


_BINNED = "grp string, y double, w double, b binary, raw double"


def _added(raw: np.ndarray, trees: list[dict], b: np.ndarray, depth: int) -> np.ndarray:
    """Scores with those of further trees, one after the other."""
    raw = raw.copy()
    for t in trees:
        raw += np.asarray(t["value"])[_leaves(t, b, depth)]
    return raw


def _folder(trees: list[dict], depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, _, b, raw = _arrays(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(_added(raw, trees, b, depth))], names=["grp", "y", "w", "b", "raw"])

    return run


def _binner(edges: list[np.ndarray], base: float):
    def run(batches):
        for b in batches:
            x = np.asarray(b.column(3).flatten(), dtype=np.float64).reshape(-1, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype("<u2")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(np.full(len(bins), base))], names=["grp", "y", "w", "b", "raw"])

    return run


def _whole_groups(batches):
    """groups, y, w, bins, scores so far of whole groups at a time: the last group of a batch waits for the next."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        held.append(t)
        groups = t.column("grp").to_pylist()
        if not groups or groups[0] == groups[-1]:
            continue
        last = len(groups) - next(i for i, k in enumerate(reversed(groups)) if k != groups[-1])
        whole = pa.concat_tables([*held[:-1], t.slice(0, last)])
        held = [t.slice(last)]
        yield _arrays(whole)
    if held and sum(map(len, held)):
        yield _arrays(pa.concat_tables(held))


def _arrays(t: pa.Table):
    bins = np.frombuffer(b"".join(t.column("b").to_pylist()), dtype="<u2").reshape(len(t), -1)
    return np.array(t.column("grp").to_pylist(), dtype=object).astype(str), np.asarray(t.column("y")), np.asarray(t.column("w")), bins, np.asarray(t.column("raw"))


def _leaves(tree: dict, b: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row."""
    feature, cut, left, right = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "right"))
    node, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
    for _ in range(depth):
        node = np.where(b[rows, feature[node]] <= cut[node], left[node], right[node])
    return node


def _drawn(groups: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Whether each row's group takes part in a round: the same wherever the row lies."""
    import zlib

    names, at = np.unique(groups, return_inverse=True)
    return np.array([zlib.crc32(f"{turn}|{g}".encode()) < share * 2**32 for g in names])[at]


def _in_preorder(tree: dict) -> dict:
    """Nodes numbered as a walk meets them: parent, left, right."""
    order: list[int] = []
    todo = [0]
    while todo:
        me = todo.pop()
        order.append(me)
        if tree["left"][me] != me:
            todo += [tree["right"][me], tree["left"][me]]
    place = {old: new for new, old in enumerate(order)}
    return {k: [place[tree[k][i]] if k in ("left", "right") else tree[k][i] for i in order] for k in tree}
