"""The driver ranker: features, leakage guard, training, gates and bounded fusion."""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import neg_log10_p
from gaugeworks.ml.calibration import Isotonic
from gaugeworks.ml.gbdt import BoostedTrees, FlatTrees, rows_by_group, sigmoid

#: Names that are known only after a decision and may never be features.
FORBIDDEN = frozenset((
    "validated_driver", "label", "y", "outcome_delta", "outcome_horizon", "realised_recovery_pct", "analyst_grade",
    "true_driver", "episode_truth", "ladder", "verdict", "verdict_status", "expected_rank",
))
DRIVER_TYPES = ("service_failure", "external_market", "price_change", "mix_shift", "instrumentation")
#: The features in their order.
FEATURES = (
    "share_abs", "share_signed", "share_shift_abs", "dim_surprise", "exposure_depth", "is_arithmetic_identity",
    "graph_path_len", "mechanism_lag_days", "driver_type_service_failure", "driver_type_external_market",
    "driver_type_price_change", "driver_type_mix_shift", "driver_type_instrumentation", "precedence_present",
    "precedence_consistent", "lag_alignment", "gap_days_norm", "dose_present", "dose_rho", "dose_p_neglog10",
    "dose_monotone", "dose_buckets", "corrob_on_theme_log", "corrob_independent_types",
    "corrob_distinct_accounts_log", "corrob_conflict_ratio", "corrob_evidence_withheld", "did_present",
    "did_effect_abs", "did_tstat_abs", "did_p_neglog10", "did_placebo_abs", "did_parallel_trends_ok",
    "did_n_days_post_log", "movement_z_abs", "movement_pct_abs", "movement_history_days_log", "movement_sparse",
    "movement_dq_flags", "feed_stale", "n_candidates_log", "analyst_prior_weight",
)
#: The most weight the model may have, and the share of odd features that makes a candidate out of distribution.
MAX_ALPHA, OOD_SHARE = 0.5, 0.25


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _given(c: str) -> Column:
    return F.col(c).isNotNull().cast("double")


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double")


def _log1p(c: str) -> Column:
    return F.log1p(F.greatest(_zero(c), F.lit(0.0)))




def feature_columns() -> dict[str, Column]:
    """The 42 features in their fixed order, over a flat row of a candidate (see candidate_schema)."""
    lag = _zero("mechanism_lag_days")
    aligned = F.when(F.col("gap_days").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("gap_days") - lag) / (lag + 10)))
    out = {
        "share_abs": F.abs(_zero("explanatory_power")), "share_signed": _zero("explanatory_power"), "share_shift_abs": F.abs(_zero("share_shift")), "dim_surprise": _zero("dim_surprise"),
        "exposure_depth": _zero("exposure_depth"), "is_arithmetic_identity": _yes("arithmetic_only"), "graph_path_len": _zero("path_len"), "mechanism_lag_days": lag,
        **{f"driver_type_{d}": F.coalesce((F.col("driver_type") == d), F.lit(False)).cast("double") for d in DRIVER_TYPES},
        "precedence_present": _given("precedence_consistent"), "precedence_consistent": _yes("precedence_consistent"), "lag_alignment": aligned, "gap_days_norm": _zero("gap_days") / 30.0,
        "dose_present": _given("dose_rho"), "dose_rho": _zero("dose_rho"), "dose_p_neglog10": F.when(F.col("dose_rho").isNull(), 0.0).otherwise(neg_log10_p(F.col("dose_p"))), "dose_monotone": _yes("dose_monotone"), "dose_buckets": _zero("dose_buckets"),
        "corrob_on_theme_log": _log1p("on_theme"), "corrob_independent_types": _zero("independent_types"), "corrob_distinct_accounts_log": _log1p("distinct_accounts"), "corrob_conflict_ratio": _zero("conflict_ratio"), "corrob_evidence_withheld": _zero("evidence_withheld"),
        "did_present": _given("did"), "did_effect_abs": F.abs(_zero("did")), "did_tstat_abs": F.least(F.lit(20.0), F.abs(_zero("did_t"))), "did_p_neglog10": F.when(F.col("did").isNull(), 0.0).otherwise(neg_log10_p(F.col("did_p"))), "did_placebo_abs": F.abs(_zero("did_placebo")), "did_parallel_trends_ok": _yes("did_parallel"), "did_n_days_post_log": _log1p("did_n_post"),
        "movement_z_abs": F.least(F.lit(30.0), F.abs(_zero("z"))), "movement_pct_abs": F.least(F.lit(5.0), F.abs(_zero("pct_change"))), "movement_history_days_log": _log1p("history_days"), "movement_sparse": _yes("sparse"), "movement_dq_flags": _zero("dq_flags"), "feed_stale": _yes("feed_stale"),
        "n_candidates_log": F.log1p(F.greatest(_zero("n_candidates") - 1, F.lit(0.0))), "analyst_prior_weight": F.coalesce(F.col("prior_weight").cast("double"), F.lit(1.0)),
    }
    assert_no_leakage(list(out))
    assert tuple(out) == FEATURES
    return out


#: Columns of a candidate row.
CANDIDATE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("episode_id", "candidate_id", "driver_type")]
    + [T.StructField(n, T.DoubleType()) for n in ("explanatory_power", "share_shift", "dim_surprise", "exposure_depth", "path_len", "mechanism_lag_days", "gap_days", "dose_rho", "dose_p", "dose_buckets", "on_theme", "independent_types", "distinct_accounts", "conflict_ratio", "evidence_withheld", "did", "did_t", "did_p", "did_placebo", "did_n_post", "z", "pct_change", "history_days", "dq_flags", "n_candidates", "prior_weight")]
    + [T.StructField(n, T.BooleanType()) for n in ("arithmetic_only", "precedence_consistent", "dose_monotone", "did_parallel", "sparse", "feed_stale")]
)


def assert_no_leakage(names: list[str]) -> None:
    bad = sorted({n.lower() for n in names} & FORBIDDEN)
    if bad:
        raise ValueError(f"features that are known only afterwards: {', '.join(bad)}")


def candidate_frame(spark, items: list[dict], movement: dict, episode: str = "run") -> DataFrame:  # noqa: ANN001
    """The hypotheses of one investigation (a few) as candidate rows with their heuristic score."""
    rows = []
    for x in items:
        h, tests = x["hyp"], x["grade"]["tests"]
        did, dose, pre, cor = (tests.get(k) or {} for k in ("counterfactual", "dose_response", "precedence", "corroboration"))
        row = {
            "episode_id": episode, "candidate_id": h["id"], "driver_type": h["driver_type"], "explanatory_power": h.get("explanatory_power"), "exposure_depth": float(len(h["exposure"])), "arithmetic_only": bool(h.get("arithmetic_only")),
            "path_len": float(len(x["grade"]["path"])), "mechanism_lag_days": x["grade"]["lag"], "precedence_consistent": pre.get("consistent"), "gap_days": pre.get("gap_days"), "dose_rho": dose.get("rho"), "dose_p": dose.get("p_value"),
            "on_theme": cor.get("on_theme"), "independent_types": cor.get("pairs"), "distinct_accounts": cor.get("accounts"), "conflict_ratio": cor.get("conflict_ratio"), "evidence_withheld": float(sum((cor.get("withheld") or {}).values())),
            "did": did.get("did"), "did_t": did.get("t_stat"), "did_p": did.get("p_value"), "did_placebo": did.get("placebo"), "did_n_post": did.get("n1"), "did_parallel": did.get("parallel"), "z": movement.get("z"), "pct_change": movement.get("pct_change"),
            "history_days": movement.get("history_days"), "sparse": movement.get("sparse"), "n_candidates": float(len(items)),
        }
        kinds = {f.name: f.dataType for f in CANDIDATE.fields}
        rows.append(tuple(None if row.get(n) is None else float(row[n]) if isinstance(t, T.DoubleType) else row[n] for n, t in kinds.items()) + (float(x["score"]),))
    return spark.createDataFrame(rows, T.StructType([*CANDIDATE.fields, T.StructField("heuristic", T.DoubleType())]))


def featurize(candidates: DataFrame) -> DataFrame:
    """candidates with all features as columns: the one function for training and serving."""
    return candidates.select("*", *[c.alias(f"f_{n}") for n, c in feature_columns().items()])


def snapshot_id(vector: np.ndarray) -> str:
    """16 hexadecimal digits of the vector to six significant digits."""
    return hashlib.sha256(",".join(f"{v:.6g}" for v in vector).encode()).hexdigest()[:16]


def snapshot_ids(features: DataFrame) -> DataFrame:
    names = [f"f_{n}" for n in FEATURES]

    @F.pandas_udf(T.StringType())
    def ids(vectors):  # noqa: ANN001
        import pandas as pd

        return pd.Series([snapshot_id(np.asarray(v)) for v in vectors])

    return features.withColumn("snapshot_id", ids(F.array(*names)))


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """label 1 where the episode has a true driver of the candidate's type and, if it names one, its entity."""
    t = truth.select("episode_id", F.col("driver_type").alias("_type"), F.col("entity").alias("_entity"))
    hit = (candidates["episode_id"] == t["episode_id"]) & (candidates["driver_type"] == t["_type"]) & (F.col("_entity").isNull() | (F.col("_entity") == F.col("candidate_id")))
    marked = candidates.join(t, hit, "left_semi").select("episode_id", "candidate_id").distinct().withColumn("label", F.lit(1))
    return candidates.join(marked, ["episode_id", "candidate_id"], "left").fillna(0, ["label"])


@dataclass
class Ranker:
    trees: FlatTrees
    calibration: Isotonic
    low: list[float]
    high: list[float]
    features: list[str]
    alpha: float = 0.35
    version: str = "1"

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees.to_json(), "knots": [self.calibration.x, self.calibration.y], "low": self.low, "high": self.high, "features": self.features, "alpha": self.alpha, "version": self.version})

    @classmethod
    def load(cls, text: str | None, version: str = "1") -> Ranker | None:
        """None without a card, of another contract version or with other features: then the heuristic ranks alone."""
        if not text:
            return None
        d = json.loads(text)
        if d["version"] != version or d["features"] != list(FEATURES):
            return None
        return cls(FlatTrees.from_json(d["trees"]), Isotonic(*d["knots"]), d["low"], d["high"], d["features"], d["alpha"], d["version"])

    def summary(self) -> dict:
        """What a card says at a glance."""
        return {"features": len(self.features), "trees": len(self.trees.roots), "depth": self.trees.depth, "alpha": self.alpha, "knots": len(self.calibration.x), "version": self.version}

    def outside(self, x: np.ndarray) -> np.ndarray:
        """Whether over OOD_SHARE of a candidate's features lie outside the training range."""
        return ((x < np.array(self.low)) | (x > np.array(self.high))).mean(axis=1) > OOD_SHARE

    def score(self, features: DataFrame) -> DataFrame:
        """features with raw, p and in_distribution; the card travels to the executors once."""
        card = features.sparkSession.sparkContext.broadcast(self.to_json())

        def run(frames):
            model = Ranker.load(card.value, json.loads(card.value)["version"])
            for f in frames:
                x = f[[f"f_{n}" for n in model.features]].to_numpy(float)
                raw = model.trees.raw(x)
                yield f[["episode_id", "candidate_id"]].assign(raw=raw, p=model.calibration.predict(sigmoid(raw)), in_distribution=~model.outside(x))

        return features.mapInPandas(run, "episode_id string, candidate_id string, raw double, p double, in_distribution boolean")


def fuse(df: DataFrame, alpha: float, heuristic: str = "heuristic", p: str = "p", ok: str = "in_distribution") -> DataFrame:
    """Within each episode: (1 - a) h / max h + a p / max p, a at most MAX_ALPHA. Candidates without a
    usable p keep h / max h; episodes without any keep h. `rank` is by the fused score, ties by order."""
    a = min(max(alpha, 0.0), MAX_ALPHA)
    w = Window.partitionBy("episode_id")
    usable = F.col(p).isNotNull() & F.coalesce(F.col(ok), F.lit(False))
    h = F.coalesce(F.try_divide(F.col(heuristic), F.max(heuristic).over(w)), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.when(usable, F.col(p)), F.max(F.when(usable, F.col(p))).over(w)), F.lit(0.0))
    any_ = F.max(usable.cast("int")).over(w) == 1
    out = df.withColumn("fused", F.when(~any_, F.col(heuristic)).when(usable, (1 - a) * h + a * q).otherwise(h))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("fused"), "candidate_id")))


def _whole_episodes(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows of the episodes of least hash, as many as max_rows rows hold (the first always)."""
    eps = rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64("episode_id"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_h", "episode_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = eps.withColumn("_before", before).where((F.col("_before") == 0) | (F.col("_before") + F.col("_n") <= max_rows))
    return rows.join(taken.select("episode_id"), "episode_id", "left_semi")


def train(features: DataFrame, labels: str = "label", objective: str = "lambdarank", max_rows: int = 100_000, grid=None, version: str = "1") -> tuple[Ranker, dict]:
    """Time split, grid by NDCG@3 on the calibration part, isotonic fit there, one pass over the test part.

    features: episode_id, candidate_id, window_start, label, f_... A train part of up to max_rows rows is
    fitted on the driver, a larger one where it lies (ml.spread): either way on all its rows. Early
    stopping looks at whole episodes of the calibration part, those of least hash, at most max_rows rows.
    The split, the choice from the grid, the isotonic fit, the out-of-distribution bounds and the test
    measure read all rows, in Spark."""
    from gaugeworks.ml.spread import SpreadTrees
    from gaugeworks.ml.calibration import fit_distributed
    from gaugeworks.ml.metrics import ndcg, time_split

    names = list(FEATURES)
    split = time_split(features).where(F.col("episode_id").isNotNull()).cache()
    spread = split.where("part = 'train'").limit(max_rows + 1).count() > max_rows
    local = {k: (split.where("false") if spread and k == "train" else _whole_episodes(split.where(F.col("part") == k), max_rows)).toPandas().sort_values(["window_start", "episode_id", "candidate_id"]) for k in ("train", "calib")}
    codes = lambda r: r["episode_id"].astype("category").cat.codes.to_numpy()  # noqa: E731  in the order of the names
    x, y, g = ({k: f(v) for k, v in local.items()} for f in (lambda r: r[[f"f_{n}" for n in names]].to_numpy(float), lambda r: r[labels].to_numpy(float), codes))
    weight = local["train"]["weight"].to_numpy(float) if "weight" in local["train"] else None
    valid = lambda m: _ndcg(y["calib"], m.raw(x["calib"]), g["calib"])
    columns = F.array(*[F.col(f"f_{n}").cast("double") for n in names])

    def scored(m: FlatTrees, part: str) -> DataFrame:
        card = split.sparkSession.sparkContext.broadcast(m.to_json())

        @F.pandas_udf("double")
        def raw(vectors):  # noqa: ANN001
            import pandas as pd

            return pd.Series(FlatTrees.from_json(card.value).raw(np.stack(vectors.to_list())) if len(vectors) else [], dtype=float)

        return split.where(F.col("part") == part).select("episode_id", "candidate_id", F.col(labels).cast("double").alias("label"), raw(columns).alias("score"))

    measure = lambda m, part: float(ndcg(scored(m, part)).first()["ndcg"] or 0.0)
    best = None
    for depth, rate, child in grid or itertools.product((3, 4), (0.05, 0.10), (2, 6)):
        chosen = {"objective": objective, "rounds": 400 if grid is None else 60, "depth": depth, "rate": rate, "min_child_weight": child * (0.01 if objective == "lambdarank" else 1), "early_stop": 60, "row_share": 0.8, "column_share": 0.8}
        if spread:
            m = SpreadTrees(**chosen).fit(split.where("part = 'train'"), [f"f_{n}" for n in names], labels, "episode_id", "weight" if "weight" in split.columns else None, valid, "candidate_id")
        else:
            m = BoostedTrees(**chosen).fit(x["train"], y["train"], g["train"], weight, valid)
        score = measure(m, "calib")
        if best is None or score > best[0]:
            best = (score, m)
    model = best[1]
    fitted = scored(model, "calib").select("label", (1 / (1 + F.exp(-F.col("score")))).alias("score"))
    iso = fit_distributed(fitted) if fitted.limit(1).count() else Isotonic([], [])
    bounds = split.where(F.col("part") == "train").agg(*[F.percentile_approx(F.col(f"f_{n}").cast("double"), [0.01, 0.99], 100_000).alias(n) for n in names]).first()
    low, high = ([float(bounds[n][k]) for n in names] for k in (0, 1))
    ranker = Ranker(model, iso, low, high, names, version=version)
    seen = split.agg(F.countDistinct("episode_id").alias("episodes"), F.count(F.lit(1)).alias("rows")).first()
    out = {"calib_ndcg": best[0], "test_ndcg": measure(model, "test"), "episodes": seen["episodes"], "rows": seen["rows"]}
    split.unpersist()
    return ranker, out


def _ndcg(y: np.ndarray, s: np.ndarray, groups: np.ndarray, k: int = 3) -> float:
    out = []
    for r in rows_by_group(groups):
        ideal = np.sort(y[r])[::-1][:k]
        if ideal.sum() > 0:
            d = np.log2(np.arange(2, len(ideal) + 2))
            out.append((y[r][np.argsort(-s[r], kind="stable")][:k] / d).sum() / (ideal / d).sum())
    return float(np.mean(out)) if out else 0.0


#: Weights of the model that choose_alpha tries.
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)


def choose_alpha(candidates: DataFrame, k: int = 3) -> tuple[float, dict[float, float]]:
    """candidates: heuristic, p, in_distribution, label of episodes set aside. The weight of the model of
    best mean NDCG after fusion (of equals the least), and what each gave."""
    from gaugeworks.ml.metrics import ndcg

    tried = {a: float(ndcg(fuse(candidates, a), k, score="fused").first()["ndcg"] or 0.0) for a in ALPHAS}
    return max(ALPHAS, key=lambda a: (tried[a], -a)), tried


def scorecard(measures: dict[str, float], kinds: list[dict], recall: list[dict]) -> str:
    """A model's measures as text: ranking, calibration, by driver type, recall of candidates."""
    width = max(map(len, measures), default=0)
    lines = ["Driver ranker", *(f"  {n:<{width}}  {v:.4f}" for n, v in measures.items()), "top-1 by true driver"]
    lines += [f"  {r['true_type']}: {r['top1']:.3f} of {r['episodes']} episodes" for r in sorted(kinds, key=lambda r: r["true_type"])]
    lines += ["candidate recall", *(f"  {r['driver_type']}: {r['recall']:.3f}" for r in sorted(recall, key=lambda r: r["driver_type"]))]
    return "\n".join(lines)


class RankerCache:
    """The ranker of a card file, loaded again only when the file has changed."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[int, Ranker | None]] = {}

    def get(self, path: str, version: str = "1") -> Ranker | None:
        import os

        try:
            at = os.stat(path).st_mtime_ns
        except FileNotFoundError:
            return None
        if self._held.get(path, (None,))[0] != at:
            with open(path, encoding="utf-8") as f:
                self._held[path] = (at, Ranker.load(f.read(), version))
        return self._held[path][1]
