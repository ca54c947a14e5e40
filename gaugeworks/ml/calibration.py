"""Isotonic calibration by pooling adjacent violators, and its knots."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Probabilities are never surer than this.
CLIP = (0.001, 0.999)


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks]) if blocks else np.zeros(0)


@dataclass
class Isotonic:
    x: list[float]
    y: list[float]

    @classmethod
    def fit(cls, scores, labels, weights=None) -> Isotonic:
        scores, labels = np.asarray(scores, float), np.asarray(labels, float)
        order = np.argsort(scores, kind="stable")
        fitted = pool_adjacent_violators(labels[order], (np.ones(len(scores)) if weights is None else np.asarray(weights, float))[order])
        s = scores[order]
        keep = np.ones(len(s), dtype=bool)
        if len(s) > 2:
            keep[1:-1] = (fitted[1:-1] != fitted[:-2]) | (fitted[1:-1] != fitted[2:])
        return cls(s[keep].tolist(), fitted[keep].tolist())

    def predict(self, scores) -> np.ndarray:
        if not self.x:
            return np.full(len(scores), 0.5)
        return np.clip(np.interp(np.asarray(scores, float), self.x, self.y), *CLIP)


def fit_distributed(df: DataFrame, label: str = "label", score: str = "score") -> Isotonic:
    """The same fit on a table of any size: Spark pools equal scores, and the boundaries are the knots."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[score], outputCol="_x").transform(df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))
    m = IsotonicRegression(featuresCol="_x", labelCol=label).fit(rows)
    return Isotonic(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist())


def calibrate(df: DataFrame, model: Isotonic, score: str = "score") -> DataFrame:
    knots_x, knots_y = model.x, model.y

    @F.pandas_udf(T.DoubleType())
    def p(s):  # noqa: ANN001
        import pandas as pd

        return pd.Series(Isotonic(knots_x, knots_y).predict(s))

    return df.withColumn("p", p(F.col(score).cast("double")))
