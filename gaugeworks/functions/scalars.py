"""Scalar functions: null-safe arithmetic, text, hashes, probabilities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that retrieval ignores.
STOP_WORDS = ("the a an and or of to in on for with is was be been are at by from that this it as we they our their he she has have had not no but if then than so").split()
#: Patterns of phone numbers and e-mail addresses.
PHONE = r"(\+91[\-\s]?)?[6-9]\d{9}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Fixed value: numbers in a narrative, with thousands separators, not inside a word.
NUMBER = r"(?<![\w/])(\d{1,3}(?:,\d{2,3})*(?:\.\d+)?|\d+(?:\.\d+)?)(?![\w])"
#: Confidence and order of the evidence ladder.
LADDER_CONFIDENCE = {"L3": 0.85, "L2": 0.65, "L1": 0.40, "L0": 0.20, "REJECTED": 0.0}
LADDER_RANK = {"L3": 3, "L2": 2, "L1": 1, "L0": 0, "REJECTED": -1}


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def tokens(text: Column) -> Column:
    """Lower-case words of three or more characters that are no stop words, with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def scrub_pii(text: Column) -> Column:
    """Phone numbers and addresses replaced by a mark."""
    return F.regexp_replace(F.regexp_replace(text, PHONE, "[phone]"), EMAIL, "[email]")


def format_inr(x: Column) -> Column:
    """Crores from ten million on, lakhs from a hundred thousand on, else whole rupees."""
    a = F.abs(x)
    return F.when(a >= 1e7, F.format_string("Rs %.2f Cr", x / 1e7)).when(a >= 1e5, F.format_string("Rs %.1f L", x / 1e5)).otherwise(F.format_string("Rs %.0f", x))


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case words joined by hyphens, cut to `most` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def neg_log10_p(p: Column) -> Column:
    """-log10 of a p-value, 12 at most; 0 for null."""
    return F.coalesce(F.least(F.lit(12.0), -F.log10(F.greatest(p, F.lit(1e-12)))), F.lit(0.0))


def fingerprint(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, digits)


def ladder_confidence(rung: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LADDER_CONFIDENCE.items() for x in kv])[rung]


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(t):  # noqa: ANN001
    """2 (1 - Phi(|t|)); Spark has no error function, so Arrow batches go through math.erfc."""
    return t.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def student_two_sided_p(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 200):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-13:
                break
        return out

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def interpolate(x: np.ndarray, knots_x: list[float], knots_y: list[float]) -> np.ndarray:
    """Piecewise linear, flat beyond the ends."""
    return np.interp(x, knots_x, knots_y)
