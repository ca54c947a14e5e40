"""BM25 retrieval over text evidence, corroboration counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import tokens
from gaugeworks.sources.store import stored

#: Term saturation and length weight.
K1, B = 1.5, 0.75
#: The theme of evidence that speaks for a driver type, and the words it is looked for by.
THEMES = {
    "service_failure": ("service_failure", ["late", "delay", "delayed", "delivery", "dispatch", "missed", "waiting"]),
    "external_market": ("competitor_activity", ["competitor", "promo", "scheme", "offer", "switched"]),
    "price_change": ("price_objection", ["price", "expensive", "discount", "cheaper", "cost"]),
    "mix_shift": ("price_objection", ["price", "discount", "premium", "tier"]),
}
#: Themes that speak for one cause or another; others, as routine, neither speak for nor against.
RIVALS = ("service_failure", "price_objection", "competitor_activity")


def _is(term: str):
    return lambda w: w == F.lit(term)


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every document with a positive score; repeated query terms count each time.

    Documents without tokens are in the corpus too. Only rows of query terms leave a document, so
    what is shuffled does not grow with the texts; the statistics of terms are as many as the query's.
    """
    terms = sorted(set(query))
    weight = {t: query.count(t) for t in terms}
    # a row of numbers a document is all that is kept of the texts: they are read once, their words gone over once
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    found = words.select(key, F.size("w").alias("dl"), F.filter("w", lambda w: w.isin(terms)).alias("hits"))
    per = stored(found.select(key, "dl", *[F.size(F.filter("hits", _is(t))).alias(f"tf_{i}") for i, t in enumerate(terms)]), "term-counts")
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df = stats[f"df_{i}"]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        tf = F.col(f"tf_{i}").cast("double")
        score = score + F.lit(weight[t] * idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["avgdl"] or 1.0))))
    return per.select(key, score.alias("score")).where("score > 0")


def top_evidence(scored: DataFrame, visible: DataFrame, key: str = "doc_id", k: int = 12) -> DataFrame:
    """The best 3k, of these those that the reader may see, of these the best k."""
    best = scored.orderBy(F.desc("score"), key).limit(3 * k)
    return best.join(visible.select(key), key, "left_semi").orderBy(F.desc("score"), key).limit(k)


def corroboration(evidence: DataFrame, theme: str) -> DataFrame:
    """On-theme documents, independent (role, type) pairs, accounts, and the share of other themes."""
    on = F.col("theme") == theme
    out = evidence.agg(F.count_if(on).alias("on_theme"), F.countDistinct(F.when(on, F.struct("author_role", "type"))).alias("pairs"), F.countDistinct(F.when(on, F.col("account_id"))).alias("accounts"), F.count_if(~on & (F.col("theme") != "routine")).alias("conflicting"))
    ratio = F.coalesce(F.try_divide("conflicting", F.col("on_theme") + F.col("conflicting")), F.lit(0.0))
    return out.withColumn("conflict_ratio", ratio).withColumn("corroborated", (F.col("on_theme") >= 3) & (F.col("pairs") >= 2) & (F.col("accounts") >= 2) & (ratio < 0.4))


def theme_mix(evidence: DataFrame, column: str = "theme") -> DataFrame:
    return evidence.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def overlapping_events(events: DataFrame, ws, we, lag_days: int = 14) -> DataFrame:
    """Events that touch the window or the lag before it."""
    return events.where((F.col("start_date") <= F.lit(we)) & (F.col("end_date") >= F.date_sub(F.lit(ws), lag_days)))


def evidence_for(driver_type: str, evidence: DataFrame, persona, key: str = "doc_id", k: int = 12) -> dict | None:
    """Corroboration of a driver type by the evidence that the reader may see: the best k by BM25 on the
    theme's words, and how much of it was withheld, by reason. None where a type has no theme."""
    from gaugeworks.operators.security import filter_evidence

    if driver_type not in THEMES:
        return None
    theme, words = THEMES[driver_type]
    judged = filter_evidence(evidence, persona)
    hidden = {r["withheld_reason"]: r["n"] for r in judged.where("withheld_reason IS NOT NULL").groupBy("withheld_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = top_evidence(bm25(evidence, words, key), judged.where("withheld_reason IS NULL"), key, k)
    found = corroboration(evidence.join(best.select(key), key, "left_semi"), theme).first().asDict()
    return found | {"withheld": hidden}
