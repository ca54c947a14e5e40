"""URL filter: character language-model ratio of accepted and rejected URLs, after domain rules."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialise, table

#: The rules of the contract, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Seed words that mark a host's label as rejected where a table has no rejected or no accepted URLs of
#: its own (gambling, advertising, scams, adult).
REJECT_WORDS = ("casino", "bet", "bets", "poker", "slots", "lotto", "ads", "track", "tracker", "click", "popup", "pills", "viagra", "xxx", "porn", "spam", "cheap", "loan", "loans", "replica", "crack", "warez")
#: Longest context in bytes; a gram is a context and its successor, packed with the successor lowest.
ORDER = 5
#: Absolute discount of the back-off, and the size of the alphabet at its end.
DISCOUNT, ALPHABET = 0.75, 256
#: Thresholds are set on this share of labelled URLs (crc32 of the URL mod CALIBRATE), never trained on.
CALIBRATE = 5


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to `?`, `#` or the end; empty without `://`."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, path prefix) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(url: bytes) -> np.ndarray:
    """Each byte of url with the ORDER bytes in front of it (zeros before the start), as one number."""
    text = np.frombuffer(b"\0" * ORDER + url, dtype=np.uint8).astype(np.int64)
    return sum(text[ORDER - k : len(text) - k] << (8 * k) for k in range(ORDER + 1))


class Model:
    """Exact counts of grams (counts: gram, accepted, rejected) in one of its columns; probabilities
    interpolate from the empty context to the longest, each with the weight that its evidence earns."""

    def __init__(self, counts: DataFrame, column: str) -> None:
        self.counts, self.column = counts, column


def gram_ratios(wanted: DataFrame, accepted: Model, rejected: Model) -> DataFrame:
    """gram, value: the log-likelihood difference of each distinct gram of wanted. It depends on the
    gram alone, so contexts and successors are joined once for it and not for every place."""
    out = wanted.select("gram")
    p = [F.lit(1.0 / ALPHABET)] * 2
    sums = [F.sum(accepted.column).alias("_a"), F.sum(rejected.column).alias("_r")]
    for k in range(ORDER + 1):
        named = lambda kind, k=k: [F.col(c).alias(f"{kind}{c}{k}") for c in ("_a", "_r")]
        pair = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        out = out.withColumn("_pair", pair).join(accepted.counts.groupBy(pair.alias("_pair")).agg(*sums).select("_pair", *named("hit")), "_pair", "left").drop("_pair")
        if k:
            context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1))
            out = out.withColumn("_context", context).join(accepted.counts.groupBy(context.alias("_context")).agg(*sums).select("_context", *named("seen")), "_context", "left").drop("_context")
        else:
            out = out.crossJoin(F.broadcast(accepted.counts.agg(*sums).select(*named("seen"))))
        for m, c in enumerate(("_a", "_r")):
            seen, hit = (F.coalesce(F.col(f"{kind}{c}{k}"), F.lit(0)).cast("double") for kind in ("seen", "hit"))
            weight = seen / (seen + 4.0)
            p[m] = weight * F.least(F.lit(1.0), F.greatest(hit - DISCOUNT, F.lit(0.0)) / F.greatest(seen, F.lit(1.0))) + (1 - weight) * p[m]
    floor = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    return out.select("gram", (floor(p[0]) - floor(p[1])).alias("value"))


def ratio(url: bytes, accepted: Model, rejected: Model) -> float:
    """Mean log-likelihood difference per byte; 0 for an empty URL. Above 0: looks accepted."""
    if not url:
        return 0.0
    kinds, n = np.unique(grams(url), return_counts=True)
    rows = accepted.counts.sparkSession.createDataFrame([(int(g),) for g in kinds], "gram long")
    value = {r["gram"]: r["value"] for r in gram_ratios(rows, accepted, rejected).collect()}
    return float(sum(value[int(g)] * int(k) for g, k in zip(kinds, n, strict=True)) / n.sum())


#: A host, its last label, and the rest.
_URL_PARTS = re.compile(r"(?s)([^/?#]*?)(\.?[^./?#]*)((?:[/?#].*)?)")
_DIGITS = str.maketrans("123456789", "000000000")


def _scored_text(url: str | None) -> bytes:
    """What the models read: a URL without scheme and without the last label of its host. Rules allow or block
    whole domains by that label, so it would tell their verdicts. Digits are one class."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, _, path = _URL_PARTS.fullmatch(rest).groups()
    return (host + path).translate(_DIGITS).lower().encode("utf-8")


def count_grams(labelled: DataFrame) -> DataFrame:
    """labelled: url, accepted boolean. gram, accepted, rejected: exact counts, which grow with the
    distinct grams of the input and stay on the executors; every batch adds up its own URLs first."""

    def run(batches):
        for b in batches:
            parts = {True: [np.zeros(0, dtype=np.int64)], False: [np.zeros(0, dtype=np.int64)]}
            for url, accepted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts[accepted].append(grams(_scored_text(url)))
            for accepted, found in parts.items():
                kinds, n = np.unique(np.concatenate(found), return_counts=True)
                none = np.zeros(len(n), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n if accepted else none), pa.array(none if accepted else n)], names=["gram", "accepted", "rejected"])

    counted = labelled.select("url", "accepted").mapInArrow(run, "gram long, accepted long, rejected long")
    return counted.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def fit(labelled: DataFrame) -> tuple[Model, Model, float]:
    """Models of accepted and rejected URLs and the threshold of their ratio.

    labelled: url string, accepted boolean, all rows counted. The threshold maximises balanced
    accuracy on the calibration share (of ties the least); without URLs of both kinds there it is 0.
    """
    labelled = labelled.where("url IS NOT NULL AND accepted IS NOT NULL")
    aside = F.crc32(F.col("url").cast("binary")) % CALIBRATE == 0
    counts, _ = materialise(count_grams(labelled.where(~aside)), "url-grams")
    models = Model(counts, "accepted"), Model(counts, "rejected")
    bins = score_urls(labelled.where(aside), *models).select("accepted", F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "ratio")) * 50).cast("int").alias("bin"))
    table_ = np.zeros((2, 1002))
    for r in bins.groupBy("accepted", "bin").count().collect():
        table_[int(r["accepted"]), r["bin"] + 500] += r["count"]
    if not table_.sum(axis=1).all():
        return *models, 0.0
    below = np.concatenate((np.zeros((2, 1)), table_.cumsum(axis=1)), axis=1)
    balanced = below[0] / below[0, -1] + 1 - below[1] / below[1, -1]
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return *models, float((best[len(best) // 2] - 500) / 50)


def score_urls(urls: DataFrame, accepted: Model, rejected: Model) -> DataFrame:
    """urls with a column ratio, rounded to 12 digits (sums in any order are equal). Grams of the
    distinct URLs, by two hashes of the URL, meet the table of gram_ratios in a join."""
    key = [F.xxhash64("url").alias("_k"), F.hash("url").alias("_k2")]

    def run(batches):
        for b in batches:
            found = [grams(_scored_text(u)) for u in b.column(2).to_pylist()]
            n = [len(g) for g in found]
            all_ = np.concatenate([np.zeros(0, dtype=np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), n)), pa.array(np.repeat(np.asarray(b.column(1)), n)), pa.array(all_)], names=["_k", "_k2", "gram"])

    places, _ = materialise(urls.where("url IS NOT NULL").select("url").distinct().select(*key, "url").mapInArrow(run, "_k long, _k2 int, gram long").groupBy("_k", "_k2", "gram").agg(F.count(F.lit(1)).alias("_n")), "url-places")
    values, _ = materialise(gram_ratios(places.select("gram").distinct(), accepted, rejected), "url-ratios")
    means = places.join(values, "gram").groupBy("_k", "_k2").agg(F.round(F.sum(F.col("_n") * F.col("value")) / F.sum("_n"), 12).alias("ratio"))
    return urls.select("*", *key).join(means, ["_k", "_k2"], "left").select(*[F.col(c) for c in urls.columns], F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def seed_labels(pages: DataFrame, words=REJECT_WORDS) -> DataFrame:
    """url, accepted: rejected if a hyphened or dotted part of its host is a seed word; any other
    URL with a host is accepted."""
    host = host_of(F.col("url"))
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))
    return pages.select("url", (~bad).alias("accepted")).where(host != "")


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, accepted: the URLs that the rules judge, with the rules' own verdicts."""
    _, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", (verdict == "allow").alias("accepted")).where("accepted IS NOT NULL")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Verdict of every row of pages (page_id, url).

    The longest fitting rule decides; without one the models do: allow from the calibrated threshold
    of the length-normalised log-likelihood difference on. The models learn from the part of a URL
    that _scored_text keeps, of labelled (url, accepted); without it from the URLs that the rules judge, and where these are all of one kind from
    seed_labels. Null URLs and those without `://` have empty host and path; null and empty URLs have
    ratio 0. One row per input row, repeated rows alike; extra columns are ignored; an empty table
    gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if labelled is None:
        labelled = rule_labels(pages, rules)
        kinds = labelled.agg(F.min("accepted").alias("a"), F.max("accepted").alias("z")).first()
        if kinds["a"] == kinds["z"]:
            labelled = seed_labels(pages)
    accepted, rejected, threshold = fit(labelled)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = score_urls(pages.withColumn("host", host).withColumn("path", path), accepted, rejected)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "ratio", F.lit(threshold).alias("threshold"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filter that needs no model: host, path, rule and the rule's verdict, or null."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
