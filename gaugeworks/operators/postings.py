"""A stored inverted index over dated texts, and retrieval of many questions by joins with it.

The index is written once, in ranges of (day, term): a posting holds what scoring and scoping need of
its document, so a question reads the postings of its days and terms and nothing of the texts.
Statistics (documents, mean length, documents with a term) are those of the question's own window
and scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import tokens
from gaugeworks.operators.retrieval import B, K1
from gaugeworks.sources.store import shared_folder, stored

#: What is known of every document beside its text: of one type each, so null where a source lacks it.
META = ("theme", "author_role", "type", "account_id", "domain")
#: How many of a question's best an investigation's evidence is taken from, and its count of withheld texts.
POOL = 36


@dataclass(frozen=True)
class Index:
    """postings: day, term, doc_id, tf, dl, dims; documents: day, doc_id, dl, dims and META.

    dims has `dimension=value` for each dimension of a document (region, warehouse_id, ...)."""

    postings: DataFrame
    documents: DataFrame
    dimensions: tuple[str, ...] = ()


def build(docs: DataFrame, dimensions: tuple[str, ...], name: str = "postings") -> Index:
    """docs: doc_id, day, text, the dimensions and any of META. Two tables in the session's shared folder.

    A text without tokens is a document without postings: it counts in the statistics. Rows without a
    day cannot lie in a window and are left out; null values of a dimension match no scope. Large days
    are split by term and document, so no day is one file or one task."""
    dims = F.array_compact(F.array(*[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dimensions])).cast("array<string>")
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in META]
    words = docs.where("day IS NOT NULL").select(F.to_date("day").alias("day"), "doc_id", tokens(F.col("text")).alias("w"), dims.alias("dims"), *meta)
    # a document's words are counted in its own row, as runs of the sorted ones: only what is stored is shuffled
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = words.withColumn("dl", F.coalesce(F.size("w"), F.lit(0))).withColumn("w", F.sort_array("w")).withColumn("s", F.when(F.size("w") > 0, starts))
    distinct = F.transform("s", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("w")) - i).alias("tf")))
    # written before it is dealt to ranges: a range's bounds come from a pass of its own, and texts are parted once
    counted = stored(runs.select("day", "doc_id", "dl", "dims", *META, distinct.alias("terms")), f"{name}-counted")
    documents = stored(counted.drop("terms").repartitionByRange("day", "doc_id").sortWithinPartitions("day", "doc_id"), f"{name}-documents")
    rows = counted.select("day", "doc_id", "dl", "dims", F.explode("terms").alias("p")).select("day", "p.term", "doc_id", "p.tf", "dl", "dims")
    return Index(stored(rows.repartitionByRange("day", "term", "doc_id").sortWithinPartitions("day", "term"), f"{name}-terms"), documents, dimensions)


def opened(spark, name: str, dimensions: tuple[str, ...], folder: str | None = None) -> Index:  # noqa: ANN001
    """An index written by save(), of texts with these dimensions."""
    root = f"{folder or shared_folder(spark)}/{name}"
    return Index(spark.read.parquet(f"{root}/terms"), spark.read.parquet(f"{root}/documents"), dimensions)


def save(index: Index, name: str, folder: str | None = None) -> None:
    """Append an index to one that later sessions open: new days are new files beside the old."""
    spark = index.postings.sparkSession
    root = f"{folder or shared_folder(spark)}/{name}"
    index.documents.write.mode("append").parquet(f"{root}/documents")
    index.postings.write.mode("append").parquet(f"{root}/terms")


def scope_of(exposure: dict) -> list[list[str]]:
    """A question's scope from dimension to value or values: for each dimension what a document may have."""
    return [[f"{k}={x}" for x in (v if isinstance(v, (list, tuple)) else [v])] for k, v in exposure.items()]


def _inside() -> Column:
    """Whether a document's dimensions lie in a question's scope (null or empty: everywhere)."""
    return F.col("scope").isNull() | F.forall("scope", lambda allowed: F.arrays_overlap("dims", allowed))


def retrieve(index: Index, asks: DataFrame) -> DataFrame:
    """ask, doc_id, score: BM25 of every document with a positive score in its question's window and scope.

    asks: ask, lo, hi (dates, both included), terms (array, repeats count each), scope (see scope_of, or
    null). A question's days are sent to the day of each posting: an equality join, before which postings of terms
    that no question has are left out where they lie (the questions' distinct terms are broadcast). Documents are counted by
    day and dimensions before questions meet them. Scores are not rounded. Questions need different keys."""
    days = asks.where("lo <= hi").select("ask", "scope", "terms", F.explode(F.sequence("lo", "hi")).alias("day"))
    cells = index.documents.groupBy("day", "dims").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
    seen = cells.join(days.drop("terms"), "day").where(_inside())
    stats = seen.groupBy("ask").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("mean"))
    wanted = _wanted(days)
    asked = index.postings.join(F.broadcast(asks.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi")
    hits = asked.join(wanted, ["day", "term"]).where(_inside()).select("ask", "term", "doc_id", "tf", "dl", "w")
    having = hits.groupBy("ask", "term").agg(F.count(F.lit(1)).alias("df"))
    told = hits.join(having, ["ask", "term"]).join(stats, "ask")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = F.col("w") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / mean))
    return told.groupBy("ask", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")


def _wanted(days: DataFrame) -> DataFrame:
    """ask, scope, day, term, w (how often the question has the term)."""
    counts = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("w")))
    return days.select("ask", "scope", "day", F.explode(counts).alias("t")).select("ask", "scope", "day", "t.term", "t.w")


def best_visible(scored: DataFrame, documents: DataFrame, visible: Column, k: int = 12, pool: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ask, doc_id, score, rank and META of each question's best k documents that may be seen; ask, domain,
    n of those withheld).

    visible: a condition over META and dims. Every document with a score is looked at, however many better ones
    are withheld; pool: only a question's best that many are, whatever may be seen of them. Ranks are per
    question; a partition's own best k (or pool) are all that leaves it."""
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "doc_id")
    asked = scored if pool is None else scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= pool)
    known = asked.join(documents.select("doc_id", "dims", *META), "doc_id").withColumn("_seen", F.coalesce(visible, F.lit(False)))
    seen = known.where("_seen").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return seen.select("ask", "doc_id", "score", "rank", *META), known.where("NOT _seen").groupBy("ask", "domain").agg(F.count(F.lit(1)).alias("n"))


def corroborated(found: DataFrame, wanted: DataFrame, rivals: tuple[str, ...]) -> DataFrame:
    """One row for each question of wanted (ask, theme): documents on the theme, independent (role, type)
    pairs, accounts, documents on a rival theme, their share, and the verdict.

    corroborated: three documents, two pairs and two accounts at least, and under 0.4 of conflict;
    contested: 0.4 or more; else insufficient. Themes outside rivals neither speak for nor against."""
    rows = wanted.select("ask", F.col("theme").alias("want")).join(found, "ask", "left")
    on = F.col("theme") == F.col("want")
    rival = F.col("theme").isin(*rivals) & ~on
    out = rows.groupBy("ask").agg(F.count_if(on).alias("on_theme"), F.countDistinct(F.when(on, F.struct("author_role", "type"))).alias("pairs"), F.countDistinct(F.when(on, F.col("account_id"))).alias("accounts"), F.count_if(rival).alias("conflicting"), F.array_sort(F.collect_set(F.when(rival, F.col("theme")))).alias("conflicting_themes"))
    ratio = F.coalesce(F.try_divide("conflicting", F.col("on_theme") + F.col("conflicting")), F.lit(0.0))
    enough = (F.col("on_theme") >= 3) & (F.col("pairs") >= 2) & (F.col("accounts") >= 2) & (ratio < 0.4)
    verdict = F.when(enough, "corroborated").when(ratio >= 0.4, "contested").otherwise("insufficient")
    return out.withColumn("conflict_ratio", ratio).withColumn("verdict", verdict).withColumn("corroborated", enough)
