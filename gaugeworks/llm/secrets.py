"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import literal_array, table

#: Kind, pattern (a letter class in either case is written out), group held against the least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the models judge: runs of at least so many characters of the alphabet of keys.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters of the alphabet, in the order of their states; state 0 stands before a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Mean log-likelihood ratio per character (nats) from which a run is taken for random.
THRESHOLD = 0.35
#: Generated random strings a kind, and identifiers, in the labelled sample.
GENERATED = 2000
#: Words that ordinary identifiers of the sample are put together from.
IDENTIFIER_WORDS = (
    "get set user name list item index count value config file path data table column row key map node tree "
    "parse read write open close load save build make test check run start stop init create update delete find "
    "request response client server session handler manager service factory context buffer stream string number "
    "default current previous next first last total error message result status version document section page"
).split()
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
#: Elements of a block in a running total.
BLOCK = 64


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine, zero: Column) -> Column:  # noqa: ANN001
    """For each element of an array, all elements before it combined (an associative function), zero
    before the first. By blocks, so that no element goes over all of those before it."""
    block = lambda n: F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int"))
    total = lambda part: F.aggregate(part, zero, combine)

    def from_blocks(n: Column, before: Column) -> Column:
        inside = lambda i: F.aggregate(F.slice(n, i - i % BLOCK + 1, i % BLOCK), F.get(before, F.floor(i / BLOCK).cast("int")), combine)
        return F.transform(n, lambda _, i: inside(i))

    def over(n: Column) -> Column:
        sums = F.transform(block(n), lambda k: total(F.slice(n, k * BLOCK + 1, BLOCK)))
        ahead = lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k)))
        return _let(_let(sums, ahead), lambda before: from_blocks(n, before))

    return _let(values, over)


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans in code points (end exclusive), sorted.

    The pieces between matches and the matches have the text's lengths in turn, so their running
    sum gives each match's place. Only texts with a match are cut.
    """
    joined = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def span(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        spans = F.zip_with(found, running(sizes, lambda a, n: a + n, F.lit(0)), span)
        return F.filter(spans, lambda x: x["end"].isNotNull() & (F.length(x["value"]) >= least))

    return F.when(text.rlike(pattern), _let(joined, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start, then kind as listed."""
    return F.array_sort(F.concat(*(spans_of(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(BASE))))


def spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def states_of(value: Column) -> Column:
    """Array of the states of a string's characters, 0 in front; foreign characters count as 0."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def steps_of(value: Column) -> Column:
    """A string's transitions as cells, before * STATES + after."""
    pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a * STATES + b)
    return _let(states_of(value), pairs)


def generated_samples(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """Labelled samples by rule: value, random. Random: SHA-512 digests in hexadecimal, base 64 and
    capitals of it; ordinary: identifiers of two to four words in snake, camel, kebab and path case."""
    digest = F.unhex(F.sha2(F.concat(F.lit("random"), F.col("id")).cast("binary"), 512))
    hexed = F.substring(F.lower(F.hex(digest)), 1, 40)
    sixty_four = F.substring(F.base64(digest), 1, 40)
    random = spark.range(n).select(F.explode(F.array(hexed, sixty_four, F.substring(F.translate(F.upper(F.base64(digest)), "+/=", ""), 1, 24))).alias("value"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    chosen = F.slice(F.array(*(pick(k) for k in range(4))), 1, (F.pmod(F.col("id"), F.lit(3)) + 2).cast("int"))
    camel = F.array_join(F.transform(chosen, F.initcap), "")
    forms = F.array(F.array_join(chosen, "_"), camel, F.array_join(chosen, "-"), F.array_join(chosen, "/"), F.upper(F.array_join(chosen, "_")), F.concat_ws("_", F.array_join(chosen, "_"), F.pmod(F.col("id"), F.lit(100))))
    return random.unionByName(spark.range(n).select(F.explode(forms).alias("value"), F.lit(False).alias("random")))


def fit(samples: DataFrame) -> tuple[list[float], int]:
    """Log ratio of the transition probabilities, add-half smoothed, of random to ordinary strings.

    samples: value, random; all rows count. The result is a table of STATES * STATES numbers,
    whatever the input: it is all that comes to the driver.
    """
    import math

    cells = samples.select("random", F.explode(steps_of(F.col("value"))).alias("cell")).groupBy("random", "cell").count()
    counts = {(r["random"], r["cell"]): r["count"] for r in cells.collect()}
    out = []
    totals = {(kind, a): sum(counts.get((kind, a * STATES + b), 0) for b in range(STATES)) for kind in (True, False) for a in range(STATES)}
    for a in range(STATES):
        for b in range(STATES):
            p, q = ((counts.get((kind, a * STATES + b), 0) + 0.5) / (totals[kind, a] + 0.5 * STATES) for kind in (True, False))
            out.append(round(math.log(p / q), 6))
    return out, sum(counts.values())


def ratio(value: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a string."""
    table_ = literal_array(weights, "D")
    total = F.aggregate(steps_of(value), F.lit(0.0), lambda acc, cell: acc + F.coalesce(F.get(table_, cell), F.lit(0.0)))
    return total / F.greatest(F.length(value), F.lit(1))


def clear_of_base(base: Column, runs: Column, keep) -> Column:  # noqa: ANN001
    """base, and of runs those that overlap nothing of it and that keep takes, sorted by start.

    In the order of their starts a run overlaps an earlier span of base if the largest end before it
    lies behind its start, and a later one if the least start behind it lies before its end."""
    n_base = len(BASE)

    def judged(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: F.when(x["rank"] < n_base, x["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        last = F.lit((1 << 31) - 1)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["rank"] < n_base, x["start"]).otherwise(last))), lambda a, b: F.least(a, b), last))
        near = F.arrays_zip(every.alias("span"), ends.alias("before"), starts.alias("behind"))
        good = lambda x: (x["span"]["rank"] < n_base) | ((x["before"] <= x["span"]["start"]) & (x["behind"] >= x["span"]["end"]) & keep(x["span"]))
        return F.transform(F.filter(near, good), lambda x: x["span"])

    both = _let(F.array_sort(F.concat(base, runs)), judged)
    return F.when(F.size(runs) == 0, base).when(F.size(base) == 0, F.filter(runs, keep)).otherwise(both)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text.

    One row per input row: doc_id, text_spans (array of start, rank, end, kind, value; kinds assign,
    access and hex by pattern, random by the models), n_assign, n_access, n_hex, base_sha256, spans.
    The models are trained on generated samples and, over all texts, on the values of pattern
    findings (random) and letter-only candidate runs (ordinary): a first pass counts their transitions,
    a second one judges, and no text found is written anywhere in between. A run of the models counts
    if it overlaps no pattern finding. Null texts count as empty; repeated rows are scanned alike;
    extra columns are ignored; an empty table gives no rows; the work grows with the length of a text
    and the number of its matches, not their square.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), spans_of(text, "random", len(BASE), CANDIDATE).alias("runs"))
    letters = F.filter("runs.value", lambda v: v.rlike("^[A-Za-z]+$"))
    labelled = lambda values, random: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))
    seen = found.select(F.explode(F.concat(labelled(F.col("base.value"), True), labelled(letters, False))).alias("s")).select("s.*")
    weights, _ = fit(generated_samples(spark).unionByName(seen))
    every = clear_of_base(F.col("base"), F.col("runs"), lambda run: ratio(run["value"], weights) >= THRESHOLD)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", "base", every.alias("text_spans")).select(
        "doc_id", "text_spans", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spelt(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelt(F.col("text_spans")).alias("spans"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("text_spans")


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the secret scan that needs no model: counts and digest of the fixed patterns' spans."""
    base = base_spans(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", base.alias("base"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(kind) for kind, *_ in BASE), F.sha2(spelt(F.col("base")).cast("binary"), 256).alias("base_sha256"))
