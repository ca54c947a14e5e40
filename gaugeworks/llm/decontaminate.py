"""Benchmark decontamination by template canonicalisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import drop_scratch, literal_array, materialise, table, unpacked, whole_row

#: Most words of a template window. Items of 2 * WINDOW words or fewer have windows of under half their
#: length, so one edited word leaves a whole window on a side; of under WINDOW words one window.
WINDOW = 8
#: Items of under LEAST words, down to two, and windows of which under half are plain words, match word
#: for word only: as templates they would match nearly anything. Items of one word: see unindexed.
LEAST, SHORTEST = 4, 2
#: A document holds an item if its windows cover this share of the item's windows ...
SHARE = 0.5
#: ... or this share of the words in them: an edit costs up to WINDOW windows but one word.
WORD_SHARE = 0.7
#: Windows of one copy begin within this many lengths of the item.
REACH = 2
#: Bits of the map that decides which windows are worth a join; bounded whatever the benchmark's size.
MAX_MAP_BITS = 1 << 20
#: Unit words, a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre feet inches inch g kg mg lb lbs oz grams gram tons ton "
    "ml l liters litres liter litre gallons gallon s sec secs seconds second min mins minutes minute h hr hrs hours hour "
    "days day weeks week months month years year dollars dollar cents cent usd eur euros euro pounds pound percent pct "
    "kmh mph degrees degree celsius kb mb gb tb"
).split()
#: Number words, which stand for numbers as digits do.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_START, _UNIT, _JOIN = "\u0001", "\u0002", "\u0003"
#: A capitalised word or number with another one behind it: both are one value.
_RUN = r"(?=[\p{Lu}0-9])((?<![\p{L}\p{N}\x01.,])(?:\p{Lu}\p{Ll}[\p{L}\p{N}'-]*+(?=[\x09-\x0D\x20]+\p{Lu}\p{Ll})|[0-9]++(?:[.,][0-9]++)*+(?=[\x09-\x0D\x20]+[0-9])))[\x09-\x0D\x20]+"


def typed_words(text: Column) -> Column:
    """The words of a text without punctuation, those that begin a sentence and units after a number
    marked by a control character in front; commas and points inside numbers stay. Names of several
    words and numbers in groups are one word, with a control character between the parts."""
    clean = F.coalesce(text.cast("string"), F.lit(""))
    marked = F.contains(clean, F.lit(_START)) | F.contains(clean, F.lit(_UNIT)) | F.contains(clean, F.lit(_JOIN))
    # character by character: only where there is something to do
    clean = F.when(marked, F.translate(clean, _START + _UNIT + _JOIN, "   ")).otherwise(clean)
    units = F.regexp_replace(clean, r"(?i)(?<=[0-9])[\x09-\x0D\x20]*\b?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", " " + _UNIT + "$1")
    clean = F.when(clean.rlike("[0-9]"), units).otherwise(clean)
    starts = F.regexp_replace(clean, r"(^|[.!?:][^\p{L}\p{N}]*|\n[^\p{L}\p{N}]*)(?=\p{Lu})", "$1" + _START)
    joined = F.regexp_replace(starts, _RUN, "$1" + _JOIN)
    bare = F.regexp_replace(joined, r"(?<![0-9])[.,]|[.,](?![0-9])|[^\p{L}\p{N}.,\x09-\x0D\x20" + _START + _UNIT + _JOIN + "]+", "")
    return F.array_remove(F.array_remove(F.split(bare, r"[\x09-\x0D\x20]+"), ""), _START)


def placeholder(word: Column, small: Column, before: Column) -> Column:
    """A typed word (small: in lower case, without its mark of a sentence; before: the word ahead of
    it, likewise) as it stands in a template: <num> (digits or a number word), <unit>, <name> or small."""
    name = (word != small) & ~F.startswith(word, F.lit(_START)) & word.rlike(r"^\p{Lu}\p{Ll}")
    # of what a word may begin with, only digits and the mark of a unit lie before a colon
    other = F.when(name, "<name>").otherwise(small)
    # one look-up settles most words
    listed = F.when(small.isin(NUMBER_WORDS), "<num>").when(before.isin(NUMBER_WORDS), "<unit>").otherwise(other)
    return F.when(small < ":", F.when(F.startswith(small, F.lit(_UNIT)), "<unit>").otherwise("<num>")).when(small.isin(NUMBER_WORDS + UNITS), listed).otherwise(other)


def _parts(word: Column) -> Column:
    """How many words a typed word has beyond its first."""
    return F.length(word) - F.length(F.translate(word, _JOIN, ""))


def _windows(source: DataFrame, keys: list[str], sizes: list, pick=None, keep=None) -> DataFrame:  # noqa: ANN001
    """keys, size, exact, at, first_word (at in words of the text), h, words and template of windows of
    source (keys, words, template) of the given sizes. Every window has two hashes: of its template and,
    exact, of its words in lower case.

    pick: from the template the places at which windows have to hold a word, or None for all; keep: a
    condition on size and hash. Both are applied inside the row, before rows are made."""
    n = F.size("template")

    def starts(size: Column) -> Column:
        last = n - size + 1
        if pick is None:
            return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        around = F.transform("at", lambda p: F.when(F.greatest(F.lit(1), p - size + 1) <= F.least(p, last), F.sequence(F.greatest(F.lit(1), p - size + 1), F.least(p, last))))
        return F.array_distinct(F.flatten(F.array_compact(around)))

    def hashes(size, exact: bool) -> Column:  # noqa: ANN001
        size = F.lit(size) if isinstance(size, int) else size
        said = lambda i: F.transform(F.slice("words", i, size), F.lower) if exact else F.slice("template", i, size)
        hashed = F.transform(starts(size), lambda i: F.struct(size.alias("size"), F.lit(exact).alias("exact"), i.alias("at"), F.xxhash64(F.lit(exact), said(i)).alias("h")))
        return hashed if keep is None else F.filter(hashed, lambda w: keep(w["h"]))

    if pick is not None:
        source = source.select(*keys, "words", "template", pick(F.col("template")).alias("at"))
        some = F.size("at") > 0
    else:
        some = F.lit(True)
    found = [hashes(size, exact) for size, exact in sizes]
    found = F.when(some, F.concat(*found) if len(found) > 1 else found[0])
    cut = source.select(*keys, "words", "template", found.alias("found"))
    joins = F.array_compact(F.transform("words", lambda w, i: F.when(F.contains(w, F.lit(_JOIN)), i + 1)))
    cut = cut.select(*keys, "words", "template", "found", F.when(F.size("found") > 0, joins).alias("joins"))
    before = lambda at: F.aggregate(F.filter("joins", lambda k: k < at), F.lit(0), lambda n, k: n + _parts(F.get("words", k - 1)))
    full = F.transform("found", lambda w: F.struct(
        w["size"].alias("size"), w["exact"].alias("exact"), w["at"].alias("at"), (w["at"] + before(w["at"])).alias("first_word"), w["h"].alias("h"),
        F.slice("words", w["at"], w["size"]).alias("words"), F.slice("template", w["at"], w["size"]).alias("template")))
    # the outer form: a filter on the array's size would move below and be worked out anew for every window
    return cut.select(*keys, full.alias("found")).select(*keys, F.explode_outer("found").alias("w")).where("w IS NOT NULL").select(*keys, "w.*")


def _pair_hash(template: Column, i: Column) -> Column:
    """Of the words at place i (from 1) and the next."""
    return F.xxhash64(F.get(template, i - 1), F.get(template, i))


def _covered(starts: Column, size: Column) -> Column:
    """How many words the windows at some starts cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + size - 1)))))


def _templates(rows: DataFrame, keys: list[str]) -> DataFrame:
    typed = rows.select(*keys, typed_words(F.col("text")).alias("words"))
    typed = typed.select(*keys, "words", F.transform("words", lambda w: F.lower(F.when(F.contains(w, F.lit(_START)), F.translate(w, _START, "")).otherwise(w))).alias("small"))
    # the word before the first is null, which is no number word
    template = F.transform("small", lambda s, i: placeholder(F.get("words", i), s, F.get("small", i - 1)))
    return typed.select(*keys, "words", template.alias("template"))


def _n_words() -> Column:
    return F.size("template") + F.aggregate("words", F.lit(0), lambda n, w: n + _parts(w))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (windows of the item), n_words (words in them), length, size, exact (matches word for
    word only), at, h, words, template, and anchor: of the pairs of neighbouring words in the window
    the hash of the longest, which is rare as a rule. Items of one word have no windows."""
    items = _templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").dropDuplicates(), ["item_id"])
    length = F.size("template")
    items = items.where(length >= SHORTEST).withColumn("short", _n_words() < LEAST)
    half = F.least(F.lit(WINDOW), F.greatest(F.lit(LEAST), F.floor((length - 1) / 2).cast("int")))
    items = items.withColumn("length", length).withColumn("_size", F.when(length < WINDOW, length).otherwise(half))
    parts = _windows(items, ["item_id", "length", "_size", "short"], [(F.col("_size"), False), (F.col("_size"), True)]).drop("_size", "first_word")
    plain = F.size(F.filter("template", lambda w: ~F.startswith(w, F.lit("<"))))
    parts = parts.where(F.col("exact") == (F.col("short") | (plain * 2 < F.col("size")))).drop("short")
    pairs = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.struct((F.length(F.get("template", i - 1)) + F.length(F.get("template", i))).alias("n"), _pair_hash(F.col("template"), i).alias("h")))
    parts = parts.withColumn("anchor", F.array_max(pairs)["h"])
    whole = parts.groupBy("item_id", "length", "size").agg(F.count(F.lit(1)).alias("n"), F.collect_list("at").alias("ats"))
    return parts.join(whole.select("item_id", "length", "n", _covered(F.col("ats"), F.col("size")).cast("long").alias("n_words")), ["item_id", "length"])


def unindexed(benchmark: DataFrame) -> DataFrame:
    """item_id of the items that find leaves aside: those of under SHORTEST words, or without text."""
    items = _templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id"])
    return items.where(F.size("template") < SHORTEST).select("item_id").distinct()


def _bit_map(hashes: DataFrame):
    """A test of a hash against a literal bit map: never false for a hash of the benchmark.

    At most MAX_MAP_BITS / 32 rows come to the driver; with more hashes the map only lets more
    windows through to the join, which decides."""
    n = hashes.count()
    bits = 1 << 12
    while bits < min(32 * n, MAX_MAP_BITS):
        bits *= 2
    cells = hashes.select(F.pmod("h", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(31)).cast("int"))).alias("v"))
    values = [0] * (bits // 32)
    for r in cells.collect():
        values[r["cell"]] = r["v"]
    table_ = literal_array(values, "L")
    # bits is a power of two: the low bits of a hash are its place
    bit = lambda h: h.bitwiseAND(F.lit(bits - 1)).cast("int")
    return lambda h: F.getbit(F.get(table_, F.shiftright(bit(h), 5)), bit(h).bitwiseAND(F.lit(31))) == 1


def _consistent(slots: Column) -> Column:
    """Whether no value of the item stands for two values of the document: a variant may give two of the
    item's values the same one, but never one of them two."""
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["t"], s["item"]))))


def _chained(runs: DataFrame) -> DataFrame:
    """For each run (the windows of a pair at one offset) the windows and values of the copy that
    begins there: of all runs up to REACH lengths of the item later, the largest first, each is added
    whose values agree with those taken so far. So inserted, dropped and replaced words only cost the
    windows they stand in."""
    near = Window.partitionBy("doc_id", "item_id", "length").orderBy(F.floor(F.col("first_word") * 1000 / F.col("length"))).rangeBetween(0, 1000 * REACH)
    run = F.struct((-F.size("item_ats")).alias("less"), "offset", "item_ats", "slots")
    rows = runs.withColumn("near", F.collect_list(run).over(near)).where(F.size("near") > 1)
    start = F.struct(F.col("item_ats"), F.col("slots"))

    def add(so_far: Column, r: Column) -> Column:
        slots = F.array_union(so_far["slots"], r["slots"])
        more = F.struct(F.array_union(so_far["item_ats"], r["item_ats"]).alias("item_ats"), slots.alias("slots"))
        return F.when(_consistent(slots), more).otherwise(so_far)

    copy = F.aggregate(F.array_sort("near"), start, add)
    return rows.withColumn("copy", copy).withColumn("item_ats", F.col("copy.item_ats")).withColumn("slots", F.col("copy.slots")).drop("near", "copy")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The (document, item) pairs of which the document holds the item or a variant of it.

    Numbers, units after numbers and names become typed placeholders; windows of these templates
    are hashed and joined. Pairs count where windows at one offset, or at the offsets of one copy with
    inserted, dropped or replaced words, cover SHARE of the item's windows or WORD_SHARE of the words
    in them, and the values in the placeholders agree: each value of the item stands for one value of the
    document (two of its values may stand for the same one). kind: verbatim (equal values) or variant.
    Result: doc_id, item_id, kind, n_windows, share (of windows), first_word. Items of two or three words,
    and windows that hold hardly a plain word, match word for word only; items of one word are not looked
    for (unindexed names them). Documents are tested for the benchmark's anchors, pairs of neighbouring
    words, and only windows around one are hashed. Null and empty texts match nothing; rows that share a doc_id or item_id are judged as one;
    rows without doc_id keep a null one; extra columns are ignored; empty tables give no rows. Very
    long texts are read whole.
    """
    spark = docs.sparkSession
    bench, path = materialise(benchmark_windows(benchmark), "benchmark-windows")
    sizes = sorted((r["size"], r["exact"]) for r in bench.select("size", "exact").distinct().collect())  # WINDOW * 2 at most
    if not sizes:
        drop_scratch(spark, path)
        return spark.createDataFrame([], "doc_id long, item_id long, kind string, n_windows long, share double, first_word int")
    rows = _templates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    known, anchored = _bit_map(bench.select("h")), _bit_map(bench.select(F.col("anchor").alias("h")))
    # hashes first: a function's argument inside another is worked out at each mention
    pairs = lambda t: F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.xxhash64(a, b))
    pick = lambda t: F.array_compact(F.transform(pairs(t), lambda h, i: F.when(anchored(h), i + 1)))
    theirs = _windows(rows, ["doc_id"], sizes, pick, known)
    own = bench.select("item_id", "length", "n", "n_words", "size", "exact", "h", F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("template").alias("item_template"))
    lowered = lambda c: F.transform(c, F.lower)
    hits = theirs.join(own, ["size", "exact", "h"]).where((F.col("template") == F.col("item_template")) & (~F.col("exact") | (lowered("words") == lowered("item_words"))))
    slots = F.filter(
        F.transform(F.arrays_zip("template", "words", "item_words"), lambda x: F.struct(x["template"].alias("t"), F.lower(x["item_words"]).alias("item"), F.lower(x["words"]).alias("doc"))),
        lambda x: F.startswith(x["t"], F.lit("<")),
    )
    per = hits.select("doc_id", "item_id", "length", "n", "n_words", "size", "item_at", "first_word", (F.col("at") - F.col("item_at")).alias("offset"), slots.alias("slots"))
    grouped = per.groupBy("doc_id", "item_id", "length", "n", "n_words", "size", "offset").agg(
        F.collect_set("item_at").alias("item_ats"), F.min("first_word").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    runs, _ = materialise(grouped.where(_consistent(F.col("slots"))), "item-runs")
    drop_scratch(spark, path)
    same = F.forall("slots", lambda s: s["item"] == s["doc"])
    n_windows = F.size("item_ats").cast("long")
    enough = (n_windows >= F.col("n") * SHARE) | (_covered(F.col("item_ats"), F.col("size")) >= F.col("n_words") * WORD_SHARE)
    holds = lambda r: r.where(enough).select("doc_id", "item_id", F.when(same, "verbatim").otherwise("variant").alias("kind"), n_windows.alias("n_windows"), (n_windows / F.col("n")).alias("share"), "first_word")
    kept = holds(runs).unionByName(holds(_chained(runs)))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("first_word")).alias("back"), "kind", "share")).alias("b"))
    return best.select("doc_id", "item_id", "b.kind", "b.n_windows", "b.share", (-F.col("b.back")).cast("int").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without doc_id are one document."""
    found, _ = materialise(find(docs, benchmark).select("doc_id").distinct(), "contaminated")
    found = found.select(F.col("doc_id").alias("key"))
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("key")), "left_anti").select(*unpacked(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
