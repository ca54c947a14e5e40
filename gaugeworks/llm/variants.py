"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of their trie.

The words of a corpus form a trie. At each of its nodes the child that holds the most words is heavy,
the others (and the word that ends there) are light; a word is light at no more than about log2(words)
of its nodes. Two words one edit apart part at one node, where at most one of them is heavy. So it is
enough to take each word at the nodes where it is light and to merge it, with the character there
replaced or skipped, into what else the node holds:

* replaced by the heavy child's character, it may coincide with a word of the heavy subtree;
* replaced by a placeholder, it may coincide with other light words of the node;
* with its character skipped, it may coincide with any word of the node;
* with the heavy child's character put before it, it may coincide with a longer word of the heavy subtree.

Each pair is found at the node where its words part, hence once. Nodes are prefixes: their sizes, heavy
children and merges are aggregates and joins of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import Scratch, table

#: Runs of these characters are words; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An occurrence loses a character where this divides its checksum.
EVERY = 97
#: Words have so many code points and occurrences at least; a form has so many times the word's.
LEAST_CHARS, LEAST_TIMES, RATIO = 5, 3, 2
#: Prefixes up to this length are at most 91**2 + 91 + 1 (26 + 64 characters and an end): a bounded broadcast.
SHORT = 2


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the distinct words of whole texts: maximal runs, lower-cased, of which the
    occurrences whose checksum with doc_id is divisible by EVERY lose one character."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    h = F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.where(F.length("run") >= LEAST_CHARS).withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _left(at: str) -> Column:
    return F.substring("word", F.lit(1), F.col(at))


def _right(at: str, skipped: int) -> Column:
    return F.substring("word", F.col(at) + 1 + skipped, F.length("word"))


def _node(prefix: Column) -> Column:
    """128 bits that stand for a prefix: nodes of long words need no long keys."""
    return F.struct(F.xxhash64(F.lit(1), prefix).alias("x"), F.xxhash64(F.lit(2), prefix).alias("y"))


def _grown(side: DataFrame) -> DataFrame:
    """A table that grows with the vocabulary, for a join by sorting: well packed files look small enough to broadcast,
    but unpacked they fill the driver."""
    return side.hint("merge")


def light_places(words: DataFrame) -> DataFrame:
    """id, at, c, heavy: the nodes (prefixes of `at` characters) where a word is light but not alone.
    c is its next character there ('' where it ends), heavy that of the child with the most words
    (ties: the greatest character).

    words: id, word, n. Nodes are counted with partial sums, so that a short prefix of all words is no
    hot group; of prefixes up to SHORT characters there are no more than the alphabet allows, so their
    heavy children are broadcast.
    """
    steps = F.transform(F.sequence(F.lit(0), F.length("word")), lambda k: F.struct(k.alias("at"), _node(F.substring("word", F.lit(1), k)).alias("node"), F.substring("word", k + 1, F.lit(1)).alias("c")))
    places = words.select("id", F.explode(steps).alias("s")).select("id", "s.at", "s.node", "s.c")
    children = places.groupBy("at", "node", "c").agg(F.count("*").alias("size"))
    nodes = children.groupBy("at", "node").agg(F.max(F.when(F.col("c") != "", F.struct("size", "c"))).alias("m"), F.count("*").alias("ways"))
    heavy = nodes.where("m IS NOT NULL AND ways > 1").select("at", "node", F.col("m.c").alias("heavy"))
    short = places.where(F.col("at") <= SHORT).join(F.broadcast(heavy.where(F.col("at") <= SHORT)), ["at", "node"])
    long = places.where(F.col("at") > SHORT).join(_grown(heavy.where(F.col("at") > SHORT)), ["at", "node"])
    return short.unionByName(long).where("c <> heavy").select("id", "at", "c", "heavy")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b of words (id, word, n): the pairs of words that differ by exactly one inserted, deleted or replaced character, each once.

    A group of light words that coincide but for one character holds no more than the alphabet, and
    all its pairs are results.
    """
    light = scratch.write(light_places(words).join(_grown(words.select("id", "word")), "id"), "light")
    known = _grown(words.select(F.col("word").alias("b")))
    put, skip = F.concat(_left("at"), "heavy", _right("at", 1)), F.concat(_left("at"), _right("at", 1))
    variants = F.array(
        # replaced by the heavy character; at a word's end there is nothing to replace
        F.when(F.col("c") != "", put),
        # skipped; where the next character is the same, the words part later on
        F.when((F.col("c") != "") & (F.substring("word", F.col("at") + 2, F.lit(1)) != F.col("c")), skip),
        F.concat(_left("at"), "heavy", _right("at", 0)),
    )
    merged = light.select(F.col("word").alias("a"), F.explode(variants).alias("b")).where("b IS NOT NULL").join(known, "b").select("a", "b")
    spot = light.where("c <> ''").select("at", _left("at").alias("head"), _right("at", 1).alias("tail"), "c", "word")
    groups = spot.groupBy("at", "head", "tail").agg(F.sort_array(F.collect_list("word")).alias("w")).where(F.size("w") > 1)
    each = groups.select("w", F.posexplode("w").alias("i", "a")).select("a", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("b"))
    return merged.unionByName(each)


def variant_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus (see vocabulary).

    form: the near word of the largest n (ties: the smallest) if that is RATIO times the word's n, else
    null; root: the last word that forms lead to; form_n: the form's n. Forms grow in n, so following
    them ends, and doubling takes rounds in the logarithm of the longest way only. Null texts hold no
    words; a null doc_id has no checksum, so its words stay whole; repeated rows count each; an empty
    table gives an empty result; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.write(vocabulary(docs), "words").withColumn("id", F.monotonically_increasing_id())
        words = scratch.write(words, "words")
        pairs = scratch.write(near_pairs(words, scratch), "near")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        named = both.join(_grown(words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))), "b")
        # the least struct: largest n, then smallest word
        best = named.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("k"), F.col("b"))).alias("m"))
        first = words.join(_grown(best.withColumnRenamed("a", "word")), "word", "left")
        big = -F.col("m.k") >= RATIO * F.col("n")
        forms = scratch.write(first.select("word", F.when(big, F.col("m.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, -F.col("m.k")).alias("form_n")), "forms")
        root = scratch.write(forms.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "roots")
        while True:
            further = root.select(F.col("word").alias("to"), F.col("to").alias("next"))
            moved = scratch.write(root.join(_grown(further), "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
            scratch.drop(root)
            root = moved
            if not moved.where("moved").limit(1).count():
                break
            root = moved.drop("moved")
        out = forms.join(_grown(root.select("word", F.col("to").alias("root"))), "word", "left")
        return scratch.keep(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all documents."""
    return variant_groups(table(spark, sf_dir, "documents"))
