"""Chat formatting over reply trees."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialise, table

#: The template: a turn is OPEN role MID text CLOSE. Inside roles and texts `\` is written `\\` and
#: `<|` is written `<\|`, so no control string can occur there and reading back is exact.
OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _escape(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tree_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of reply trees.

    nodes: tree string, node long, parent long (null or unknown: a root), score double. Every round joins the table with
    itself: from a jump over 2**k replies it makes the jump over 2**(k+1), with depth and summed
    score, so a chain of n replies takes log2(n) rounds. Leaves rank by mean score of their path
    (ties: the smaller leaf); then the same jumps, longest first, lead from each chosen leaf to all
    its ancestors, each reached once. Returns tree, branch (1 is best), depth (0 is the root), node.
    Nodes on a cycle have no root and lie on no path. A (tree, node) must be unique.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("jump"), F.lit(0).alias("depth"), "score")
    first = first.withColumn("depth", F.when(F.col("jump").isNotNull(), 1).otherwise(0))
    leaves = nodes.join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", "node")
    level, _ = materialise(first, "tree-jump")
    levels, total = [level], None
    while True:
        if not level.where("jump IS NOT NULL").limit(1).count():
            break
        total = level.count() if total is None else total
        if 1 << len(levels) > 2 * total:
            break
        up = level.select("tree", F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("more"), F.col("score").alias("extra"))
        on = level.where("jump IS NOT NULL").join(up, ["tree", "jump"], "left")
        on = on.select("tree", "node", F.col("far").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
        level, _ = materialise(on.unionByName(level.where("jump IS NULL")), "tree-jump")
        levels.append(level)
    rooted = level.where("jump IS NULL")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), "node")
    chosen = leaves.join(rooted, ["tree", "node"]).withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    at = chosen.select("tree", "branch", "node")
    for jumps in reversed(levels[:-1]):
        both = at.join(jumps.where("jump IS NOT NULL").select("tree", "node", "jump"), ["tree", "node"], "left")
        at = both.select("tree", "branch", F.explode(F.array("node", "jump")).alias("node")).where("node IS NOT NULL")
    return at.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "branch", "depth", "node")


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes: tree, node, parent, score, role, text. One row per turn of each chosen path, in the
    order (tree, branch, depth) within its partition: segment, and loss_start and loss_end, the code
    points of the segment that training learns from (assistant texts). A conversation's output is
    its segments put together, so no task ever holds a whole conversation."""
    paths = tree_paths(nodes, branches)
    words = nodes.select("tree", "node", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = paths.join(words, ["tree", "node"]).withColumn("said", _escape(F.col("text")))
    head = F.concat(F.lit(OPEN), _escape(F.col("role")), F.lit(MID))
    rows = rows.select("tree", "branch", "depth", F.concat(head, "said", F.lit(CLOSE)).alias("segment"), F.when(F.col("role") == "assistant", F.length(head)).alias("loss_start"), F.length("said").alias("n"))
    return rows.select("tree", "branch", "depth", "segment", "loss_start", (F.col("loss_start") + F.col("n")).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its segments alone, in one pass over sorted rows."""

    def run(batches):
        schema = pa.schema([("tree", pa.string()), ("branch", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        key, state, done = None, None, []
        close = lambda: done.append((*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for b in batches:
            for tree, branch, segment, a, z in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (tree, branch) != key:
                    if key is not None:
                        close()
                    key, state = (tree, branch), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(segment):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if a is not None:
                    learnt = unescape(segment[a:z])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done = []
        if key is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    rows = formatted.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "depth").select("tree", "branch", "segment", "loss_start", "loss_end")
    return rows.mapInArrow(run, "tree string, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each row answers the row before it in its conversation.

    Rows sort by turn (null first), then role and text, so tied and repeated turns have one order and
    none is lost. tree is the id's text, or `null`.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("null")).alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its digests (see read_back). Null texts and roles are empty; an
    empty table gives no rows; extra columns are ignored; a null conv_id is one conversation."""
    nodes, _ = materialise(conversation_nodes(conversations), "chat-nodes")
    back = read_back(format_paths(nodes))
    return back.select(F.expr("try_cast(tree as bigint)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: A conversation whose texts hold another template's control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")))
