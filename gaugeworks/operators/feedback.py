"""Learning from analysts: priors, outcomes, corrections. State is an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an accepted and a rejected hypothesis do to its prior, and the bounds.
ACCEPT, REJECT, CAP, FLOOR = 1.12, 0.75, 1.6, 0.35


def priors(log: DataFrame) -> DataFrame:
    """metric, hypothesis_id, prior, n: the log folded in order of seq; `partial` changes nothing,
    `reset` starts anew."""
    steps = log.groupBy("metric", "hypothesis_id").agg(F.array_sort(F.collect_list(F.struct("seq", "grade"))).alias("g"), F.count(F.lit(1)).alias("n"))
    fold = F.aggregate("g", F.lit(1.0), lambda p, x: F.when(x["grade"] == "accept", F.least(F.lit(CAP), p * ACCEPT)).when(x["grade"] == "reject", F.greatest(F.lit(FLOOR), p * REJECT)).when(x["grade"] == "reset", F.lit(1.0)).otherwise(p))
    return steps.select("metric", "hypothesis_id", fold.alias("prior"), "n")


def outcome_means(seed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """playbook_id, effect, n: seed effects (with their n) and measured outcomes as one weighted mean."""
    every = seed.select("playbook_id", F.col("effect").alias("v"), F.col("n")).unionByName(outcomes.select("playbook_id", F.col("recovered").alias("v"), F.lit(1).cast("int").alias("n")))
    m = every.groupBy("playbook_id").agg(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n")).alias("effect"), F.sum("n").cast("long").alias("n"))
    return m.withColumn("confidence", F.when(F.col("n") >= 3, "high").otherwise("medium"))


def corrections(log: DataFrame, metric: str | None = None, n: int = 20) -> DataFrame:
    """Latest notes first."""
    rows = log.where("correction is not null and correction <> ''")
    return (rows.where(F.col("metric") == metric) if metric else rows).orderBy(F.desc("seq")).limit(n)


def correction_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correction").isNotNull() & (F.col("correction") != "")).alias("with_note"), F.countDistinct("analyst").alias("analysts"))


def stats(log: DataFrame) -> DataFrame:
    """Grades and the share of accepted among decided ones."""
    return log.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") == "accept").alias("accepted"), F.count_if(F.col("grade") == "reject").alias("rejected"), F.count_if(F.col("grade") == "partial").alias("partial"), F.try_divide(F.count_if(F.col("grade") == "accept"), F.count_if(F.col("grade").isin("accept", "reject"))).alias("diagnosis_precision"))


def training_rows(log: DataFrame, snapshots: DataFrame, version: str, weight: float = 5.0) -> DataFrame:
    """Analysts' labels on the features that their runs had, of this contract version; `partial` teaches nothing."""
    last = F.row_number().over(Window.partitionBy("run_id", "hypothesis_id").orderBy(F.desc("seq")))
    decided = log.where(F.col("grade").isin("accept", "reject")).withColumn("r", last).where("r = 1")
    return snapshots.where(F.col("contract_version") == version).join(decided.select("run_id", "hypothesis_id", (F.col("grade") == "accept").cast("int").alias("label")), ["run_id", "hypothesis_id"]).withColumn("weight", F.lit(weight))


#: Columns of the log, and of measured outcomes.
LOG = "seq long, run_id string, metric string, hypothesis_id string, grade string, correction string, analyst string"
OUTCOMES = "seq long, playbook_id string, recovered double"
GRADES = ("accept", "reject", "partial")


def _append(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """A log; empty before its first entry."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001  only a missing path is an empty log
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def record(spark: SparkSession, path: str, seq: int, run_id: str, metric: str, hypothesis_id: str, grade: str, correction: str | None = None, analyst: str = "") -> dict:
    """Append one grade; returns the hypothesis's prior from then on."""
    if grade not in GRADES:
        raise ValueError(f"a grade is one of {', '.join(GRADES)}")
    _append(spark, path, (seq, run_id, metric, hypothesis_id, grade, correction, analyst), LOG)
    now = priors(read_log(spark, path).where((F.col("metric") == metric) & (F.col("hypothesis_id") == hypothesis_id))).first()
    return {"metric": metric, "hypothesis_id": hypothesis_id, "prior": now["prior"], "n": now["n"]}


def record_outcome(spark: SparkSession, path: str, seq: int, playbook_id: str, recovered: float) -> None:
    """Append what a playbook's action recovered, as a share of the gap."""
    _append(spark, path, (seq, playbook_id, float(recovered)), OUTCOMES)


def reset(spark: SparkSession, path: str, seq: int, analyst: str = "") -> int:
    """Set all priors back to 1: one entry a hypothesis, the history stays. Returns how many there are."""
    log = read_log(spark, path)
    known = log.select("metric", "hypothesis_id").distinct()
    n = known.count()
    if n:
        rows = known.select(F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("run_id"), "metric", "hypothesis_id", F.lit("reset").alias("grade"), F.lit(None).cast("string").alias("correction"), F.lit(analyst).alias("analyst"))
        rows.coalesce(1).write.mode("append").parquet(path)
    return n
