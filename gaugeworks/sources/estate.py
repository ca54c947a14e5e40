"""Access to the estate: governed views over the tables, point-in-time cut-off, readers and sinks."""

from __future__ import annotations

import json
import os
import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.security import Persona
from gaugeworks.sources.store import kept

#: Schemas of evidence lines, market events and feedback: readers never infer.
INTERACTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("interaction_id", "ts", "type", "account_id", "account_name", "region", "segment", "warehouse_id", "author_role", "theme")] + [T.StructField("sentiment", T.DoubleType()), T.StructField("text", T.StringType())])
FEEDBACK = "seq long, run_id string, metric string, hypothesis_id string, grade string, correction string, analyst string"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with all their dimensions: the fact view of the contract. A plan that reads and shuffles only the
    columns and days that a query asks for."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    orders = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), "o_orderpriority")
    # the dimensions are small at any scale next to the lines; runtime sizes decide on broadcasting them
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = t("part").select("p_partkey", "p_type")
    # accounts meet the orders, of which there are a few times fewer than lines
    placed = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    j = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    discount, shipping = F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax")
    return j.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "order_date", F.col("o_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"), F.col("n_name").alias("city"), F.col("o_orderpriority").alias("channel"), F.col("p_type").alias("category"), F.col("l_returnflag").alias("tier"),
        F.concat(F.lit("WH-"), F.col("l_suppkey") % 4 + 1).alias("warehouse_id"), F.col("l_quantity").cast("double").alias("units"), F.col("l_extendedprice").alias("gross_revenue"),
        discount.alias("discount_amount"), shipping.alias("shipping_cost"), (F.col("l_extendedprice") - discount).alias("net_revenue"), (F.col("l_extendedprice") - discount - shipping).alias("net_revenue_ops"),
    )


def stored_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view joined once and stored in ranges of order_date: for those who read all of it many times over
    (an investigation). All columns of all lines are shuffled and written for it."""
    return kept(spark, sf_dir, "fact", lambda: fact(spark, sf_dir), "order_date", ("order_id",))


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments: one per line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.to_date("l_shipdate").alias("dispatch_date"),
        F.concat(F.lit("WH-"), F.col("l_suppkey") % 4 + 1).alias("warehouse_id"), (F.col("l_linestatus") == "O").alias("on_time"),
    )


class Estate:
    """All tables as views with one cut-off: nothing after `as_of` is visible to any operator."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: date | None = None, keep: bool = True) -> None:
        """keep: whether the fact view is stored at its first use (else every query joins what it needs)."""
        self.spark, self.sf_dir, self.as_of, self.keep = spark, sf_dir, as_of, keep

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _cut(self, df: DataFrame, column: str) -> DataFrame:
        return df if self.as_of is None else df.where(F.col(column) <= F.lit(self.as_of))

    def fact(self) -> DataFrame:
        return self._cut((stored_fact if self.keep else fact)(self.spark, self.sf_dir), "order_date")

    def dispatch(self) -> DataFrame:
        return self._cut(dispatch(self.spark, self.sf_dir), "dispatch_date")

    def sql(self, query: str, telemetry=None, what: str = "governed query") -> DataFrame:
        """SQL over the views `fact` and `dispatch`, noted in the method ledger."""
        self.fact().createOrReplaceTempView("fact")
        self.dispatch().createOrReplaceTempView("dispatch")
        if telemetry is not None:
            telemetry.method("query", "SQL", what)
        return self.spark.sql(query)

    def orders_slice(self, persona: Persona, first: date, last: date, filters: dict | None = None) -> DataFrame:
        """Order lines of a window that the persona may see."""
        return self.fact().where(F.col("order_date").between(F.lit(first), F.lit(last))).where(persona.rows(filters))

    def freshness(self, now: str, slas: dict[str, int]) -> DataFrame:
        """Lag of each source's last day (it ends at 23:00) against its limit, in minutes."""
        latest = self.fact().agg(F.max("order_date").alias("latest")).withColumn("source", F.lit("orders")).unionByName(
            self.dispatch().agg(F.max("dispatch_date").alias("latest")).withColumn("source", F.lit("dispatch")))
        limit = F.create_map(*[F.lit(x) for kv in slas.items() for x in kv])[F.col("source")]
        lag = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp")) - 23 * 3600) / 60
        return latest.select("source", "latest", lag.cast("double").alias("lag_minutes"), limit.cast("int").alias("sla_minutes"), (lag > limit).alias("breached"))


def schema_of(df: DataFrame) -> list[str]:
    """Columns, without a job."""
    return df.columns


def applicable(filters: dict, df: DataFrame) -> tuple[dict, list[str]]:
    """Filters whose column the frame has, and those dropped because its grain lacks it."""
    return {k: v for k, v in filters.items() if k in df.columns}, sorted(k for k in filters if k not in df.columns)


def any_of(pairs: list[dict]) -> Column:
    """(a = .. and b = ..) or (a = .. and b = ..) ..."""
    one = lambda p: reduce(lambda x, y: x & y, [F.col(k) == F.lit(v) for k, v in p.items()])
    return reduce(lambda x, y: x | y, map(one, pairs)) if pairs else F.lit(False)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTIONS).json(path).withColumn("day", F.to_date("ts"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only event log: rows are never changed."""
    df.write.mode("append").parquet(path)


def save_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """Feature snapshot of a run, in its own partition."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_state(path: str, default):
    """Small driver-side state as JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (FileNotFoundError, json.JSONDecodeError):
        return default


def write_state(path: str, value) -> None:
    """Replace the state in one step."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True)
    os.replace(part, path)


def replicate(df: DataFrame, times: int, key: str) -> DataFrame:
    """Every row `times` times, the key suffixed from the second on (for scaling tests)."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.when(F.col("_copy") == 0, F.col(key).cast("string")).otherwise(F.concat_ws("-", key, "_copy"))).drop("_copy")
