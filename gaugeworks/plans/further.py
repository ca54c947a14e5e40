"""Queries of the as-of join, stored sketches, streams that notice silence and lateness, and trees grown on the executors."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from gaugeworks.operators import asof, sketches
from gaugeworks.plans.catalogue import _view, _r, _t, query
from gaugeworks.plans.checks import _folder
from gaugeworks.streaming import ledger, monitors


@query(""" s AS (SELECT o_custkey, CAST(l_shipdate AS DATE) AS day, MAX(l_orderkey) AS sent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS ordered, s.day AS last_shipment, s.sent AS last_order FROM orders o ASOF LEFT JOIN s ON o.o_custkey = s.o_custkey AND CAST(o.o_orderdate AS DATE) >= s.day""")
def last_shipment_before_order(spark, sf_dir):
    """The last shipment that each account got by the day of each of its orders."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
    sent = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day")).join(orders.select("o_orderkey", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "day", F.col("l_orderkey").alias("sent"))
    # of shipments of one day the tie takes the greatest order; orders grow, so they are never broadcast
    found = asof.asof_join(orders, sent, ["o_custkey"], "ordered", "day", ["sent"])
    return found.select("o_orderkey", "ordered", F.col("match.day").alias("last_shipment"), F.col("match.sent").alias("last_order"))


@query(""" w(k) AS (VALUES (0), (30), (90)), x AS (SELECT region AS slice, 'w' || k AS win, net_revenue, account_id FROM fact, p, w WHERE order_date BETWEEN ws - CAST(k AS INTEGER) AND we)
 SELECT slice, win AS "window", COUNT(*) AS n, COUNT(DISTINCT account_id) AS exact_accounts, TRUE AS accounts_hold, TRUE AS quantiles_hold FROM x GROUP BY 1, 2""")
def sketched_windows(spark, sf_dir):
    """Accounts and percentiles of three windows from the stored sketches, against the exact ones: within five
    hundredths of the count, and three of the rank."""
    from gaugeworks.plans.catalogue import WE, WS

    fact = _view(spark, sf_dir)
    windows = spark.createDataFrame([(f"w{k}", WS - timedelta(days=k), WE) for k in (0, 30, 90)], "window string, ws date, we date")
    told = sketches.of_windows(sketches.daily(fact, "region"), windows)
    rows = fact.join(windows.select("window", F.explode(F.sequence("ws", "we")).alias("order_date")), "order_date").withColumnRenamed("region", "slice")
    rank = lambda q: F.avg((F.col("net_revenue") <= F.col(q)).cast("double"))
    under = lambda q: F.avg((F.col("net_revenue") < F.col(q)).cast("double"))
    near = lambda q, p: (under(q) <= p + 0.03) & (rank(q) >= p - 0.03)
    return rows.join(told.withColumnRenamed("accounts", "guess").drop("n"), ["window", "slice"]).groupBy("slice", "window").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("account_id").alias("exact_accounts"), (F.abs(F.max("guess") - F.countDistinct("account_id")) <= F.greatest(F.lit(2.0), 0.05 * F.countDistinct("account_id"))).alias("accounts_hold"),
        (near("q_1", 0.01) & near("q_50", 0.5) & near("q_99", 0.99)).alias("quantiles_hold"))


def _written(df, path: str, mode: str) -> None:
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode(mode).parquet(path)


@query(""" g AS (SELECT event_type AS source, ts AS last, LEAD(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nxt, MAX(ts) OVER () AS seen FROM events)
 SELECT source, last, last + INTERVAL 90 MINUTE AS due FROM g WHERE COALESCE(nxt, seen) - last > INTERVAL 90 MINUTE""")
def stream_silences(spark, sf_dir):
    """Every hour and a half in which a kind of event was not seen; the last ones by timers alone."""
    path, events = _folder(spark, "events"), _t(spark, sf_dir, "events")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    for k in range(3):
        third = (ends["z"] - ends["a"]) / 3
        _written(events.where((F.col("ts") >= F.lit(ends["a"] + k * third)) & ((F.col("ts") < F.lit(ends["a"] + (k + 1) * third)) if k < 2 else F.lit(True))), path, "append")
    found, out = ledger.silences(monitors.event_stream(spark, path), "event_type", 90), _folder(spark, "silences")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "stream")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("source", F.col("last").cast("timestamp_ntz").alias("last"), F.col("due").cast("timestamp_ntz").alias("due"))


@query(""" m AS (SELECT MAX(ts) AS z FROM events WHERE event_id % 10 <> 0)
 SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS v, COUNT(*) FILTER (WHERE event_id % 10 = 0 AND ts < z - INTERVAL 2 DAY) AS n_late FROM events, m GROUP BY 1, 2""")
def stream_ledger(spark, sf_dir):
    """Daily totals after a tenth of the events has come late and half of them twice: those of the whole table."""
    path, events = _folder(spark, "events"), _t(spark, sf_dir, "events")
    late = F.col("event_id") % 10 == 0
    _written(events.where(~late), path, "append")
    _written(events.where(late).unionByName(events.where(F.col("event_id") % 2 == 0)), path, "append")
    book = ledger.Ledger(spark, _folder(spark, "ledger"))
    book.run(monitors.event_stream(spark, path), _folder(spark, "stream")).awaitTermination()
    return _r(book.totals())


@query()
def replayed_episodes(spark, sf_dir):
    """Candidates of a fortnight of every month and region, of three metrics: all replayed in one plan."""
    from gaugeworks.ml.replay import replay_all
    from gaugeworks.plans.catalogue import CONTRACT
    from gaugeworks.sources import estate
    from gaugeworks.sources.store import stored

    regions = _t(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    months = F.explode(F.array(*[F.lit(date(2000, m, 1)) for m in range(1, 7)])).alias("ws")
    rows = regions.select("value", months).withColumn("metric", F.explode(F.array(*map(F.lit, ("net_revenue", "order_volume", "asp")))))
    episodes = rows.select(F.concat_ws("/", "metric", "value", "ws").alias("episode_id"), "metric", "ws", F.date_add("ws", 13).alias("we"), F.lit("region").alias("dim"), "value")
    # read some ten times: joined and written once, in no order
    fact = stored(_view(spark, sf_dir), "replay-fact")
    return _r(replay_all(fact, estate.dispatch(spark, sf_dir), episodes, CONTRACT), 6)


@query()
def spread_trees(spark, sf_dir):
    """Nodes of a ranker's trees, grown where the candidate rows lie."""
    from gaugeworks.ml.ranker import FEATURES, featurize
    from gaugeworks.ml.spread import SpreadTrees
    from gaugeworks.plans.catalogue import _candidates

    rows = featurize(_candidates(spark, sf_dir))
    trees = SpreadTrees("lambdarank", rounds=3, depth=3, min_child_weight=0.02).fit(rows, [f"f_{n}" for n in FEATURES], "label", "episode_id", order="candidate_id")
    nodes = [(k, int(f), float(t), int(a), int(b), float(v)) for k, (f, t, a, b, v) in enumerate(zip(trees.feature, trees.threshold, trees.left, trees.right, trees.value, strict=True))]
    return _r(spark.createDataFrame(nodes, "node int, feature int, threshold double, left int, right int, value double"), 6)
