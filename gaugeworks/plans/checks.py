"""Further queries with their SQL: sources and sinks, refusals, rules, scalar functions and streams.

Rules on small results (contract, definitions, routing of refusals) come as small frames; their SQL
states what they must give for the default contract.
"""

from __future__ import annotations

import json
import uuid
import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import telemetry
from gaugeworks.contract import ContractError, Definition, DefinitionSet
from gaugeworks.functions import fiscal, scalars
from gaugeworks.ml import metrics, ranker
from gaugeworks.operators import causal, definitions, drift, feedback, hierarchy, narrative, triage
from gaugeworks.operators.graph import CausalGraph
from gaugeworks.operators.ladder import grade
from gaugeworks.plans.catalogue import _EP, _EXPO, _LABELLED, _LOG_SQL, _SHARES, ANALYST, CONTRACT, MANAGER, QUERIES, WE, WS, _episodes, _exposure, _view, _labelled, _log, _r, _t, query
from gaugeworks.sources import estate
from gaugeworks.sources.store import scratch_path
from gaugeworks.telemetry import METHODS, Telemetry


def _folder(spark, name: str) -> str:
    return scratch_path(spark, name)


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path, df = _folder(spark, "csv"), _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    estate.write_csv(df, path)
    return estate.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT CAST(doc_id AS VARCHAR) AS interaction_id, '2000-01-' || LPAD(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS ts, source AS type, lang AS region, text, DATE '2000-01-01' + CAST(doc_id % 28 AS INTEGER) AS day FROM documents")
def interactions_round_trip(spark, sf_dir):
    path = _folder(spark, "interactions")
    day = F.concat(F.lit("2000-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    estate.write_json(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("interaction_id"), day.alias("ts"), F.col("source").alias("type"), F.col("lang").alias("region"), "text"), path)
    return estate.read_interactions(spark, path).select("interaction_id", "ts", "type", "region", "text", "day")


@query("SELECT order_id, line_no, segment FROM fact WHERE region = 'ASIA' AND tier = 'R'")
def table_sink(spark, sf_dir):
    path = _folder(spark, "sink")
    estate.write_table(_view(spark, sf_dir).select("order_id", "line_no", "segment", "region", "tier"), path, ("region",))
    return spark.read.parquet(path).where("region = 'ASIA' AND tier = 'R'").select("order_id", "line_no", "segment")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE toxic = 1")
def event_log_append(spark, sf_dir):
    path, df = _folder(spark, "log"), _t(spark, sf_dir, "labels")
    estate.append_log(df.select("doc_id", "quality"), path)
    estate.append_log(df.where("toxic = 1").select("doc_id", "quality"), path)
    return spark.read.parquet(path)


@query("SELECT doc_id, quality, 'r' || CAST(k AS VARCHAR) AS run_id FROM labels, range(2) t(k) WHERE quality = k")
def feature_snapshots(spark, sf_dir):
    path, df = _folder(spark, "snapshots"), _t(spark, sf_dir, "labels").select("doc_id", "quality")
    for k in (0, 1):
        estate.save_snapshot(df.where(F.col("quality") == k), path, f"r{k}")
    return spark.read.parquet(path).select("doc_id", "quality", F.col("run_id").cast("string").alias("run_id"))


@query("SELECT column_name AS c FROM (VALUES ('order_id'), ('line_no'), ('order_date'), ('account_id'), ('segment'), ('region'), ('city'), ('channel'), ('category'), ('tier'), ('warehouse_id'), ('units'), ('gross_revenue'), ('discount_amount'), ('shipping_cost'), ('net_revenue'), ('net_revenue_ops')) t(column_name)")
def schema_probe(spark, sf_dir):
    return _frame(spark, [(c,) for c in estate.schema_of(_view(spark, sf_dir))], "c string")


@query("SELECT region, COUNT(*) AS n FROM fact WHERE segment = 'BUILDING' GROUP BY 1")
def governed_sql(spark, sf_dir):
    return estate.Estate(spark, sf_dir, keep=False).sql("SELECT region, COUNT(*) AS n FROM fact WHERE segment = 'BUILDING' GROUP BY region", Telemetry())


@query("SELECT COUNT(*) AS n, 'tier' AS dropped FROM disp WHERE warehouse_id = 'WH-2'")
def grain_aware_filters(spark, sf_dir):
    ships = estate.dispatch(spark, sf_dir)
    used, dropped = estate.applicable({"warehouse_id": "WH-2", "tier": "R"}, ships)
    return ships.where(estate.any_of([used])).agg(F.count(F.lit(1)).alias("n")).withColumn("dropped", F.lit(",".join(dropped)))


# ---------------------------------------------------------------- security and refusals


@query("SELECT order_id, line_no, ROUND(net_revenue, 4) AS net_revenue FROM fact WHERE region = 'ASIA' AND line_no = 1")
def column_security(spark, sf_dir):
    return _r(MANAGER.columns(_view(spark, sf_dir).where(MANAGER.rows()).where("line_no = 1").select("order_id", "line_no", "net_revenue", "net_revenue_ops")))


@query("SELECT r_name AS region, r_name = 'ASIA' AS may_see, r_name <> 'ASIA' AS refused FROM region")
def row_predicate(spark, sf_dir):
    rows = [(r["r_name"], MANAGER.may_see_row({"region": r["r_name"]}), bool(MANAGER.refused({"region": r["r_name"]}))) for r in _t(spark, sf_dir, "region").collect()]
    return _frame(spark, rows, "region string, may_see boolean, refused boolean")


@query(""" d AS (SELECT UNNEST([{'dimension': 'region', 'v': region}, {'dimension': 'city', 'v': city}, {'dimension': 'channel', 'v': channel}, {'dimension': 'category', 'v': category}, {'dimension': 'warehouse_id', 'v': warehouse_id}]) AS x FROM fact),
 m AS (SELECT x.dimension AS dimension, COUNT(DISTINCT x.v) AS members FROM d GROUP BY 1)
 SELECT metric, dimension, members, metric <> 'otd_pct' OR dimension IN ('region', 'warehouse_id', 'category') AS sliceable FROM m, (VALUES ('net_revenue'), ('otd_pct')) t(metric)""")
def sliceability(spark, sf_dir):
    """By which dimensions of the fact, and of how many members each, a metric may be cut."""
    dims = ("region", "city", "channel", "category", "warehouse_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dims]))
    members = _view(spark, sf_dir).select(pairs.alias("x")).groupBy("x.dimension").agg(F.countDistinct("x.v").alias("members"))
    rules = _frame(spark, [(m, d, CONTRACT.sliceable(m, d)) for m in ("net_revenue", "otd_pct") for d in dims], "metric string, dimension string, sliceable boolean")
    return rules.join(members, "dimension").select("metric", "dimension", "members", "sliceable")


@query("SELECT 'reorder_rate_28d' AS metric, TRUE AS refused")
def derived_roll_up_refused(spark, sf_dir):
    try:
        hierarchy.by_level(_view(spark, sf_dir), CONTRACT.metric("reorder_rate_28d"), "region")
        refused = False
    except ContractError:
        refused = True
    return _frame(spark, [("reorder_rate_28d", refused)], "metric string, refused boolean")


@query("SELECT * FROM (VALUES ('a', 'b', 'expression', 'owner', TRUE), ('a', 'c', '', 'authority,scope', FALSE)) t(one, other, computational, contextual, conflict)")
def definition_compare(spark, sf_dir):
    a, b, c = Definition("a", "SUM( x )", "x", "o1"), Definition("b", "sum(y)", "x", "o2"), Definition("c", "sum( x )", "x", "o1", "mgmt", scope="north")
    rows = [(x.key, y.key, ",".join((d := definitions.compare(x, y))["computational"]), ",".join(d["contextual"]), d["conflict"]) for x, y in ((a, b), (a, c))]
    return _frame(spark, rows, "one string, other string, computational string, contextual string, conflict boolean")


@query("SELECT * FROM (VALUES ('agreed', 'AGREED', 'a'), ('ruled', 'RESOLVED', 'b'), ('open', 'UNRESOLVED', NULL)) t(\"case\", status, selected)")
def definition_resolution(spark, sf_dir):
    a, b = Definition("a", "sum(x)", "x"), Definition("b", "sum(y)", "y")
    cases = {"agreed": DefinitionSet("m", (a, replace(a, key="b", owner="else"))), "ruled": DefinitionSet("m", (a, b), "authority_precedence", ("b", "a")), "open": DefinitionSet("m", (a, b))}
    return _frame(spark, [(k, (r := definitions.resolve(v))["status"], r["selected"]) for k, v in cases.items()], "case string, status string, selected string")


@query("""SELECT region, 'net_revenue' AS metric, 'finance' AS selected, 'operations' AS rejected, ROUND(SUM(net_revenue), 4) AS v FROM fact GROUP BY 1
 UNION ALL SELECT region, 'order_volume', 'finance', '', ROUND(SUM(units), 4) FROM fact GROUP BY 1""")
def definition_rewrite(spark, sf_dir):
    """Metrics measured over the fact by the column that their selected definition names."""
    rules = [(m, CONTRACT.selected[m], CONTRACT.measure_column(m), ",".join(definitions.resolve(CONTRACT.definitions[m])["rejected"])) for m in ("net_revenue", "order_volume")]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("selected"), F.lit(r).alias("rejected"), F.col(c).cast("double").alias("v")) for m, k, c, r in rules]))
    return _r(_view(spark, sf_dir).select("region", each.alias("x")).groupBy("region", "x.metric", "x.selected", "x.rejected").agg(F.sum("x.v").alias("v")))


@query("SELECT n_name AS city, r_name AS region, 'city' AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT NULL, r_name, 'region' FROM region")
def hierarchy_members(spark, sf_dir):
    places = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("city"))
    h = hierarchy.Hierarchy.from_table("region", ("region", "city"), places)
    rows = [(c, h.roll_up(c), h.level_of(c)) for r in h.members("region") for c in h.drill_down(r)] + [(None, r, h.level_of(r)) for r in h.members("region")]
    return _frame(spark, rows, "city string, region string, level string")


@query("""SELECT metric, level, available, COUNT(DISTINCT CASE level WHEN 'region' THEN region ELSE city END) AS members FROM fact, (VALUES ('net_revenue', 'region', TRUE), ('net_revenue', 'city', TRUE), ('otd_pct', 'region', TRUE), ('otd_pct', 'city', FALSE)) t(metric, level, available) GROUP BY ALL""")
def level_availability(spark, sf_dir):
    """The levels that a metric can be rolled up to, with the members that the fact has of each."""
    rules = _frame(spark, [(m, r["level"], r["available"]) for m in ("net_revenue", "otd_pct") for r in hierarchy.available_levels(CONTRACT, m)], "metric string, level string, available boolean")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.col(d).alias("v")) for d in ("region", "city")]))
    members = _view(spark, sf_dir).select(pairs.alias("x")).groupBy("x.level").agg(F.countDistinct("x.v").alias("members"))
    return rules.join(members, "level").select("metric", "level", "available", "members")


# ---------------------------------------------------------------- fitness, drift, sweep


def _completeness_sql(source: str, day: str, view: str) -> str:
    return f"""SELECT 'completeness' AS dimension, '{source}' AS source, CASE WHEN rm / bm < 0.6 THEN 'critical' WHEN rm / bm < 0.85 THEN 'major' END AS severity, CAST(FLOOR(rm) AS BIGINT) AS n FROM (
  WITH d AS (SELECT {day} d, COUNT(*) n FROM {view} GROUP BY 1) SELECT (SELECT MEDIAN(n) FROM d, p WHERE d BETWEEN we - 6 AND we) rm, (SELECT MEDIAN(n) FROM (SELECT n FROM d, p WHERE d < we - 6 ORDER BY d DESC LIMIT 28)) bm)"""


@query(f""" c AS (SELECT warehouse_id, COUNT(*) FILTER (WHERE dispatch_date >= we - 6) rn, COUNT(*) FILTER (WHERE dispatch_date < we - 6) bn, COUNT(*) FILTER (WHERE dispatch_date >= we - 6 AND NOT on_time) rl,
  COUNT(*) FILTER (WHERE dispatch_date < we - 6 AND NOT on_time) bl FROM disp, p WHERE dispatch_date BETWEEN we - 34 AND we GROUP BY 1),
 x AS ({_completeness_sql('orders', 'order_date', 'fact')} UNION ALL {_completeness_sql('dispatch', 'dispatch_date', 'disp')}
  UNION ALL SELECT 'partition', 'dispatch', CASE WHEN bn / 4.0 > 5 AND rn < 0.55 * bn / 4.0 THEN 'critical' END, rn FROM c
  UNION ALL SELECT 'class', 'dispatch', CASE WHEN COALESCE(bl::DOUBLE / NULLIF(bn, 0), 0) > 0.02 AND rn > 20 AND COALESCE(rl::DOUBLE / NULLIF(rn, 0), 0) < 0.3 * COALESCE(bl::DOUBLE / NULLIF(bn, 0), 0) THEN 'critical' END, rn FROM c
  UNION ALL SELECT 'consistency', 'dispatch', CASE WHEN COUNT(*) > 0 THEN 'major' END, COUNT(*) FROM disp WHERE order_id NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'consistency', 'dispatch', CASE WHEN COUNT(*) > 0 THEN 'major' END, COUNT(*) FROM disp JOIN orders ON order_id = o_orderkey WHERE dispatch_date < CAST(o_orderdate AS DATE)
  UNION ALL SELECT 'consistency', 'orders', CASE WHEN COUNT(DISTINCT account_id) > 0 THEN 'major' END, COUNT(DISTINCT account_id) FROM fact WHERE account_id NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'uniqueness', 'orders', CASE WHEN COUNT(*) > 0 THEN 'minor' END, COUNT(*) FROM (SELECT order_id FROM fact GROUP BY 1 HAVING COUNT(*) > COUNT(DISTINCT CAST(account_id AS VARCHAR) || '|' || CAST(order_date AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)))
  UNION ALL SELECT 'validity', 'orders', CASE WHEN COUNT(*) > 0 THEN 'major' END, COUNT(*) FROM fact WHERE units <= 0 OR net_revenue < 0 OR discount_amount < 0 OR discount_amount > gross_revenue)
 SELECT dimension, source, severity, n FROM x WHERE severity IS NOT NULL""")
def fitness_issues(spark, sf_dir):
    return QUERIES["fitness_assessment"](spark, sf_dir)


@query(_SHARES + """, c AS (SELECT dimension, GREATEST(e, 1e-6) e, GREATEST(a, 1e-6) a FROM s), n AS (SELECT dimension, e / SUM(e) OVER (PARTITION BY dimension) e, a / SUM(a) OVER (PARTITION BY dimension) a FROM c),
 z AS (SELECT dimension, SUM((a - e) * LN(a / e)) AS psi FROM n GROUP BY 1) SELECT dimension, ROUND(psi, 6) AS psi FROM z ORDER BY psi DESC LIMIT 1""")
def worst_drift(spark, sf_dir):
    return _r(drift.worst(drift.psi(drift.share_table(_view(spark, sf_dir), WS, WE))), 6)


@query(""" x AS (SELECT account_id, order_date, FLOOR(net_revenue / 100) AS amount, units FROM fact), r AS (SELECT quantile_cont(amount, 0.01) a1, quantile_cont(amount, 0.99) a9, quantile_cont(units, 0.01) u1, quantile_cont(units, 0.99) u9 FROM x, p WHERE order_date < ws),
 o AS (SELECT account_id, COUNT(*) AS n, AVG(CASE WHEN amount BETWEEN a1 AND a9 AND units BETWEEN u1 AND u9 THEN 0.0 ELSE 1.0 END) AS share FROM x, r, p WHERE order_date >= ws GROUP BY 1)
 SELECT c_custkey AS account_id, COALESCE(n, 0) AS n, ROUND(share, 6) AS outside_share, CASE WHEN share IS NULL THEN 'NO_MODEL' WHEN share > 0.35 THEN 'DRIFTED' WHEN share > 0.15 THEN 'SHIFTING' ELSE 'STABLE' END AS status, share IS NULL OR share > 0.35 AS withdrawn FROM customer LEFT JOIN o ON c_custkey = account_id""")
def model_authority(spark, sf_dir):
    """Where a model fitted on the lines before the window may still speak: by account, from the window on."""
    rows = _view(spark, sf_dir).select("account_id", "order_date", F.floor(F.col("net_revenue") / 100).cast("double").alias("amount"), "units")
    shares = drift.outside_shares(rows.where(F.col("order_date") >= F.lit(WS)), rows.where(F.col("order_date") < F.lit(WS)), ("account_id",), ("amount", "units"))
    everyone = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id")).join(shares, "account_id", "left")
    status = drift.authority(F.col("outside_share"))
    return _r(everyone.select("account_id", F.coalesce("n", F.lit(0)).alias("n"), "outside_share", status.alias("status"), status.isin("DRIFTED", "NO_MODEL").alias("withdrawn")), 6)


def _sweep_sql(metric: str, value: str, inr: bool, days: int) -> str:
    """Verdicts of one metric over all slices; tables get the metric's name at the end."""
    m = metric
    floor = "ABS(act - ex) >= 2500000" if inr else "TRUE"
    return f""" s_{m} AS (SELECT slice, d, {value} v FROM base, p WHERE d <= we GROUP BY 1, 2),
 c_{m} AS (SELECT slice, d, v, isodow(d) - 1 AS wd, CASE WHEN COUNT(v) OVER w >= 4 THEN MEDIAN(v) OVER w END AS c FROM s_{m} WINDOW w AS (PARTITION BY slice ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 r_{m} AS (SELECT slice, wd, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(v / c) END m FROM c_{m} WHERE c <> 0 GROUP BY 1, 2),
 q_{m} AS (SELECT DISTINCT slice, k AS wd FROM s_{m}, range(7) t(k)),
 i_{m} AS (SELECT q.slice, q.wd, COALESCE(m, 1) / AVG(COALESCE(m, 1)) OVER (PARTITION BY q.slice) AS idx FROM q_{m} q LEFT JOIN r_{m} r ON r.wd = q.wd AND r.slice = q.slice),
 f_{m} AS (SELECT c.slice, d, v, idx, v / idx AS flat FROM c_{m} c JOIN i_{m} i ON c.slice = i.slice AND c.wd = i.wd),
 b_{m} AS (SELECT slice, d, v, CASE WHEN COUNT(flat) OVER w >= 7 THEN MEDIAN(flat) OVER w END * idx AS e FROM f_{m} WINDOW w AS (PARTITION BY slice ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
 k_{m} AS (SELECT slice, MEDIAN(v - e) c, COUNT(*) hd FROM b_{m}, p WHERE d < ws GROUP BY 1),
 g_{m} AS (SELECT b.slice, 1.4826 * MEDIAN(ABS(v - e - k.c)) sigma FROM b_{m} b JOIN k_{m} k ON b.slice = k.slice, p WHERE d < ws AND e IS NOT NULL GROUP BY 1),
 w_{m} AS (SELECT b.slice, SUM(v) act, SUM(e) ex, COUNT(*) n, COUNT(*) FILTER (WHERE ABS(v - e) > 2.0 * sigma) per, MIN(sigma) sigma FROM b_{m} b JOIN g_{m} g ON b.slice = g.slice, p WHERE d BETWEEN ws AND we AND e IS NOT NULL GROUP BY 1),
 z_{m} AS (SELECT '{m}' AS metric, g.slice, act, ex, (act - ex) / (w.sigma * SQRT(n)) z, per, CASE WHEN act IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN {floor} AND per >= {days} AND ABS((act - ex) / (w.sigma * SQRT(n))) >= 2 THEN 'MATERIAL' ELSE 'NOT_MATERIAL' END AS verdict FROM g_{m} g LEFT JOIN w_{m} w ON w.slice = g.slice)"""


_ALL = (
    " base AS (SELECT k || '=' || v AS slice, order_date AS d, net_revenue AS net, units FROM (SELECT UNNEST(['region', 'segment', 'channel', 'category']) AS k, UNNEST([region, segment, channel, category]) AS v, order_date, net_revenue, units FROM fact)),"
    + _sweep_sql("net_revenue", "SUM(net)", True, 3) + "," + _sweep_sql("order_volume", "SUM(units)", False, 3) + "," + _sweep_sql("asp", "SUM(net) / NULLIF(SUM(units), 0)", False, 5)
    + ", every AS (SELECT * FROM z_net_revenue UNION ALL SELECT * FROM z_order_volume UNION ALL SELECT * FROM z_asp)"
)


@query(_ALL + " SELECT metric, slice, ROUND(act, 4) AS actual, ROUND(ex, 3) AS expected, ROUND(z, 5) AS z, per AS persistence, verdict FROM every")
def sweep_verdicts(spark, sf_dir):
    df = triage.sweep(_view(spark, sf_dir), CONTRACT, ["net_revenue", "order_volume", "asp"], WS, WE)
    return df.select("metric", "slice", F.round("actual", 4).alias("actual"), F.round("expected", 3).alias("expected"), F.round("z", 5).alias("z"), "persistence", "verdict")


@query(_ALL + " SELECT metric, slice, ROUND(z, 5) AS z FROM every WHERE verdict = 'MATERIAL' ORDER BY ABS(z) DESC, metric, slice LIMIT 12")
def worklist(spark, sf_dir):
    swept = triage.sweep(_view(spark, sf_dir), CONTRACT, ["net_revenue", "order_volume", "asp"], WS, WE)
    return triage.worklist(swept).select("metric", "slice", F.round("z", 5).alias("z"))


@query(_EXPO + ", b AS (SELECT CASE WHEN late <= 0.5 THEN 0 WHEN late <= 2.5 THEN 1 WHEN late <= 5.5 THEN 2 ELSE 3 END AS k, AVG(change) m FROM ex GROUP BY 1 HAVING COUNT(*) >= 3), s AS (SELECT k, m - LAG(m) OVER (ORDER BY k) AS step FROM b) SELECT COALESCE(BOOL_AND(step <= 0), FALSE) AS monotone, COUNT(*) AS buckets FROM s")
def monotone_dose(spark, sf_dir):
    return causal.monotone(causal.dose_buckets(_exposure(spark, sf_dir)))


# ---------------------------------------------------------------- rules and scalar functions


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS slug FROM part")
def slugs(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, 'L' || (doc_id % 4) AS ladder, CASE doc_id % 4 WHEN 0 THEN 0.20 WHEN 1 THEN 0.40 WHEN 2 THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence FROM labels UNION ALL SELECT doc_id, 'REJECTED', 0.0 FROM labels WHERE toxic = 1")
def ladder_lookup(spark, sf_dir):
    """The confidence of a rung for each label; toxic ones are rejected besides."""
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.explode(F.array_compact(F.array(F.concat(F.lit("L"), F.col("doc_id") % 4), F.when(F.col("toxic") == 1, "REJECTED")))).alias("ladder"))
    return rows.select("doc_id", "ladder", scalars.ladder_confidence(F.col("ladder")).alias("confidence"))


@query("SELECT p_partkey, ROUND(CAST(CASE WHEN x <= 1 THEN 10 WHEN x <= 3 THEN 10 + (x - 1) * 10 WHEN x <= 4 THEN 30 + (x - 3) * 5 ELSE 35 END AS DOUBLE), 9) AS y FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x FROM part)")
def interpolation(spark, sf_dir):
    """A calibration curve by its knots, over the sizes of parts."""

    @F.pandas_udf("double")
    def curve(x):  # noqa: ANN001
        import pandas as pd

        return pd.Series(scalars.interpolate(x.to_numpy(), [1, 3, 4], [10, 30, 35]))

    return _r(_t(spark, sf_dir, "part").select("p_partkey", curve(F.col("p_size") / 10.0).alias("y")), 9)


@query(f""" e AS (SELECT user_id, list_extract({list(METHODS)!r}, CAST(event_id % {len(METHODS)} AS INTEGER) + 1) AS m, CAST(FLOOR(value * 10) AS BIGINT) AS ti, CAST(FLOOR(value) AS BIGINT) AS tt FROM events)
 SELECT user_id, COUNT(*) AS steps, {", ".join(f"COUNT(*) FILTER (m = '{m}') AS {m.lower()}" for m in METHODS)}, COALESCE(SUM(ti), 0)::BIGINT AS tokens_in, COALESCE(SUM(tt), 0)::BIGINT AS tokens_out,
 ROUND(100.0 * COUNT(*) FILTER (m <> 'LLM') / COUNT(*), 6)::DOUBLE AS non_llm_pct, ROUND((COALESCE(SUM(ti), 0) * 3.0::DOUBLE + COALESCE(SUM(tt), 0) * 15.0::DOUBLE) / 1e6, 6) AS cost FROM e GROUP BY 1""")
def method_mix(spark, sf_dir):
    """The events as a ledger of steps: what each user's steps were made by, and what they cost."""
    method = F.get(F.array(*map(F.lit, METHODS)), (F.col("event_id") % len(METHODS)).cast("int"))
    ledger = _t(spark, sf_dir, "events").select("user_id", method.alias("method"), F.floor(F.col("value") * 10).alias("tokens_in"), F.floor("value").alias("tokens_out"))
    return _r(telemetry.method_mix(ledger, ("user_id",), 3.0, 15.0), 6)


@query(""" w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ws, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS we FROM orders), y AS (SELECT *, YEAR(ws) + CASE WHEN MONTH(ws) >= 4 THEN 1 ELSE 0 END AS a, YEAR(we) + CASE WHEN MONTH(we) >= 4 THEN 1 ELSE 0 END AS z FROM w)
 SELECT o_orderkey, ws, we, a <> z AS crosses_year, a <> z OR (MONTH(ws) + 8) % 12 // 3 <> (MONTH(we) + 8) % 12 // 3 AS crosses_quarter, CAST(a AS INTEGER) AS fiscal_year FROM y""")
def window_description(spark, sf_dir):
    """Windows that begin with an order, and the fiscal periods that they cross."""
    day = F.to_date("o_orderdate")
    w = _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("ws"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("we"))
    year, quarter = (lambda c: fiscal.fiscal_year(F.col(c)).cast("int")), (lambda c: fiscal.fiscal_quarter(F.col(c)))
    crosses = year("ws") != year("we")
    return w.select("o_orderkey", "ws", "we", crosses.alias("crosses_year"), (crosses | (quarter("ws") != quarter("we"))).alias("crosses_quarter"), year("ws").alias("fiscal_year"))


@query("SELECT * FROM (VALUES ('warehouse_sla', 'L3'), ('nothing', 'REJECTED'), ('price_level', 'L1'), ('tier_mix', 'L0')) t(cause, ladder)")
def evidence_grades(spark, sf_dir):
    g = CausalGraph(CONTRACT.edges, CONTRACT.blocked)
    did = {"counterfactual": {"enough": True, "parallel": True, "p_value": 0.01}}
    cases = (("warehouse_sla", did), ("nothing", did), ("price_level", {"precedence": {"consistent": True}}), ("tier_mix", {}))
    h = lambda cause: {"id": "H", "driver_type": "service_failure", "cause": cause, "explanatory_power": 0.5, "exposure": {}}
    return _frame(spark, [(c, grade(h(c), "net_revenue", g, t)["ladder"]) for c, t in cases], "cause string, ladder string")


@query("SELECT * FROM (VALUES ('offline', 'offline', TRUE, 1), ('simulate', 'simulate', TRUE, 1), ('simulate_bad', 'fallback', TRUE, 2)) t(asked, mode, passed, attempts)")
def narration_modes(spark, sf_dir):
    packet = narrative.evidence_packet({"actual": 100.0, "expected": 150.0, "delta": -50.0}, [], {"status": "UNKNOWN", "leaders": []}, [], None, ANALYST, "net_revenue")
    rows = [(m, (t := narrative.told(packet, ANALYST, m))["mode"], t["guard"]["passed"], t["attempts"]) for m in ("offline", "simulate", "simulate_bad")]
    return _frame(spark, rows, "asked string, mode string, passed boolean, attempts int")


@query(_LOG_SQL + ", x AS (SELECT metric, h, COUNT(*) n FROM lg GROUP BY 1, 2) SELECT metric, h AS hypothesis_id, 1.0::DOUBLE AS prior, n + 1 AS n FROM x")
def priors_after_reset(spark, sf_dir):
    path = _folder(spark, "feedback")
    _log(spark, sf_dir).select("seq", F.lit("run").alias("run_id"), "metric", "hypothesis_id", "grade", "correction", "analyst").write.parquet(path)
    feedback.reset(spark, path, 1 << 40)
    return feedback.priors(feedback.read_log(spark, path))


@query(_LOG_SQL + """, d AS (SELECT 'r' || CAST(seq % 10 AS VARCHAR) AS run_id, h, seq, grade FROM lg WHERE grade <> 'partial'), l AS (SELECT run_id, h, ARG_MAX(grade, seq) AS grade FROM d GROUP BY 1, 2),
 s AS (SELECT DISTINCT 'r' || CAST(doc_id % 10 AS VARCHAR) AS run_id, 'H' || CAST(doc_id % 4 AS VARCHAR) AS h, CASE WHEN doc_id % 10 < 5 THEN '1' ELSE '0' END AS v FROM labels)
 SELECT run_id, h AS hypothesis_id, CASE WHEN grade = 'accept' THEN 1 ELSE 0 END AS label, 5.0::DOUBLE AS weight FROM s JOIN l USING (run_id, h) WHERE v = '1'""")
def training_labels(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("run_id", F.concat(F.lit("r"), (F.col("seq") % 10).cast("string")))
    ids = _t(spark, sf_dir, "labels").select(F.concat(F.lit("r"), (F.col("doc_id") % 10).cast("string")).alias("run_id"), F.concat(F.lit("H"), (F.col("doc_id") % 4).cast("string")).alias("hypothesis_id"), F.when(F.col("doc_id") % 10 < 5, "1").otherwise("0").alias("contract_version")).distinct()
    return feedback.training_rows(log, ids, "1").select("run_id", "hypothesis_id", "label", "weight")


@query(""" c AS (SELECT 'E' || CAST(doc_id % 10 AS VARCHAR) AS episode_id, CAST(doc_id AS VARCHAR) AS candidate_id, 'T' || CAST(doc_id % 3 AS VARCHAR) AS kind FROM labels)
 SELECT episode_id, candidate_id, CASE WHEN kind = 'T1' AND CAST(substr(episode_id, 2) AS INTEGER) < 5 THEN 1 ELSE 0 END AS label FROM c""")
def candidate_labels(spark, sf_dir):
    k = F.col("doc_id")
    c = _t(spark, sf_dir, "labels").select(F.concat(F.lit("E"), (k % 10).cast("string")).alias("episode_id"), k.cast("string").alias("candidate_id"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("driver_type"))
    truth = _frame(spark, [(f"E{i}", "T1", None) for i in range(5)], "episode_id string, driver_type string, entity string")
    return ranker.label(c, truth).select("episode_id", "candidate_id", "label")


@query("SELECT * FROM (VALUES ('share_abs', TRUE), ('Label', FALSE), ('verdict', FALSE)) t(feature, allowed)")
def leakage_guard(spark, sf_dir):
    def allowed(name: str) -> bool:
        try:
            ranker.assert_no_leakage([name])
        except ValueError:
            return False
        return True

    return _frame(spark, [(n, allowed(n)) for n in ("share_abs", "Label", "verdict")], "feature string, allowed boolean")


@query("SELECT 'net_revenue' AS metric, 'net_revenue: unknown' AS subject, -1.85::DOUBLE AS least")
def rendered_message(spark, sf_dir):
    packet = narrative.evidence_packet({"actual": 1.0, "expected": 2.85, "delta": -1.85}, [], {"status": "UNKNOWN", "leaders": []}, [], None, ANALYST, "net_revenue")
    message = narrative.rendered(narrative.narrate(packet, ANALYST), packet, ANALYST)
    return _frame(spark, [(packet["metric"], message["subject"], min(narrative.numbers_of(json.loads(json.dumps(packet["movement"])))))], "metric string, subject string, least double")


# ---------------------------------------------------------------- streams, run over the whole table


def _streamed(df: DataFrame, mode: str) -> DataFrame:
    """A stream run over all that is there, and its result: appended rows as files, tables of totals (a row a
    day or key) in memory."""
    if mode == "append":
        path = _folder(df.sparkSession, "streamed")
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", _folder(df.sparkSession, "stream")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(path)
    name, spark = f"stream_{uuid.uuid4().hex}", df.sparkSession
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _events(spark, sf_dir, times: int = 1) -> DataFrame:
    """The events as a stream, each `times` times."""
    from gaugeworks.streaming import monitors

    path = _folder(spark, "events")
    for _ in range(times - 1):
        _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(2).write.mode("append").parquet(path)
    _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(2).write.mode("append").parquet(path)
    return monitors.event_stream(spark, path, 10)


@query("SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM events GROUP BY 1, 2")
def stream_daily_totals(spark, sf_dir):
    from gaugeworks.streaming import monitors

    return _r(_streamed(monitors.daily_totals(_events(spark, sf_dir)), "complete"))


@query("SELECT DISTINCT event_id FROM events")
def stream_without_duplicates(spark, sf_dir):
    from gaugeworks.streaming import monitors

    events = _events(spark, sf_dir, 2)
    return _streamed(monitors.without_duplicates(events, late="3650 days").select("event_id"), "append")


@query("""SELECT CAST(w AS DATE) AS ws, COUNT(*) AS n FROM (SELECT UNNEST([b, b - INTERVAL 7 DAY]) AS w FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY 1""")
def stream_sliding_totals(spark, sf_dir):
    from gaugeworks.streaming import monitors

    return _streamed(monitors.sliding_totals(_events(spark, sf_dir)), "complete").select(F.to_date("ws").alias("ws"), "n")


@query(""" e AS (SELECT event_type AS slice, ts FROM events WHERE value >= (SELECT QUANTILE_CONT(value, 0.99) FROM events)),
 n AS (SELECT slice, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY slice ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS nw FROM e), g AS (SELECT slice, ts, SUM(nw) OVER (PARTITION BY slice ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM n)
 SELECT slice, CAST(MIN(ts) AS DATE) AS onset, COUNT(*) AS days FROM g GROUP BY slice, g""")
def stream_breach_runs(spark, sf_dir):
    from gaugeworks.streaming import monitors

    limit = _t(spark, sf_dir, "events").agg(F.percentile("value", F.lit(0.99)).alias("v")).first()["v"]
    return _streamed(monitors.breach_runs(_events(spark, sf_dir).where(F.col("value") >= limit).select(F.col("event_type").alias("slice"), "ts")), "complete")


@query(_LOG_SQL + """, g AS (SELECT metric, h, list(grade ORDER BY seq) AS gs FROM lg GROUP BY 1, 2)
 SELECT metric, h AS hypothesis_id, ROUND(list_reduce(list_prepend(1.0::DOUBLE, list_transform(gs, lambda x: CASE WHEN x = 'accept' THEN 2.0 WHEN x = 'reject' THEN -2.0 ELSE 0.0 END::DOUBLE)), lambda a, x: CASE WHEN x > 1 THEN LEAST(1.6, a * 1.12) WHEN x < -1 THEN GREATEST(0.35, a * 0.75) ELSE a END), 6) AS prior FROM g""")
def stream_priors(spark, sf_dir):
    from gaugeworks.streaming import monitors

    path = _folder(spark, "grades")
    _log(spark, sf_dir).select("seq", "metric", "hypothesis_id", "grade").coalesce(1).write.parquet(path)
    grades = spark.readStream.schema("seq long, metric string, hypothesis_id string, grade string").parquet(path)
    return _r(_streamed(monitors.prior_updates(grades), "update"), 6)


@query(_EP + """, r AS (SELECT episode_id, label, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY score DESC, candidate_id) AS s, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY -score DESC, candidate_id) AS w FROM e),
 f AS (SELECT MIN(s) FILTER (WHERE label > 0) AS s, MIN(w) FILTER (WHERE label > 0) AS w FROM r GROUP BY episode_id HAVING SUM(label) > 0)
 SELECT 'score' AS arm, ROUND(AVG(CASE WHEN s = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS top1, ROUND(AVG(1.0::DOUBLE / s), 6) AS mrr, COUNT(*) AS episodes FROM f
 UNION ALL SELECT 'reversed', ROUND(AVG(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6), ROUND(AVG(1.0::DOUBLE / w), 6), COUNT(*) FROM f""")
def arms_compared(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumn("worst", -F.col("score"))
    return _r(metrics.compare(e, {"score": "score", "reversed": "worst"}).select("arm", "top1", "mrr", "episodes"), 6)


@query(_LABELLED + ", b AS (SELECT COUNT(*) n, AVG(score) p, AVG(label) y, SUM(POW(score - label, 2)) e FROM x GROUP BY LEAST(FLOOR(score * 10), 9)) SELECT ROUND(SUM(e) / SUM(n), 6) AS brier, ROUND(SUM(n * ABS(p - y)) / SUM(n), 6) AS ece, CAST(SUM(n) AS BIGINT) AS n FROM b")
def calibration_summary(spark, sf_dir):
    return _r(metrics.calibration_metrics(_labelled(spark, sf_dir), p="score"), 6)


@query("SELECT * FROM (VALUES ('net_revenue', 'orders', 'order_date', 180, 'finance', 'net_revenue'), ('otd_pct', 'dispatch', 'dispatch_date', 2880, NULL, NULL)) t(metric, source, date_column, sla_minutes, definition, measure)")
def metric_lineage(spark, sf_dir):
    rows = [((x := CONTRACT.lineage(m))["metric"], x["source"], x["date"], x["sla_minutes"], x["definition"], x["measure"]) for m in ("net_revenue", "otd_pct")]
    return _frame(spark, rows, "metric string, source string, date_column string, sla_minutes int, definition string, measure string")
