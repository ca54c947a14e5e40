"""Queries over the driver's tables, each with an independent DuckDB formulation where SQL can say it.

The SQL is written on its own: self-joins, correlated filters and DuckDB's own functions rather than
the operators' plans. `fact` and `disp` are the views of sources.estate in SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
from gaugeworks.functions import fiscal, scalars
from gaugeworks.ml import metrics, ranker
from gaugeworks.operators import actions, causal, definitions, drift, feedback, fitness, forecast, graph, hierarchy, propagation, retrieval, series, sift, split, triage
from gaugeworks.operators.security import filter_evidence, personas
from gaugeworks.sources import estate

WS, WE = date(2000, 3, 1), date(2000, 3, 14)
BS, BE = split.baseline(WS)
SCALE = split.scale_of(WS, WE, BS, BE)
REGION, WAREHOUSE = "ASIA", "WH-3"
CONTRACT = default_contract().resolved()
NET, UNITS, ASP, OTD = (CONTRACT.metric(m) for m in ("net_revenue", "order_volume", "asp", "otd_pct"))
ANALYST = personas(CONTRACT.personas)["data_analyst"]
MANAGER = personas(CONTRACT.personas)["regional_manager"]
QUERY_TERMS = ["the", "apache", "license", "version", "license", "token"]

FACT_SQL = """fact AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS account_id,
  c_mktsegment AS segment, r_name AS region, n_name AS city, o_orderpriority AS channel, p_type AS category, l_returnflag AS tier,
  'WH-' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS warehouse_id, CAST(l_quantity AS DOUBLE) AS units, l_extendedprice AS gross_revenue,
  l_extendedprice * l_discount AS discount_amount, l_extendedprice * l_tax AS shipping_cost, l_extendedprice - l_extendedprice * l_discount AS net_revenue,
  l_extendedprice - l_extendedprice * l_discount - l_extendedprice * l_tax AS net_revenue_ops
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
disp AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS dispatch_date, 'WH-' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS warehouse_id,
  l_linestatus = 'O' AS on_time FROM lineitem)"""
DATES_SQL = f"DATE '{WS}' AS ws, DATE '{WE}' AS we, DATE '{BS}' AS bs, DATE '{BE}' AS be, {SCALE!r}::DOUBLE AS sc"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) as a query, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = f"WITH {FACT_SQL}, p AS (SELECT {DATES_SQL})" + ("," if not sql.lstrip().upper().startswith("SELECT") else "") + sql
        return f

    return add


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view stored for the session, for those who read all of it many times."""
    return estate.stored_fact(spark, sf_dir)


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view as a plan: a query shuffles the columns and days that it asks for, and writes none."""
    return estate.fact(spark, sf_dir)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _daily(spark, sf_dir) -> DataFrame:
    """Daily totals, to four decimals: so the order of summation does not show in what follows."""
    return _r(series.measure_series(_view(spark, sf_dir), "net_revenue"))


_DAILY_SQL = " s AS (SELECT order_date d, ROUND(SUM(net_revenue), 4) v FROM fact GROUP BY 1)"

# ---------------------------------------------------------------- series, levels, definitions


@query("SELECT order_date AS d, ROUND(SUM(net_revenue), 4) AS v FROM fact GROUP BY 1")
def kpi_daily_additive(spark, sf_dir):
    return _r(series.daily_series(_view(spark, sf_dir), NET))


@query("SELECT order_date AS d, ROUND(SUM(net_revenue) / NULLIF(SUM(units), 0), 7) AS v FROM fact GROUP BY 1")
def kpi_daily_ratio(spark, sf_dir):
    return _r(series.daily_series(_view(spark, sf_dir), ASP), 7)


@query("SELECT dispatch_date AS d, ROUND(AVG(CASE WHEN on_time THEN 1.0 ELSE 0.0 END), 6) AS v FROM disp GROUP BY 1")
def kpi_daily_on_time(spark, sf_dir):
    return _r(series.daily_series(estate.dispatch(spark, sf_dir), OTD, "dispatch_date"), 6)


@query(""" o AS (SELECT account_id, order_date d, COUNT(DISTINCT order_id) n FROM fact GROUP BY 1, 2),
 wk AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) w FROM o),
 x AS (SELECT wk.w, o.account_id, SUM(CASE WHEN o.d > wk.w - 28 THEN n ELSE 0 END) orders, SUM(n) seen
  FROM wk JOIN o ON o.d <= wk.w AND o.d > wk.w - 84 GROUP BY 1, 2)
 SELECT wk.w AS d, ROUND(SUM(orders) / CAST(NULLIF(COUNT(x.account_id), 0) AS DOUBLE), 6) AS v, CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders, COUNT(x.account_id) AS enrolled
 FROM wk LEFT JOIN x ON wk.w = x.w GROUP BY 1""")
def reorder_rate_weekly(spark, sf_dir):
    return _r(series.reorder_rate(_view(spark, sf_dir)), 6)


@query("SELECT city, ROUND(SUM(net_revenue), 4) AS num, 1.0::DOUBLE AS den, ROUND(SUM(net_revenue), 4) AS v FROM fact, p WHERE order_date BETWEEN ws AND we GROUP BY 1")
def kpi_by_level_additive(spark, sf_dir):
    return _r(hierarchy.by_level(_view(spark, sf_dir).where(F.col("order_date").between(F.lit(WS), F.lit(WE))), NET, "city"))


@query("SELECT region, ROUND(SUM(net_revenue), 4) AS num, ROUND(SUM(units), 4) AS den, ROUND(SUM(net_revenue) / SUM(units), 4) AS v FROM fact GROUP BY 1")
def kpi_by_level_ratio(spark, sf_dir):
    return _r(hierarchy.by_level(_view(spark, sf_dir), ASP, "region"))


@query("SELECT region, ROUND(SUM(net_revenue), 4) AS num, ROUND(SUM(units), 4) AS den, ROUND(SUM(net_revenue) / SUM(units), 4) AS v FROM fact GROUP BY 1")
def roll_up_ratio(spark, sf_dir):
    f = _view(spark, sf_dir)
    cities = hierarchy.by_level(f, ASP, "city").join(_t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("region")), "city")
    return _r(hierarchy.roll_up_frame(cities, ASP, "region"))


@query(""" a AS (SELECT region, city, SUM(CASE WHEN order_date BETWEEN ws AND we THEN net_revenue ELSE 0 END) c1, SUM(CASE WHEN order_date BETWEEN bs AND be THEN net_revenue ELSE 0 END) * MIN(sc) c0
  FROM fact, p WHERE order_date BETWEEN bs AND we GROUP BY 1, 2),
 t AS (SELECT region, SUM(c1) p1, SUM(c1 - c0) m FROM a GROUP BY 1)
 SELECT region, city, ROUND(c1, 4) AS "current", ROUND(c0, 4) AS expected, ROUND(c1 - c0, 4) AS move, ROUND((c1 - c0) / NULLIF(m, 0), 4) AS share_of_move, TRUE AS closes FROM a JOIN t USING (region)""")
def drill_down_closure(spark, sf_dir):
    return _r(hierarchy.drill_down(_view(spark, sf_dir), NET, "region", "city", WS, WE))


@query("""SELECT region, ROUND(SUM(net_revenue), 4) AS finance, ROUND(SUM(net_revenue_ops), 4) AS operations, ROUND(SUM(shipping_cost), 4) AS gap_operations,
  ROUND(SUM(shipping_cost) / ABS(SUM(net_revenue_ops)), 4) AS gap_pct_operations FROM fact GROUP BY 1""")
def definition_gap(spark, sf_dir):
    return _r(definitions.measure_gap(_view(spark, sf_dir), CONTRACT.definitions["net_revenue"], ("region",)))


@query(""" d AS (SELECT DISTINCT order_date d FROM fact)
 SELECT d, YEAR(d) + CASE WHEN MONTH(d) >= 4 THEN 1 ELSE 0 END AS fiscal_year, CAST(((MONTH(d) + 8) % 12) // 3 + 1 AS INTEGER) AS fiscal_quarter, CAST((MONTH(d) + 8) % 12 + 1 AS INTEGER) AS fiscal_month,
  'FY' || CAST(YEAR(d) + CASE WHEN MONTH(d) >= 4 THEN 1 ELSE 0 END AS VARCHAR) || '-Q' || CAST(((MONTH(d) + 8) % 12) // 3 + 1 AS VARCHAR) AS quarter_token,
  'FY' || CAST(YEAR(d) + CASE WHEN MONTH(d) >= 4 THEN 1 ELSE 0 END AS VARCHAR) || '-M' || LPAD(CAST((MONTH(d) + 8) % 12 + 1 AS VARCHAR), 2, '0') AS month_token,
  CAST(date_trunc('month', d) AS DATE) AS month_start, LAST_DAY(d) AS month_end, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
  MAKE_DATE(YEAR(d) - CASE WHEN MONTH(d) >= 4 THEN 0 ELSE 1 END, 4, 1) AS year_start, MAKE_DATE(YEAR(d) + CASE WHEN MONTH(d) >= 4 THEN 1 ELSE 0 END, 3, 31) AS year_end FROM d""")
def fiscal_calendar(spark, sf_dir):
    return fiscal.describe(_view(spark, sf_dir).select("order_date").distinct(), "order_date")


@query(""" daily AS (SELECT region, order_date d, SUM(net_revenue) v FROM fact GROUP BY 1, 2),
 m AS (SELECT region, YEAR(d) y, MONTH(d) mo, AVG(v) * DAY(LAST_DAY(MIN(d))) * 1.04 pv FROM daily GROUP BY 1, 2, 3),
 x AS (SELECT region, pv, CASE WHEN y = 2000 AND mo = 2 THEN 15 ELSE 11 END od, DAY(LAST_DAY(MAKE_DATE(CAST(y AS BIGINT), CAST(mo AS BIGINT), 1))) dim FROM m WHERE y = 2000 AND mo IN (2, 3))
 SELECT region, DATE '2000-02-15' AS ws, DATE '2000-03-11' AS we, ROUND(SUM(pv * od / dim), 4) AS "plan" FROM x GROUP BY 1""")
def plan_proration(spark, sf_dir):
    windows = spark.sql("select date'2000-02-15' ws, date'2000-03-11' we")
    return _r(sift.prorated_plan(windows, sift.derived_plan(_view(spark, sf_dir)), ("region",)))


# ---------------------------------------------------------------- security, evidence, sources


@query(f"SELECT order_date AS d, ROUND(SUM(net_revenue), 4) AS v FROM fact WHERE region = '{REGION}' AND segment = 'BUILDING' GROUP BY 1")
def rls_filtered_series(spark, sf_dir):
    return _r(series.measure_series(_view(spark, sf_dir).where(MANAGER.rows({"segment": "BUILDING"})), "net_revenue"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(\+91[\-\s]?)?[6-9]\d{9}', '[phone]', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[email]', 'g') AS text FROM documents")
def pii_scrub(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", scalars.scrub_pii(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'domain:src3' WHEN lang NOT IN ('en', 'de') THEN 'row' END AS withheld_reason FROM documents")
def evidence_domain_filter(spark, sf_dir):
    from gaugeworks.operators.security import Persona

    reader = Persona("reader", {"lang": ("en", "de")}, deny_domains=("src3",))
    return filter_evidence(_t(spark, sf_dir, "documents"), reader, "source").select("doc_id", "withheld_reason")


@query("""SELECT 'orders' AS source, MAX(order_date) AS latest, CAST((epoch(TIMESTAMP '2001-08-02 01:00:00') - epoch(CAST(MAX(order_date) AS TIMESTAMP)) - 82800) / 60 AS DOUBLE) AS lag_minutes, 180 AS sla_minutes, (epoch(TIMESTAMP '2001-08-02 01:00:00') - epoch(CAST(MAX(order_date) AS TIMESTAMP)) - 82800) / 60 > 180 AS breached FROM fact
 UNION ALL SELECT 'dispatch', MAX(dispatch_date), CAST((epoch(TIMESTAMP '2001-08-02 01:00:00') - epoch(CAST(MAX(dispatch_date) AS TIMESTAMP)) - 82800) / 60 AS DOUBLE), 2880, (epoch(TIMESTAMP '2001-08-02 01:00:00') - epoch(CAST(MAX(dispatch_date) AS TIMESTAMP)) - 82800) / 60 > 2880 FROM disp""")
def freshness_report(spark, sf_dir):
    return estate.Estate(spark, sf_dir, keep=False).freshness("2001-08-02 01:00:00", {"orders": 180, "dispatch": 2880})


@query("SELECT region, COUNT(*) AS n, MAX(order_date) AS last_day FROM fact WHERE order_date <= DATE '1998-12-31' GROUP BY 1")
def asof_cutoff(spark, sf_dir):
    return estate.Estate(spark, sf_dir, date(1998, 12, 31), keep=False).fact().groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("order_date").alias("last_day"))


@query(f"SELECT order_id, line_no, segment, ROUND(net_revenue, 4) AS net_revenue FROM fact, p WHERE region = '{REGION}' AND order_date BETWEEN ws AND we AND channel IN ('1-URGENT', '2-HIGH')")
def orders_slice(spark, sf_dir):
    return _r(estate.Estate(spark, sf_dir, keep=False).orders_slice(MANAGER, WS, WE, {"channel": ["1-URGENT", "2-HIGH"]}).select("order_id", "line_no", "segment", "net_revenue"))


@query("SELECT region, YEAR(order_date) AS y, MONTH(order_date) AS m, COUNT(*) AS n FROM fact WHERE (YEAR(order_date) = 1999 AND MONTH(order_date) = 12) OR (YEAR(order_date) = 2000 AND MONTH(order_date) = 1) GROUP BY 1, 2, 3")
def or_of_pairs(spark, sf_dir):
    f = _view(spark, sf_dir).withColumn("y", F.year("order_date")).withColumn("m", F.month("order_date"))
    return f.where(estate.any_of([{"y": 1999, "m": 12}, {"y": 2000, "m": 1}])).groupBy("region", "y", "m").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) || CASE WHEN k = 0 THEN '' ELSE '-' || CAST(k AS VARCHAR) END AS c_custkey, c_mktsegment FROM customer, range(3) t(k)")
def replicate_rows(spark, sf_dir):
    return estate.replicate(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 3, "c_custkey")


# ---------------------------------------------------------------- fitness


@query("SELECT order_date AS d, COUNT(*) AS n FROM fact GROUP BY 1")
def daily_row_profile(spark, sf_dir):
    return fitness.daily_profile(_view(spark, sf_dir), "order_date")


@query(""" d AS (SELECT order_date d, COUNT(*) n FROM fact GROUP BY 1), r AS (SELECT n FROM d, p WHERE d BETWEEN we - 6 AND we), b AS (SELECT n FROM d, p WHERE d < we - 6 ORDER BY d DESC LIMIT 28),
 m AS (SELECT (SELECT MEDIAN(n) FROM r) rm, (SELECT MEDIAN(n) FROM b) bm)
 SELECT CAST(rm AS DOUBLE) AS recent_median, CAST(bm AS DOUBLE) AS base_median, ROUND(rm / bm, 6) AS ratio, CASE WHEN rm / bm < 0.6 THEN 'critical' WHEN rm / bm < 0.85 THEN 'major' END AS severity FROM m""")
def completeness(spark, sf_dir):
    return _r(fitness.completeness(fitness.daily_profile(_view(spark, sf_dir), "order_date"), WE), 6)


@query(""" c AS (SELECT warehouse_id, COUNT(*) FILTER (WHERE dispatch_date >= we - 6) rn, COUNT(*) FILTER (WHERE dispatch_date < we - 6) bn, COUNT(*) FILTER (WHERE dispatch_date >= we - 6 AND NOT on_time) rl,
  COUNT(*) FILTER (WHERE dispatch_date < we - 6 AND NOT on_time) bl FROM disp, p WHERE dispatch_date BETWEEN we - 34 AND we GROUP BY 1)
 SELECT warehouse_id, rn AS recent_n, bn AS base_n, rl AS recent_late, bl AS base_late, bn / 4.0::DOUBLE AS expected_n, bn / 4.0 > 5 AND rn < 0.55 * bn / 4.0 AS partial,
  COALESCE(bl::DOUBLE / NULLIF(bn, 0), 0) > 0.02 AND rn > 20 AND COALESCE(rl::DOUBLE / NULLIF(rn, 0), 0) < 0.3 * COALESCE(bl::DOUBLE / NULLIF(bn, 0), 0) AS class_missing FROM c""")
def partition_completeness(spark, sf_dir):
    return fitness.partition_completeness(estate.dispatch(spark, sf_dir), WE)


@query("SELECT d.order_id, d.line_no FROM disp d LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON d.order_id = o.o_orderkey WHERE o.o_orderkey IS NULL")
def orphan_anti_join(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"))
    return fitness.orphans(estate.dispatch(spark, sf_dir), known, "order_id").select("order_id", "line_no")


@query("SELECT warehouse_id, COUNT(*) AS n FROM disp JOIN orders ON order_id = o_orderkey WHERE dispatch_date < CAST(o_orderdate AS DATE) GROUP BY 1")
def chronology_violations(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))
    return fitness.chronology_violations(estate.dispatch(spark, sf_dir), orders).groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT COUNT(*) AS \"rows\", COUNT(*) FILTER (WHERE units <= 0) AS bad_units, COUNT(*) FILTER (WHERE net_revenue < 0) AS negative_revenue, COUNT(*) FILTER (WHERE discount_amount < 0 OR discount_amount > gross_revenue) AS bad_discount FROM fact")
def validity_counts(spark, sf_dir):
    return fitness.validity(_view(spark, sf_dir))


@query("SELECT order_id, COUNT(*) AS n, COUNT(DISTINCT CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)) AS distinct_n FROM fact GROUP BY 1 HAVING COUNT(*) > COUNT(DISTINCT CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR))")
def duplicate_lines(spark, sf_dir):
    return fitness.duplicate_keys(_view(spark, sf_dir), "order_id", ["order_id", "line_no"])


@query("SELECT DISTINCT o_custkey AS account_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unknown_accounts(spark, sf_dir):
    good = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    return fitness.unknown_members(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id")), good, "account_id")


@query("""SELECT CAST(SUM(CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 0.45 ELSE 0.12 END) AS DOUBLE) AS penalty, COUNT(*) AS issues, COUNT(*) FILTER (WHERE toxic = 1) AS critical,
  ROUND(GREATEST(0, 1 - SUM(CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 0.45 ELSE 0.12 END) / (400 * 0.55)), 6)::DOUBLE AS score, 'labels' AS k,
  CASE WHEN COUNT(*) FILTER (WHERE toxic = 1) > 0 AND GREATEST(0, 1 - SUM(CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 0.45 ELSE 0.12 END) / (400 * 0.55)) < 0.55 THEN 'UNFIT' WHEN COUNT(*) > 0 THEN 'FIT_WITH_CAVEATS' ELSE 'FIT' END AS verdict FROM labels""")
def fitness_score(spark, sf_dir):
    """The labels as issues: toxic ones critical, poor ones major, others minor."""
    issues = _t(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "major").otherwise("minor").alias("severity"))
    return _r(fitness.score(issues, 400), 6).withColumn("k", F.lit("labels"))


@query()
def fitness_assessment(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))
    accounts = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    return fitness.assess(_view(spark, sf_dir), estate.dispatch(spark, sf_dir), orders, accounts, WE)


@query(""" n AS (SELECT warehouse_id, dispatch_date d, COUNT(*) n FROM disp, p WHERE NOT on_time AND dispatch_date <= we GROUP BY 1, 2),
 r AS (SELECT warehouse_id, AVG(n) m FROM n, p WHERE d >= we - 6 GROUP BY 1),
 b AS (SELECT warehouse_id, AVG(n) m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY warehouse_id ORDER BY d DESC) k FROM n, p WHERE d < we - 6) WHERE k <= 28 GROUP BY 1)
 SELECT b.warehouse_id, ROUND(r.m, 6) AS recent_mean, ROUND(b.m, 6) AS base_mean, COALESCE(r.m < 0.35 * b.m, FALSE) AS partial_load FROM b LEFT JOIN r USING (warehouse_id)""")
def late_row_collapse(spark, sf_dir):
    late = estate.dispatch(spark, sf_dir).where(~F.col("on_time")).withColumnRenamed("dispatch_date", "d")
    return _r(sift.late_row_collapse(late, WE, ("warehouse_id",)), 6)


# ---------------------------------------------------------------- drift

_SHARES = """ x AS (SELECT UNNEST(['region', 'segment', 'channel', 'category', 'tier']) AS dimension, UNNEST([region, segment, channel, category, tier]) AS value, units, order_date BETWEEN ws AND we AS cur
  FROM fact, p WHERE order_date BETWEEN ws - 121 AND we),
 g AS (SELECT dimension, value, COALESCE(SUM(units) FILTER (WHERE NOT cur), 0) e, COALESCE(SUM(units) FILTER (WHERE cur), 0) a FROM x GROUP BY 1, 2),
 s AS (SELECT dimension, value, e / SUM(e) OVER (PARTITION BY dimension) AS e, a / SUM(a) OVER (PARTITION BY dimension) AS a FROM g)"""


@query(_SHARES + """, c AS (SELECT dimension, GREATEST(e, 1e-6) e, GREATEST(a, 1e-6) a FROM s), n AS (SELECT dimension, e / SUM(e) OVER (PARTITION BY dimension) e, a / SUM(a) OVER (PARTITION BY dimension) a FROM c)
 SELECT dimension, ROUND(SUM((a - e) * LN(a / e)), 6) AS psi, CASE WHEN SUM((a - e) * LN(a / e)) < 0.1 THEN 'STABLE' WHEN SUM((a - e) * LN(a / e)) < 0.25 THEN 'SHIFTING' ELSE 'DRIFTED' END AS status FROM n GROUP BY 1""")
def psi_by_dimension(spark, sf_dir):
    return _r(drift.psi(drift.share_table(_view(spark, sf_dir), WS, WE)), 6)


@query(_SHARES + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY ROUND(ABS(a - e), 12) DESC, value) rank FROM s)
 SELECT dimension, value, ROUND(e, 6) AS expected, ROUND(a, 6) AS actual, ROUND(a - e, 6) AS shift, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def largest_share_shifts(spark, sf_dir):
    return _r(drift.largest_shifts(drift.share_table(_view(spark, sf_dir), WS, WE)), 6)


# ---------------------------------------------------------------- expected band and movement

_BAND = _DAILY_SQL + """, c AS (SELECT d, v, isodow(d) - 1 AS wd, CASE WHEN COUNT(v) OVER w >= 4 THEN MEDIAN(v) OVER w END AS c FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 r AS (SELECT wd, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(v / c) END m FROM c WHERE c <> 0 GROUP BY 1),
 i AS (SELECT k AS wd, COALESCE(m, 1) / AVG(COALESCE(m, 1)) OVER () AS idx FROM range(7) t(k) LEFT JOIN r ON r.wd = k),
 f AS (SELECT d, v, i.wd, idx, v / idx AS flat FROM c JOIN i USING (wd)),
 b AS (SELECT d, v, wd, idx, CASE WHEN COUNT(flat) OVER w >= 7 THEN MEDIAN(flat) OVER w END * idx AS e FROM f WINDOW w AS (ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))"""


@query(_BAND + " SELECT CAST(wd AS INTEGER) AS wd, ROUND(idx, 6) AS idx FROM i")
def weekday_index(spark, sf_dir):
    return _r(series.weekday_index(_daily(spark, sf_dir)).select("wd", "idx"), 6)


@query(_BAND + " SELECT d, ROUND(v, 4) AS v, ROUND(c, 6) AS centred FROM c")
def rolling_median_centered(spark, sf_dir):
    return _daily(spark, sf_dir).withColumn("centred", F.round(series.rolling_median("v", (), -3, 3, 4), 6))


@query(_BAND + " SELECT d, ROUND(v, 4) AS v, CAST(wd AS INTEGER) AS wd, ROUND(idx, 6) AS idx, ROUND(e, 6) AS e, ROUND(v - e, 6) AS resid FROM b")
def expected_band(spark, sf_dir):
    df = series.expected_band(_daily(spark, sf_dir)).select("d", "v", "wd", "idx", "e", "resid")
    return df.select("d", F.round("v", 4).alias("v"), "wd", F.round("idx", 6).alias("idx"), F.round("e", 6).alias("e"), F.round("resid", 6).alias("resid"))


_MOVE = _BAND.replace("FROM fact GROUP BY 1)", "FROM fact, p WHERE order_date <= we GROUP BY 1)") + """,
 q AS (SELECT MEDIAN(v - e) c FROM b, p WHERE d < ws), sg AS (SELECT 1.4826 * MEDIAN(ABS(v - e - q.c)) sigma FROM b, p, q WHERE d < ws AND e IS NOT NULL),
 h AS (SELECT COUNT(*) hd FROM b, p WHERE d < ws),
 w AS (SELECT SUM(v) act, SUM(e) ex, COUNT(*) n, COUNT(*) FILTER (WHERE ABS(v - e) > 2.0 * sigma) per, MIN(sigma) sigma FROM b, p, sg WHERE d BETWEEN ws AND we AND e IS NOT NULL)"""


@query(_MOVE + " SELECT ROUND(sigma, 4) AS sigma FROM sg")
def robust_sigma_mad(spark, sf_dir):
    return _r(sift.detect_many(_daily(spark, sf_dir), WS, WE, NET).select("sigma"))


@query(_MOVE + " SELECT ROUND(act, 4) AS actual, ROUND(ex, 4) AS expected, ROUND(act - ex, 4) AS delta, ROUND((act - ex) / (sigma * SQRT(n)), 6) AS z, n AS n_days, per AS persistence FROM w")
def window_z_persistence(spark, sf_dir):
    df = sift.detect_many(_daily(spark, sf_dir), WS, WE, NET).select("actual", "expected", "delta", "z", "n_days", "persistence")
    return df.select(*[F.round(c, 4).alias(c) for c in ("actual", "expected", "delta")], F.round("z", 6).alias("z"), "n_days", "persistence")


@query(_MOVE + """ SELECT ABS(act - ex) >= 2500000 AS gate_abs, TRUE AS gate_plan, per >= 3 AS gate_persistence, ABS((act - ex) / (sigma * SQRT(n))) >= 2 AS gate_z,
  ABS(act - ex) >= 2500000 AND per >= 3 AND ABS((act - ex) / (sigma * SQRT(n))) >= 2 AS material,
  CASE WHEN hd < 42 THEN 'INSUFFICIENT_HISTORY' WHEN ABS(act - ex) >= 2500000 AND per >= 3 AND ABS((act - ex) / (sigma * SQRT(n))) >= 2 THEN 'MATERIAL' ELSE 'NOT_MATERIAL' END AS verdict FROM w, h""")
def materiality_gates(spark, sf_dir):
    return sift.detect_many(_daily(spark, sf_dir), WS, WE, NET).select("gate_abs", "gate_plan", "gate_persistence", "gate_z", "material", "verdict")


# ---------------------------------------------------------------- decomposition

_TWO = " f2 AS (SELECT *, CASE WHEN order_date BETWEEN ws AND we THEN 1.0 ELSE 0.0 END::DOUBLE AS c, CASE WHEN order_date BETWEEN bs AND be THEN sc ELSE 0.0 END::DOUBLE AS b FROM fact, p WHERE order_date BETWEEN bs AND we)"
_CELLS = _TWO + """, x AS (SELECT UNNEST(['region', 'city', 'segment', 'channel', 'category', 'tier', 'warehouse_id', 'account_id']) AS dimension,
  UNNEST([region, city, segment, channel, category, tier, warehouse_id, CAST(account_id AS VARCHAR)]) AS value, net_revenue * c AS c, net_revenue * b AS b FROM f2),
 g AS (SELECT dimension, value, SUM(c) c, SUM(b) b FROM x GROUP BY 1, 2), tt AS (SELECT dimension, SUM(c) tc, SUM(b) tb FROM g GROUP BY 1),
 cells AS (SELECT dimension, value, c, b, (c - b) / (tc - tb) AS ep, c / tc - b / tb AS ss, ABS((c - b) / (tc - tb)) * (1 + 4 * ABS(c / tc - b / tb)) AS score, tc, tb FROM g JOIN tt USING (dimension) WHERE ABS(c - b) >= 1e-9)"""


def _cells(spark, sf_dir) -> DataFrame:
    return split.lattice(split.two_windows(_view(spark, sf_dir), WS, WE, BS, BE), SCALE)


@query(_TWO + """, t AS (SELECT tier, SUM(net_revenue * c) r1, SUM(net_revenue * b) r0, SUM(units * c) v1, SUM(units * b) v0 FROM f2 GROUP BY 1),
 a AS (SELECT SUM(r1) r1, SUM(r0) r0, SUM(v1) v1, SUM(v0) v0 FROM t),
 e AS (SELECT SUM((t.v1 / a.v1 - t.v0 / a.v0) * CASE WHEN t.v0 > 0 THEN t.r0 / t.v0 ELSE 0 END) m, SUM(t.v1 / a.v1 * (CASE WHEN t.v1 > 0 THEN t.r1 / t.v1 ELSE 0 END - CASE WHEN t.v0 > 0 THEN t.r0 / t.v0 ELSE 0 END)) k FROM t, a)
 SELECT ROUND(r1, 3) AS "current", ROUND(r0, 3) AS baseline, ROUND(r1 - r0, 3) AS total, ROUND((v1 - v0) * r0 / v0, 3) AS volume_effect, ROUND(v1 * m, 3) AS mix_effect, ROUND(v1 * k, 3) AS rate_effect, ABS(r1 - r0 - (v1 - v0) * r0 / v0 - v1 * m - v1 * k) < 1e-3 AS closes FROM a, e""")
def price_volume_mix(spark, sf_dir):
    df = split.price_volume_mix(split.two_windows(_view(spark, sf_dir), WS, WE, BS, BE), SCALE)
    return _r(df.withColumn("closes", F.abs("residual") < 1e-3).drop("residual"), 3)


@query(_CELLS + " SELECT dimension, value, ROUND(c, 4) AS cur, ROUND(b, 4) AS base, ROUND(ep, 6) AS explanatory_power, ROUND(ss, 6) AS share_shift, ROUND(score, 6) AS score FROM cells")
def lattice_contributors(spark, sf_dir):
    df = _cells(spark, sf_dir)
    return df.select("dimension", "value", F.round("cur", 4).alias("cur"), F.round("base", 4).alias("base"), *[F.round(c, 6).alias(c) for c in ("explanatory_power", "share_shift", "score")])


@query(_CELLS + " SELECT dimension, value, ROUND(score, 6) AS score FROM cells ORDER BY cells.score DESC, dimension, value LIMIT 8")
def top_contributors(spark, sf_dir):
    return split.top_contributors(_cells(spark, sf_dir)).select("dimension", "value", F.round("score", 6).alias("score"))


@query(_CELLS + ", r AS (SELECT dimension, value, score, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY score DESC, value) rank FROM cells) SELECT dimension, value, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def top3_per_dimension(spark, sf_dir):
    return split.top_per_dimension(_cells(spark, sf_dir)).select("dimension", "value", F.round("score", 6).alias("score"), "rank")


@query(_CELLS + """, k AS (SELECT dimension, GREATEST(c / SUM(c) OVER w, 1e-12) p, GREATEST(b / SUM(b) OVER w, 1e-12) q FROM cells WINDOW w AS (PARTITION BY dimension)),
 n AS (SELECT dimension, p / SUM(p) OVER w p, q / SUM(q) OVER w q FROM k WINDOW w AS (PARTITION BY dimension))
 SELECT dimension, ROUND(SUM(0.5 * (p * LN(p / ((p + q) / 2)) + q * LN(q / ((p + q) / 2)))), 6) AS js FROM n GROUP BY 1""")
def js_divergence_by_dim(spark, sf_dir):
    return _r(split.js_divergence(_cells(spark, sf_dir)), 6)


# ---------------------------------------------------------------- evidence

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in scalars.STOP_WORDS) + "]"
_BM25 = f""" w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP_SQL}, x)) AS ws FROM documents),
 l AS (SELECT doc_id, len(ws) AS dl, ws FROM w), st AS (SELECT COUNT(*)::DOUBLE AS n, AVG(dl) AS avgdl FROM l),
 q AS (SELECT UNNEST({QUERY_TERMS!r}) AS term), tf AS (SELECT doc_id, dl, term, COUNT(*) AS tf FROM (SELECT doc_id, dl, UNNEST(ws) AS term FROM l) GROUP BY 1, 2, 3),
 df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT tf.doc_id, SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1)"""


@query(_BM25 + " SELECT doc_id, ROUND(score, 6) AS score FROM sc WHERE score > 0")
def bm25_scores(spark, sf_dir):
    return _r(retrieval.bm25(_t(spark, sf_dir, "documents"), QUERY_TERMS), 6)


@query(_BM25 + """, b AS (SELECT doc_id, ROUND(score, 9) s FROM sc ORDER BY 2 DESC, 1 LIMIT 36)
 SELECT b.doc_id, ROUND(b.s, 6) AS score FROM b JOIN documents d USING (doc_id) WHERE d.lang = 'en' ORDER BY b.s DESC, b.doc_id LIMIT 12""")
def bm25_retrieval(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    scored = retrieval.bm25(docs, QUERY_TERMS).withColumn("score", F.round("score", 9))
    return _r(retrieval.top_evidence(scored, docs.where("lang = 'en'")), 6)


@query("SELECT event_type AS theme, COUNT(*) AS n FROM events GROUP BY 1")
def theme_mix(spark, sf_dir):
    return retrieval.theme_mix(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "theme"))


def _evidence(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "routine").when(F.col("doc_id") % 5 == 0, "price_objection").otherwise("service_failure").alias("theme"), F.col("lang").alias("author_role"), F.col("source").alias("type"), (F.col("doc_id") % 50).alias("account_id"))


@query(""" e AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'routine' WHEN doc_id % 5 = 0 THEN 'price_objection' ELSE 'service_failure' END AS theme, lang, source, doc_id % 50 AS a FROM documents),
 t AS (SELECT COUNT(*) FILTER (WHERE theme = 'service_failure') o, COUNT(DISTINCT CASE WHEN theme = 'service_failure' THEN lang || '/' || source END) pr, COUNT(DISTINCT CASE WHEN theme = 'service_failure' THEN a END) ac, COUNT(*) FILTER (WHERE theme = 'price_objection') c FROM e)
 SELECT o AS on_theme, pr AS pairs, ac AS accounts, c AS conflicting, ROUND(c / (o + c)::DOUBLE, 6) AS conflict_ratio, o >= 3 AND pr >= 2 AND ac >= 2 AND c / (o + c)::DOUBLE < 0.4 AS corroborated FROM t""")
def theme_conflict(spark, sf_dir):
    return _r(retrieval.corroboration(_evidence(spark, sf_dir), "service_failure"), 6)


@query("SELECT event_id, CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + 3 AS end_date FROM events, (SELECT MIN(CAST(ts AS DATE)) + 18 AS a, MIN(CAST(ts AS DATE)) + 20 AS b FROM events) w WHERE event_type = (SELECT MIN(event_type) FROM events) AND CAST(ts AS DATE) <= b AND CAST(ts AS DATE) + 3 >= a - 14")
def event_overlap(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("start_date"), F.date_add(F.to_date("ts"), 3).alias("end_date"))
    first = ev.agg(F.min("start_date").alias("d"), F.min("event_type").alias("t")).first()
    from datetime import timedelta

    return retrieval.overlapping_events(ev.where(F.col("event_type") == first["t"]).drop("event_type"), first["d"] + timedelta(days=18), first["d"] + timedelta(days=20))


# ---------------------------------------------------------------- causal tests

_TREAT = f"warehouse_id = '{WAREHOUSE}'"
_DID = f""" s AS (SELECT order_date d, order_date >= ws AS post, SUM(net_revenue) FILTER (WHERE {_TREAT}) t, SUM(net_revenue) FILTER (WHERE NOT {_TREAT}) c FROM fact, p WHERE order_date BETWEEN bs AND we GROUP BY 1, 2),
 r AS (SELECT d, post, LN(t) - LN(c) AS r FROM s WHERE t > 0 AND c > 0),
 k AS (SELECT r, ROW_NUMBER() OVER (ORDER BY d) k, COUNT(*) OVER () // 2 half FROM r WHERE NOT post),
 a AS (SELECT AVG(r) FILTER (WHERE post) m1, AVG(r) FILTER (WHERE NOT post) m0, VAR_SAMP(r) FILTER (WHERE post) s1, VAR_SAMP(r) FILTER (WHERE NOT post) s0, COUNT(*) FILTER (WHERE post) n1, COUNT(*) FILTER (WHERE NOT post) n0 FROM r),
 pl AS (SELECT AVG(r) FILTER (WHERE k > half) - AVG(r) FILTER (WHERE k <= half) pl FROM k)"""


@query(_DID + " SELECT n1, n0, ROUND(m1 - m0, 6) AS did, ROUND(SQRT(s1 / n1 + s0 / n0), 6) AS se, ROUND((m1 - m0) / SQRT(s1 / n1 + s0 / n0), 6) AS t_stat FROM a")
def did_log_ratio(spark, sf_dir):
    return _r(causal.difference_in_differences(_view(spark, sf_dir), F.col("warehouse_id") == WAREHOUSE, WS, WE).select("n1", "n0", "did", "se", "t_stat"), 6)


@query(_DID + " SELECT ROUND(pl, 6) AS placebo, ABS(pl) < GREATEST(0.04, 0.5 * ABS(m1 - m0)) AS parallel FROM a, pl")
def placebo_half_split(spark, sf_dir):
    return _r(causal.difference_in_differences(_view(spark, sf_dir), F.col("warehouse_id") == WAREHOUSE, WS, WE).select("placebo", "parallel"), 6)


@query()
def did_p_value(spark, sf_dir):
    return causal.with_p_value(causal.difference_in_differences(_view(spark, sf_dir), F.col("warehouse_id") == WAREHOUSE, WS, WE))


_LONG = " w2 AS (SELECT DATE '1999-01-01' ws, DATE '1999-12-31' we, DATE '1998-01-01' bs, DATE '1998-12-31' be)"
_EXPO = _LONG + """, span AS (SELECT fact.* FROM fact, w2 WHERE order_date BETWEEN w2.bs AND w2.we),
 late AS (SELECT account_id, COUNT(*) late FROM span s JOIN disp d ON s.order_id = d.order_id AND s.line_no = d.line_no WHERE NOT on_time GROUP BY 1),
 ch AS (SELECT account_id, AVG(CASE WHEN order_date BETWEEN w2.ws AND w2.we THEN net_revenue END) post, AVG(CASE WHEN order_date BETWEEN w2.bs AND w2.be THEN net_revenue END) pre FROM span, w2 GROUP BY 1),
 ex AS (SELECT account_id, COALESCE(late, 0) late, post / pre - 1 AS change FROM ch LEFT JOIN late USING (account_id) WHERE pre > 0 AND post IS NOT NULL)"""


def _exposure(spark, sf_dir) -> DataFrame:
    return causal.exposure_table(_view(spark, sf_dir), estate.dispatch(spark, sf_dir), date(1999, 1, 1), date(1999, 12, 31), days=364)


@query(_EXPO + " SELECT CASE WHEN late <= 0.5 THEN 0 WHEN late <= 2.5 THEN 1 WHEN late <= 5.5 THEN 2 ELSE 3 END AS bucket, ROUND(AVG(change), 6) AS mean_change, COUNT(*) AS n FROM ex GROUP BY 1 HAVING COUNT(*) >= 3")
def dose_response_buckets(spark, sf_dir):
    return _r(causal.dose_buckets(_exposure(spark, sf_dir)), 6)


@query(_EXPO + """, r AS (SELECT RANK() OVER (ORDER BY late) + (COUNT(*) OVER (PARTITION BY late) - 1) / 2.0 rx, RANK() OVER (ORDER BY change) + (COUNT(*) OVER (PARTITION BY change) - 1) / 2.0 ry FROM ex)
 SELECT ROUND(CORR(rx, ry), 6) AS rho, COUNT(*) AS n FROM r""")
def spearman_rho(spark, sf_dir):
    return _r(causal.spearman(_exposure(spark, sf_dir), "late", "change"), 6)


@query(_DAILY_SQL + """, m AS (SELECT d, CASE WHEN COUNT(v) OVER w >= 4 THEN AVG(v) OVER w END m FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
 k AS (SELECT d, m, ROW_NUMBER() OVER (ORDER BY d) k FROM m, p WHERE m IS NOT NULL AND d >= ws - 45), ref AS (SELECT MEDIAN(m) ref FROM k WHERE k <= 21),
 h AS (SELECT d, CASE WHEN m > 1.02 * ref THEN 1 ELSE 0 END hit FROM k, ref), r AS (SELECT d, SUM(hit) OVER w s, COUNT(*) OVER w c FROM h WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT CAST(MIN(CASE WHEN s = 3 AND c = 3 THEN d END) - 2 AS DATE) AS onset, COUNT(*) AS "rows" FROM r""")
def sustained_break_onset(spark, sf_dir):
    return causal.sustained_break(_daily(spark, sf_dir), WS)


@query(_BAND + """, n AS (SELECT d, v - e AS resid, ROW_NUMBER() OVER (ORDER BY d) rn FROM b, p WHERE d BETWEEN ws - 28 AND we AND e IS NOT NULL),
 x AS (SELECT d, rn, CASE WHEN rn - LAG(rn) OVER (ORDER BY rn) <= 2 THEN 0 ELSE 1 END nw FROM n WHERE resid < -100000), g AS (SELECT d, SUM(nw) OVER (ORDER BY rn) g FROM x)
 SELECT MIN(d) AS onset, MAX(d) AS "last", COUNT(*) AS days FROM g GROUP BY g ORDER BY g DESC LIMIT 1""")
def effect_onset_islands(spark, sf_dir):
    return causal.effect_onset(series.expected_band(_daily(spark, sf_dir)), WS, WE, 100_000.0)


_EDGES_SQL = "VALUES " + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in CONTRACT.edges)


@query()
def causal_paths(spark, sf_dir):
    return graph.all_paths(spark, CONTRACT.edges, "net_revenue")


ORACLE_SQL["causal_paths"] = f"""WITH RECURSIVE e(src, dst, lag) AS ({_EDGES_SQL}), w AS (
 SELECT src AS start, dst AS node, src || '>' || dst AS path, lag, 2 AS n FROM e UNION ALL
 SELECT w.start, e.dst, w.path || '>' || e.dst, w.lag + e.lag, w.n + 1 FROM w JOIN e ON w.node = e.src WHERE w.n < 6 AND NOT contains(w.path, e.dst))
 SELECT start, path, CAST(lag AS INTEGER) AS lag, CAST(n AS INTEGER) AS n FROM w WHERE node = 'net_revenue'"""


@query(f""" h AS (SELECT {_TREAT} AS x, SUM(CASE WHEN order_date BETWEEN ws AND we THEN units ELSE 0 END) u1, SUM(CASE WHEN order_date BETWEEN bs AND be THEN units * sc ELSE 0 END) u0,
  SUM(CASE WHEN order_date BETWEEN ws AND we THEN net_revenue ELSE 0 END) r1, SUM(CASE WHEN order_date BETWEEN bs AND be THEN net_revenue * sc ELSE 0 END) r0 FROM fact, p WHERE order_date BETWEEN bs AND we GROUP BY 1),
 j AS (SELECT t.u1 / t.u0 - 1 tu, c.u1 / c.u0 - 1 cu, t.r1 / t.r0 - 1 tr, c.r1 / c.r0 - 1 cr, t.u1 - t.u0 - t.u0 * (c.u1 / c.u0 - 1) au, t.r1 - t.r0 - t.r0 * (c.r1 / c.r0 - 1) ar FROM h t, h c WHERE t.x AND NOT c.x)
 SELECT 3 AS pos, 'order_volume' AS node, ROUND(tu - cu, 6) AS did_pct, ROUND(au, 4) AS attributable, NULL::DOUBLE AS transmission FROM j
 UNION ALL SELECT 4, 'net_revenue', ROUND(tr - cr, 6), ROUND(ar, 4), ROUND((tr - cr) / (tu - cu), 6) FROM j""")
def mechanism_ledger(spark, sf_dir):
    path = ("delivery_delay", "customer_trust", "reorder_behaviour", "order_volume", "net_revenue")
    df = propagation.mechanism_ledger(_view(spark, sf_dir), path, {(a, b): n for a, b, n in CONTRACT.edges}, F.col("warehouse_id") == WAREHOUSE, WS, WE)
    return df.select("pos", "node", F.round("did_pct", 6).alias("did_pct"), F.round("attributable", 4).alias("attributable"), F.round("transmission", 6).alias("transmission"))


# ---------------------------------------------------------------- forecast

_FIT = _DAILY_SQL + """, l AS (SELECT d, v FROM s, p WHERE d <= we ORDER BY d DESC LIMIT 28), k AS (SELECT d, v, ROW_NUMBER() OVER (ORDER BY d) - 1 k, AVG(v) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) wk FROM l),
 sl AS (SELECT MEDIAN((b.wk - a.wk) / (b.k - a.k)) slope FROM k a JOIN k b ON a.k < b.k), lv AS (SELECT MEDIAN(wk) lv FROM k WHERE k >= 21),
 md AS (SELECT MEDIAN(v - wk) m FROM k), sg AS (SELECT 1.4826 * MEDIAN(ABS(v - wk - m)) sg FROM k, md)"""


def _until(spark, sf_dir) -> DataFrame:
    return series.until(_daily(spark, sf_dir), WE)


@query(_FIT + " SELECT ROUND(slope, 4) AS slope FROM sl")
def theil_sen(spark, sf_dir):
    return _r(forecast.theil_sen(forecast.smoothed(_until(spark, sf_dir))))


@query(_FIT + """ SELECT CAST(h AS INTEGER) AS h, ROUND(lv + slope * h, 4) AS centre, ROUND(lv + slope * h - 1.96 * sg * SQRT(h / 7.0), 4) AS lo, ROUND(lv + slope * h + 1.96 * sg * SQRT(h / 7.0), 4) AS hi FROM range(1, 29) t(h), sl, lv, sg""")
def forecast_path(spark, sf_dir):
    return _r(forecast.project(_until(spark, sf_dir)).select("h", "centre", "lo", "hi"))


@query(_FIT + " SELECT CAST(h AS INTEGER) AS h, ROUND(LEAST(1.0, h / 10.0)::DOUBLE, 4) AS ramp, ROUND(lv + slope * h + 50000.0 * LEAST(1.0, h / 10.0), 4) AS with_action FROM range(1, 29) t(h), sl, lv")
def intervention_overlay(spark, sf_dir):
    return _r(forecast.with_intervention(forecast.project(_until(spark, sf_dir)), 50_000.0, 10).select("h", "ramp", "with_action"))


# ---------------------------------------------------------------- actions


def _hypotheses(spark, sf_dir) -> DataFrame:
    """A hypothesis for each label, of one of three mechanisms by its number."""
    rows = [("H1", "net_revenue", "service_failure", ["warehouse_sla", "delivery_delay", "customer_trust", "reorder_behaviour", "order_volume", "net_revenue"], "L3", 0.6), ("H2", "asp", "mix_shift", ["tier_mix", "price_level", "net_revenue"], "L2", 0.2), ("H3", "order_volume", "external_market", ["competitor_promo", "order_volume"], "L1", 0.1)]
    kinds = spark.createDataFrame([(k, *r[1:5]) for k, r in enumerate(rows)], "k long, metric string, driver_type string, path array<string>, ladder string")
    own = _t(spark, sf_dir, "labels").select(F.concat(F.lit("H"), F.col("doc_id")).alias("id"), (F.col("doc_id") % 3).alias("k"), (F.col("doc_id") % 50 / 50.0).alias("ep"))
    return own.join(F.broadcast(kinds), "k").drop("k")


def _playbooks(spark) -> DataFrame:
    return spark.createDataFrame([(p.id, p.metric, p.driver_type, list(p.path), list(p.levers), p.recovered_pct) for p in CONTRACT.playbooks], "pb string, p_metric string, p_driver string, p_path array<string>, levers array<string>, recovered double")


_HYP_SQL = """ h AS (SELECT 'H' || doc_id AS id, m, dt, path, lad, (doc_id % 50 / 50)::DOUBLE AS ep FROM labels JOIN (VALUES (0, 'net_revenue', 'service_failure', ['warehouse_sla', 'delivery_delay', 'customer_trust', 'reorder_behaviour', 'order_volume', 'net_revenue'], 'L3'), (1, 'asp', 'mix_shift', ['tier_mix', 'price_level', 'net_revenue'], 'L2'), (2, 'order_volume', 'external_market', ['competitor_promo', 'order_volume'], 'L1')) t(k, m, dt, path, lad) ON k = doc_id % 3),
 pb AS (SELECT * FROM (VALUES ('PB-SLA', 'net_revenue', 'service_failure', ['warehouse_sla', 'delivery_delay', 'customer_trust', 'reorder_behaviour'], ['service_credit', 'named_rep_outreach', 'warehouse_capacity'], 0.71::DOUBLE), ('PB-TIER', 'asp', 'mix_shift', ['tier_mix', 'price_level'], ['price_correction'], 0.60), ('PB-PROMO', 'order_volume', 'external_market', ['competitor_promo', 'order_volume'], ['promo_response'], 0.45)) t(pb, pm, pdt, pp, lv, rec)),
 sim AS (SELECT id, pb, lad, ep, lv, rec, ROUND((0.35 * CASE WHEN m = pm THEN 1 ELSE 0 END + 0.4 * CASE WHEN dt = pdt THEN 1 ELSE 0 END + 0.25 * len(list_intersect(path, pp)) / len(list_distinct(list_concat(path, pp))))::DOUBLE, 4) AS similarity FROM h, pb)"""


@query(_HYP_SQL + " SELECT id, pb, similarity FROM sim")
def playbook_similarity(spark, sf_dir):
    # every hypothesis against every playbook, of which the contract has a few
    j = _hypotheses(spark, sf_dir).withColumn("_k", F.lit(1)).join(_playbooks(spark).withColumn("_k", F.lit(1)), "_k")
    return j.select("id", "pb", actions.similarity_columns(F.col("metric"), F.col("driver_type"), F.col("path"), F.col("p_metric"), F.col("p_driver"), F.col("p_path")).alias("similarity"))


@query(_HYP_SQL + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, pb) k FROM sim WHERE similarity >= 0.45)
 SELECT id, pb, UNNEST(lv) AS lever, ROUND(ep * 1e6 * rec / len(lv), 4) AS expected_impact FROM r WHERE k = 1""")
def recommendations(spark, sf_dir):
    j = _hypotheses(spark, sf_dir).withColumn("_k", F.lit(1)).join(_playbooks(spark).withColumn("_k", F.lit(1)), "_k")
    j = j.withColumn("s", actions.similarity_columns(F.col("metric"), F.col("driver_type"), F.col("path"), F.col("p_metric"), F.col("p_driver"), F.col("p_path"))).where(F.col("s") >= actions.FLOOR)
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "pb"))).where("r = 1")
    return _r(best.select("id", "pb", F.explode("levers").alias("lever"), (F.col("ep") * 1e6 * F.col("recovered") / F.size("levers")).alias("expected_impact")))


@query(""" lv AS (SELECT * FROM (VALUES ('service_credit', 2500000.0, 'reversible'), ('named_rep_outreach', 500000.0, 'reversible'), ('warehouse_capacity', 6000000.0, 'costly_to_reverse'), ('price_correction', 0.0, 'hard_to_reverse'), ('promo_response', 5000000.0, 'costly_to_reverse'), ('monitor_only', 0.0, 'reversible')) t(lever, lim, rev)),
 c AS (SELECT o_orderkey, lever, lim, rev, 'L' || (o_orderkey % 3 + 1) AS lad, ROUND(o_totalprice * 10, 2) AS imp FROM lv, orders)
 SELECT o_orderkey, lever, lad AS ladder, imp AS impact, CASE WHEN lever = 'monitor_only' THEN 'HUMAN_ONLY' WHEN lad = 'L3' AND ((lim > 0 AND imp > lim) OR rev = 'hard_to_reverse') THEN 'HUMAN_LED' WHEN lad = 'L3' THEN 'AI_LED' WHEN lad = 'L2' THEN 'HUMAN_LED' ELSE 'HUMAN_ONLY' END AS mode FROM c""")
def decision_routing(spark, sf_dir):
    """Who decides on each order's tenfold amount, for every lever of the contract."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("L"), F.col("o_orderkey") % 3 + 1).alias("ladder"), F.round(F.col("o_totalprice") * 10, 2).alias("impact"))
    cases = orders.crossJoin(F.broadcast(actions.lever_frame(CONTRACT, spark)))
    return cases.select("o_orderkey", "lever", "ladder", "impact", actions.route_column(F.col("ladder"), F.col("impact"), F.col("authority_limit"), F.col("reversibility"), F.col("lever") == "monitor_only").alias("mode"))


@query()
def numeric_guard(spark, sf_dir):
    from gaugeworks.operators.narrative import guard_many

    rows = spark.createDataFrame([(1, "a gap of 4.2 and 9.7 points", '{"delta": -1.85}'), (2, "down 1.85 on 16.1", '{"delta": -1.85, "pct": -16.1}')], "id int, text string, packet string")
    return guard_many(rows).select("id", "rejected")


# ---------------------------------------------------------------- sweep, backtest

_METRIC_SLICES = """ base AS (SELECT 'region=' || region AS slice, order_date d, net_revenue v FROM fact UNION ALL SELECT 'segment=' || segment, order_date, net_revenue FROM fact UNION ALL SELECT 'channel=' || channel, order_date, net_revenue FROM fact UNION ALL SELECT 'category=' || category, order_date, net_revenue FROM fact),
 s AS (SELECT slice, d, SUM(v) v FROM base, p WHERE d <= we GROUP BY 1, 2),
 c AS (SELECT slice, d, v, isodow(d) - 1 AS wd, CASE WHEN COUNT(v) OVER w >= 4 THEN MEDIAN(v) OVER w END AS c FROM s WINDOW w AS (PARTITION BY slice ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 r AS (SELECT slice, wd, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(v / c) END m FROM c WHERE c <> 0 GROUP BY 1, 2),
 sp AS (SELECT DISTINCT slice, k AS wd FROM s, range(7) t(k)),
 i AS (SELECT sp.slice, sp.wd, COALESCE(m, 1) / AVG(COALESCE(m, 1)) OVER (PARTITION BY sp.slice) AS idx FROM sp LEFT JOIN r ON r.wd = sp.wd AND r.slice = sp.slice),
 f AS (SELECT c.slice, d, v, idx, v / idx AS flat FROM c JOIN i ON c.slice = i.slice AND c.wd = i.wd),
 b AS (SELECT slice, d, v, CASE WHEN COUNT(flat) OVER w >= 7 THEN MEDIAN(flat) OVER w END * idx AS e FROM f WINDOW w AS (PARTITION BY slice ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
 q AS (SELECT slice, MEDIAN(v - e) c, COUNT(*) hd FROM b, p WHERE d < ws GROUP BY 1), sg AS (SELECT b.slice, 1.4826 * MEDIAN(ABS(v - e - q.c)) sigma, MIN(hd) hd FROM b JOIN q ON b.slice = q.slice, p WHERE d < ws AND e IS NOT NULL GROUP BY 1),
 m AS (SELECT b.slice, SUM(v) act, SUM(e) ex, COUNT(*) n, COUNT(*) FILTER (WHERE ABS(v - e) > 2.0 * sigma) per, MIN(sigma) sigma, MIN(hd) hd FROM b JOIN sg ON b.slice = sg.slice, p WHERE d BETWEEN ws AND we AND e IS NOT NULL GROUP BY 1),
 z AS (SELECT sg.slice, act, ex, (act - ex) / (m.sigma * SQRT(n)) z, per, ABS(act - ex) >= 2500000 g1, per >= 3 g3, ABS((act - ex) / (m.sigma * SQRT(n))) >= 2 g4 FROM sg LEFT JOIN m ON m.slice = sg.slice)"""


@query(_METRIC_SLICES + " SELECT slice, ROUND(act, 4) AS actual, ROUND(ex, 3) AS expected, ROUND(z, 5) AS z, per AS persistence, CASE WHEN act IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN g1 AND g3 AND g4 THEN 'MATERIAL' ELSE 'NOT_MATERIAL' END AS verdict FROM z")
def estate_sweep(spark, sf_dir):
    df = triage.sweep(_view(spark, sf_dir), CONTRACT, ["net_revenue"], WS, WE)
    return df.select("slice", F.round("actual", 4).alias("actual"), F.round("expected", 3).alias("expected"), F.round("z", 5).alias("z"), "persistence", "verdict")


@query(_METRIC_SLICES + """, g AS (SELECT 'rupee floor' AS reason FROM z WHERE NOT g1 UNION ALL SELECT 'persistence' FROM z WHERE NOT g3 AND NOT (g1 AND g3 AND g4) UNION ALL SELECT 'sigma' FROM z WHERE NOT g4)
 SELECT reason, COUNT(*) AS n FROM g GROUP BY 1""")
def suppression_reasons(spark, sf_dir):
    return triage.suppression(triage.sweep(_view(spark, sf_dir), CONTRACT, ["net_revenue"], WS, WE))


@query()
def sweep_all_metrics(spark, sf_dir):
    return triage.sweep(_view(spark, sf_dir), CONTRACT, ["net_revenue", "order_volume", "asp"], WS, WE)


def _backtest(spark, sf_dir) -> DataFrame:
    s = series.measure_series(_view(spark, sf_dir).where(F.col("region") == REGION), "net_revenue").where(F.col("d").between(F.lit(date(1999, 6, 1)), F.lit(date(2000, 3, 31))))
    return triage.backtest(s, NET, date(2000, 1, 1), date(2000, 3, 31))


@query(f""" s AS (SELECT order_date d, SUM(net_revenue) v FROM fact WHERE region = '{REGION}' AND order_date BETWEEN DATE '1999-06-01' AND DATE '2000-03-31' GROUP BY 1),
 sp AS (SELECT CAST(DATE '2000-01-01' + CAST(k * 7 AS INTEGER) AS DATE) a FROM range(12) t(k) WHERE DATE '2000-01-01' + CAST(k * 7 + 13 AS INTEGER) <= DATE '2000-03-31'),
 c AS (SELECT a, d, v, isodow(d) - 1 wd, CASE WHEN COUNT(v) OVER w >= 4 THEN MEDIAN(v) OVER w END c FROM s JOIN sp ON d <= a + 13 WINDOW w AS (PARTITION BY a ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 r AS (SELECT a, wd, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(v / c) END m FROM c WHERE c <> 0 GROUP BY 1, 2),
 i AS (SELECT sp.a, k AS wd, COALESCE(m, 1) / AVG(COALESCE(m, 1)) OVER (PARTITION BY sp.a) idx FROM sp CROSS JOIN range(7) t(k) LEFT JOIN r ON r.a = sp.a AND r.wd = k),
 f AS (SELECT c.a, d, v, idx, v / idx flat FROM c JOIN i ON c.a = i.a AND c.wd = i.wd),
 b AS (SELECT a, d, v, CASE WHEN COUNT(flat) OVER w >= 7 THEN MEDIAN(flat) OVER w END * idx e FROM f WINDOW w AS (PARTITION BY a ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
 q AS (SELECT a, MEDIAN(v - e) c FROM b WHERE d < a GROUP BY 1), sg AS (SELECT b.a, 1.4826 * MEDIAN(ABS(v - e - q.c)) sigma FROM b JOIN q ON b.a = q.a WHERE d < b.a AND e IS NOT NULL GROUP BY 1),
 m AS (SELECT b.a, SUM(v) act, SUM(e) ex, COUNT(*) n, COUNT(*) FILTER (WHERE ABS(v - e) > 2.0 * sigma) per, MIN(sigma) sigma FROM b JOIN sg ON b.a = sg.a WHERE d BETWEEN b.a AND b.a + 13 AND e IS NOT NULL GROUP BY 1)
 SELECT a AS ws, ROUND(act, 4) AS actual, ROUND(ex, 3) AS expected, ROUND((act - ex) / (sigma * SQRT(n)), 5) AS z, per AS persistence, ABS(act - ex) >= 2500000 AND ABS((act - ex) / (sigma * SQRT(n))) >= 2 AND per >= 3 AS alert FROM m""")
def backtest_windows(spark, sf_dir):
    return _backtest(spark, sf_dir).select("ws", F.round("actual", 4).alias("actual"), F.round("expected", 3).alias("expected"), F.round("z", 5).alias("z"), "persistence", "alert")


_LABELLED = " x AS (SELECT doc_id, quality AS label, n_chars, lang, source, LEAST(0.999, GREATEST(0.001, n_chars / 5000.0))::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), "n_chars", "lang", "source", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("n_chars") / 5000.0)).alias("score"))


@query(""" w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS ws, COUNT(*) % 3 = 0 AS alert FROM orders GROUP BY 1),
 e AS (SELECT CAST(ts AS DATE) - 8766 AS a, CAST(ts AS DATE) - 8766 + CAST(FLOOR(value / 20) AS INTEGER) AS b FROM events WHERE event_type = 'error'),
 j AS (SELECT ws, alert, EXISTS (SELECT 1 FROM e WHERE NOT (ws + 13 < a OR ws > b)) known FROM w), c AS (SELECT COUNT(*) AS windows, COUNT(*) FILTER (WHERE alert) alerts, COUNT(*) FILTER (WHERE alert AND known) tp, COUNT(*) FILTER (WHERE alert AND NOT known) fp, COUNT(*) FILTER (WHERE NOT alert AND known) fn FROM j)
 SELECT windows, alerts, tp, fp, fn, ROUND(alerts / windows::DOUBLE, 6) AS alert_rate, ROUND(tp / NULLIF(tp + fp, 0)::DOUBLE, 6) AS precision, ROUND(tp / NULLIF(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""")
def confusion_metrics(spark, sf_dir):
    """Weeks of orders, of which some raise an alert, against the errors of the events table, moved to their years."""
    windows = _t(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("ws")).agg((F.count(F.lit(1)) % 3 == 0).alias("alert"))
    day = F.date_sub(F.to_date("ts"), 8766)
    events = _t(spark, sf_dir, "events").where("event_type = 'error'").select(day.alias("start_date"), F.date_add(day, F.floor(F.col("value") / 20).cast("int")).alias("end_date"))
    return _r(triage.confusion(windows, events), 6)


# ---------------------------------------------------------------- feedback

_LOG_SQL = " lg AS (SELECT doc_id AS seq, 'm' || CAST(doc_id % 3 AS VARCHAR) AS metric, 'H' || CAST(doc_id % 4 AS VARCHAR) AS h, CASE WHEN quality = 1 AND toxic = 0 THEN 'accept' WHEN quality = 0 THEN 'reject' ELSE 'partial' END AS grade, CASE WHEN toxic = 1 THEN 'note' END AS correction, 'a' || CAST(doc_id % 5 AS VARCHAR) AS analyst FROM labels)"


def _log(spark, sf_dir) -> DataFrame:
    x = _t(spark, sf_dir, "labels")
    name = lambda p, n: F.concat(F.lit(p), (F.col("doc_id") % n).cast("string"))
    return x.select(F.col("doc_id").alias("seq"), name("m", 3).alias("metric"), name("H", 4).alias("hypothesis_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("quality") == 0, "reject").otherwise("partial").alias("grade"), F.when(F.col("toxic") == 1, "note").alias("correction"), name("a", 5).alias("analyst"))


@query(_LOG_SQL + """, g AS (SELECT metric, h, list(grade ORDER BY seq) AS gs, COUNT(*) AS n FROM lg GROUP BY 1, 2)
 SELECT metric, h AS hypothesis_id, ROUND(list_reduce(list_prepend(1.0::DOUBLE, list_transform(gs, lambda x: CASE WHEN x = 'accept' THEN 2.0 WHEN x = 'reject' THEN -2.0 ELSE 0.0 END::DOUBLE)), lambda a, x: CASE WHEN x > 1 THEN LEAST(1.6, a * 1.12) WHEN x < -1 THEN GREATEST(0.35, a * 0.75) ELSE a END), 6) AS prior, n FROM g""")
def feedback_priors(spark, sf_dir):
    return _r(feedback.priors(_log(spark, sf_dir)), 6)


@query(_LOG_SQL + " SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE grade = 'accept') AS accepted, COUNT(*) FILTER (WHERE grade = 'reject') AS rejected, COUNT(*) FILTER (WHERE grade = 'partial') AS partial, ROUND(COUNT(*) FILTER (WHERE grade = 'accept') / COUNT(*) FILTER (WHERE grade IN ('accept', 'reject'))::DOUBLE, 6) AS diagnosis_precision FROM lg")
def feedback_stats(spark, sf_dir):
    return _r(feedback.stats(_log(spark, sf_dir)), 6)


@query(_LOG_SQL + " SELECT seq, metric, h AS hypothesis_id, correction FROM lg WHERE correction <> '' ORDER BY seq DESC LIMIT 20")
def corrections(spark, sf_dir):
    return feedback.corrections(_log(spark, sf_dir)).select("seq", "metric", "hypothesis_id", "correction")


@query(_LOG_SQL + " SELECT metric, COUNT(*) AS n, COUNT(*) FILTER (WHERE correction <> '') AS with_note, COUNT(DISTINCT analyst) AS analysts FROM lg GROUP BY 1")
def correction_stats(spark, sf_dir):
    return feedback.correction_counts(_log(spark, sf_dir))


@query(""" seed AS (SELECT * FROM (VALUES ('PB-SLA', 0.71::DOUBLE, 1), ('PB-TIER', 0.60, 1), ('PB-PROMO', 0.45, 1)) t(k, v, n)), o AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'PB-SLA' WHEN 1 THEN 'PB-TIER' ELSE 'PB-PROMO' END k, (doc_id % 100) / 100.0::DOUBLE v, 1 n FROM labels),
 u AS (SELECT * FROM seed UNION ALL SELECT * FROM o) SELECT k AS playbook_id, ROUND(SUM(n * v) / SUM(n), 6) AS effect, CAST(SUM(n) AS BIGINT) AS n, CASE WHEN SUM(n) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM u GROUP BY 1""")
def outcome_learning(spark, sf_dir):
    seed = spark.createDataFrame([(p.id, p.recovered_pct, 1) for p in CONTRACT.playbooks], "playbook_id string, effect double, n int")
    k = F.col("doc_id") % 3
    outcomes = _t(spark, sf_dir, "labels").select(F.when(k == 0, "PB-SLA").when(k == 1, "PB-TIER").otherwise("PB-PROMO").alias("playbook_id"), ((F.col("doc_id") % 100) / 100.0).alias("recovered"))
    return _r(feedback.outcome_means(seed, outcomes), 6)


# ---------------------------------------------------------------- learning to rank, metrics

_EP = _LABELLED + ", e AS (SELECT 'E' || CAST(doc_id // 25 AS VARCHAR) AS episode_id, doc_id AS candidate_id, label, score, DATE '2000-01-01' + CAST(doc_id // 25 AS INTEGER) AS window_start, 'T' || CAST(doc_id % 5 AS VARCHAR) AS driver_type FROM x)"


def _episodes(spark, sf_dir) -> DataFrame:
    x = _labelled(spark, sf_dir)
    k = F.floor(F.col("doc_id") / 25).cast("int")
    return x.select(F.concat(F.lit("E"), k.cast("string")).alias("episode_id"), F.col("doc_id").alias("candidate_id"), "label", "score", F.date_add(F.lit(date(2000, 1, 1)), k).alias("window_start"), F.concat(F.lit("T"), (F.col("doc_id") % 5).cast("string")).alias("driver_type"))


@query(_LABELLED + ", r AS (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 r FROM x), a AS (SELECT SUM(label)::DOUBLE p, COUNT(*)::DOUBLE n, SUM(r * label) s FROM r) SELECT ROUND((s - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM a")
def auc(spark, sf_dir):
    return _r(metrics.auc(_labelled(spark, sf_dir)), 6)


@query(_EP + """, r AS (SELECT episode_id, label, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY score DESC, candidate_id) k, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY label DESC, candidate_id) i FROM e),
 g AS (SELECT episode_id, SUM(CASE WHEN k <= 3 THEN label / LOG2(k + 1) ELSE 0 END) d, SUM(CASE WHEN i <= 3 THEN label / LOG2(i + 1) ELSE 0 END) b FROM r GROUP BY 1) SELECT ROUND(AVG(d / b), 6) AS ndcg, COUNT(*) AS episodes FROM g WHERE b > 0""")
def ndcg_at_3(spark, sf_dir):
    return _r(metrics.ndcg(_episodes(spark, sf_dir)), 6)


@query(_EP + """, r AS (SELECT episode_id, label, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY score DESC, candidate_id) k FROM e), f AS (SELECT MIN(k) k FROM r WHERE label > 0 GROUP BY episode_id)
 SELECT ROUND(AVG(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS top1, ROUND(AVG(CASE WHEN k <= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_k, ROUND(AVG(1.0::DOUBLE / k), 6) AS mrr, COUNT(*) AS episodes FROM f""")
def rank_metrics(spark, sf_dir):
    return _r(metrics.rank_metrics(_episodes(spark, sf_dir)), 6)


@query(_LABELLED + " SELECT ROUND(AVG(POW(score - label, 2)), 6) AS brier FROM x")
def brier(spark, sf_dir):
    return _r(metrics.brier(_labelled(spark, sf_dir), p="score"), 6)


@query(_LABELLED + " SELECT CAST(LEAST(FLOOR(score * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_p, ROUND(AVG(label), 6) AS mean_y FROM x GROUP BY 1")
def ece_bins(spark, sf_dir):
    return _r(metrics.reliability(_labelled(spark, sf_dir), p="score"), 6)


@query(_LABELLED + ", b AS (SELECT COUNT(*) n, AVG(score) p, AVG(label) y FROM x GROUP BY LEAST(FLOOR(score * 10), 9)) SELECT ROUND(SUM(n * ABS(p - y)) / SUM(n), 6) AS ece FROM b")
def expected_calibration_error(spark, sf_dir):
    return _r(metrics.expected_calibration_error(metrics.reliability(_labelled(spark, sf_dir), p="score")), 6)


@query(_EP + """, m AS (SELECT MAX(score) score, CASE WHEN SUM(label) > COUNT(*) * 0.8 THEN 1 ELSE 0 END label FROM e GROUP BY episode_id), r AS (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 r FROM m), a AS (SELECT SUM(label)::DOUBLE p, COUNT(*)::DOUBLE n, SUM(r * label) s FROM r)
 SELECT ROUND((s - p * (p + 1) / 2) / NULLIF(p * (n - p), 0), 6) AS abstention_auc FROM a""")
def abstention_quality(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    clear = e.groupBy("episode_id").agg((F.sum("label") > F.count(F.lit(1)) * 0.8).cast("int").alias("label"))
    return _r(metrics.abstention_quality(e.drop("label").join(clear, "episode_id"), "score"), 6)


@query(_EP + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY score DESC, candidate_id) k FROM e), f AS (SELECT episode_id, ARG_MIN(driver_type, k) t, MIN(k) k FROM r WHERE label > 0 GROUP BY 1)
 SELECT t AS true_type, ROUND(AVG(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS top1, COUNT(*) AS episodes FROM f GROUP BY 1""")
def top1_by_driver_type(spark, sf_dir):
    return _r(metrics.by_driver_type(_episodes(spark, sf_dir)), 6)


@query(_EP + """, t AS (SELECT DISTINCT episode_id, 'T' || CAST(CAST(SUBSTR(episode_id, 2) AS INTEGER) % 5 AS VARCHAR) AS driver_type FROM e), c AS (SELECT DISTINCT episode_id, driver_type FROM e WHERE score > 0.3)
 SELECT t.driver_type, ROUND(AVG(CASE WHEN c.episode_id IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS recall, COUNT(*) AS episodes FROM t LEFT JOIN c USING (episode_id, driver_type) GROUP BY 1""")
def candidate_recall(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    truth = e.select("episode_id").distinct().withColumn("driver_type", F.concat(F.lit("T"), (F.substring("episode_id", 2, 9).cast("int") % 5).cast("string")))
    return _r(metrics.candidate_recall(e.where("score > 0.3"), truth), 6)


@query(_EP + """, o AS (SELECT episode_id, ROW_NUMBER() OVER (ORDER BY MIN(window_start), episode_id) k, COUNT(*) OVER () n FROM e GROUP BY 1)
 SELECT episode_id, CASE WHEN k <= FLOOR(n * 0.65) THEN 'train' WHEN k <= FLOOR(n * 0.8) THEN 'calib' ELSE 'test' END AS part FROM o""")
def time_split(spark, sf_dir):
    return metrics.time_split(_episodes(spark, sf_dir)).select("episode_id", "part").distinct()


@query(_EP + """, u AS (SELECT episode_id, candidate_id, (candidate_id % 17 + 1) / 17.0::DOUBLE h, CASE WHEN candidate_id % 11 <> 0 THEN score END q FROM e),
 n AS (SELECT *, h / MAX(h) OVER w hn, q / MAX(q) OVER w qn, MAX(CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END) OVER w has FROM u WINDOW w AS (PARTITION BY episode_id)),
 f AS (SELECT *, CASE WHEN has = 0 THEN h WHEN q IS NOT NULL THEN 0.65 * hn + 0.35 * COALESCE(qn, 0) ELSE hn END fused FROM n)
 SELECT episode_id, candidate_id, ROUND(fused, 6) AS fused FROM f""")
def fusion_rank(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumn("heuristic", (F.col("candidate_id") % 17 + 1) / 17.0).withColumn("p", F.when(F.col("candidate_id") % 11 != 0, F.col("score"))).withColumn("in_distribution", F.lit(True))
    return _r(ranker.fuse(e, 0.35).select("episode_id", "candidate_id", "fused"), 6)


@query(_LABELLED + """, r AS (SELECT QUANTILE_CONT(n_chars, 0.01) a, QUANTILE_CONT(n_chars, 0.99) b, QUANTILE_CONT(score, 0.01) c, QUANTILE_CONT(score, 0.99) d FROM x)
 SELECT doc_id, (CASE WHEN n_chars < a OR n_chars > b THEN 1 ELSE 0 END + CASE WHEN score < c OR score > d THEN 1 ELSE 0 END) / 2.0 > 0.25 AS outside FROM x, r""")
def ood_gate(spark, sf_dir):
    x = _labelled(spark, sf_dir)
    q = x.agg(F.percentile("n_chars", F.array(F.lit(0.01), F.lit(0.99))).alias("n"), F.percentile("score", F.array(F.lit(0.01), F.lit(0.99))).alias("s")).first()
    odd = lambda c, r: ((F.col(c) < r[0]) | (F.col(c) > r[1])).cast("int")
    return x.select("doc_id", ((odd("n_chars", q["n"]) + odd("score", q["s"])) / 2.0 > ranker.OOD_SHARE).alias("outside"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Candidate rows made by rule from the labelled documents: for the feature and ranker queries."""
    e = _episodes(spark, sf_dir)
    kinds = F.array(*map(F.lit, ranker.DRIVER_TYPES))
    k = F.col("candidate_id")
    made = e.select("episode_id", k.cast("string").alias("candidate_id"), "label", "window_start", F.get(kinds, (k % 5).cast("int")).alias("driver_type"), (F.col("score") - 0.5).alias("explanatory_power"), F.when(k % 3 != 0, k % 20 - 5).cast("double").alias("gap_days"), ((k % 3) * 3.0).alias("mechanism_lag_days"), F.when(k % 4 != 0, -F.col("score")).alias("dose_rho"), F.when(k % 4 != 0, (k % 10) / 100.0).alias("dose_p"), F.when(k % 2 == 0, F.col("score") / 2).alias("did"), F.when(k % 2 == 0, (k % 7) / 10.0).alias("did_p"), (k % 9).cast("double").alias("on_theme"), (k % 3 == 0).alias("arithmetic_only"), F.lit(5.0).alias("n_candidates"))
    missing = [f for f in ranker.CANDIDATE.fields if f.name not in made.columns]
    return made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


@query(_EP + """, c AS (SELECT candidate_id k, score - 0.5 ep, CASE WHEN candidate_id % 3 <> 0 THEN candidate_id % 20 - 5 END gap, (candidate_id % 3) * 3.0::DOUBLE lag, CASE WHEN candidate_id % 4 <> 0 THEN -score END rho, (candidate_id % 10) / 100.0::DOUBLE dp, CASE WHEN candidate_id % 2 = 0 THEN score / 2 END did, candidate_id % 9 th FROM e)
 SELECT CAST(k AS VARCHAR) AS candidate_id, ROUND(ABS(ep), 6) AS f_share_abs, ROUND(CASE WHEN gap IS NULL THEN 0 ELSE GREATEST(0, 1 - ABS(gap - lag) / (lag + 10)) END, 6) AS f_lag_alignment, ROUND(COALESCE(gap, 0) / 30.0::DOUBLE, 6) AS f_gap_days_norm,
  ROUND(CASE WHEN rho IS NULL THEN 0 ELSE LEAST(12, -LOG10(GREATEST(dp, 1e-12))) END, 6)::DOUBLE AS f_dose_p_neglog10, CASE WHEN did IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS f_did_present, ROUND(LN(1 + th), 6) AS f_corrob_on_theme_log, ROUND(LN(5), 6) AS f_n_candidates_log, 1.0::DOUBLE AS f_analyst_prior_weight FROM c""")
def feature_vectors(spark, sf_dir):
    names = ("share_abs", "lag_alignment", "gap_days_norm", "dose_p_neglog10", "did_present", "corrob_on_theme_log", "n_candidates_log", "analyst_prior_weight")
    return ranker.featurize(_candidates(spark, sf_dir)).select("candidate_id", *[F.round(f"f_{n}", 6).alias(f"f_{n}") for n in names])


@query()
def snapshot_hash(spark, sf_dir):
    return ranker.snapshot_ids(ranker.featurize(_candidates(spark, sf_dir))).select("candidate_id", "snapshot_id")


@query()
def isotonic_fit(spark, sf_dir):
    from gaugeworks.ml.calibration import calibrate, fit_distributed

    x = _labelled(spark, sf_dir)
    return calibrate(x, fit_distributed(x)).select("doc_id", "score", "p")


@query()
def gbdt_train_score(spark, sf_dir):
    rows = ranker.featurize(_candidates(spark, sf_dir))
    model, _ = ranker.train(rows, grid=((3, 0.1, 2),))
    return model.score(rows)


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || '|' || lang || '|' || source), 1, 16) AS fp FROM documents")
def text_fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", scalars.fingerprint(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("fp"))


@query("SELECT o_orderkey, CASE WHEN ABS(x) >= 1e7 THEN printf('Rs %.2f Cr', x / 1e7) WHEN ABS(x) >= 1e5 THEN printf('Rs %.1f L', x / 1e5) ELSE printf('Rs %.0f', x) END AS shown FROM (SELECT o_orderkey, ROUND(o_totalprice, 0) * (o_orderkey % 200 + 1) + 0.25 AS x FROM orders)")
def money_format(spark, sf_dir):
    x = F.round("o_totalprice", 0) * (F.col("o_orderkey") % 200 + 1) + 0.25
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalars.format_inr(x).alias("shown"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of net revenue by region in the window against its expected band."""
    fact = _view(spark, sf_dir).where(ANALYST.rows())
    plan = sift.prorated_plan(spark.sql(f"select date'{WS}' ws, date'{WE}' we"), sift.derived_plan(fact), ("region",)).select("region", "plan")
    return sift.detect_many(series.daily_series(fact, NET, by=("region",)), WS, WE, NET, ("region",), plan)
