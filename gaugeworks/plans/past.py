"""Queries of a planned past: effects laid over the given order lines, the reports that go with them, plan figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.catalogue import _r, _t, query
from gaugeworks.sources import history
from gaugeworks.sources.store import stored

SEED = 7


def _u(what: str, *keys: str) -> str:
    """history.draw in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', '{what}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


def _kinds() -> str:
    """A CASE for the kind of a slot, by running totals of the weights."""
    out, total = "CASE", 0.0
    for name, values in history.KINDS.items():
        total += values[0]
        out += f" WHEN {_u('kind', 'region', 'slot')} < {total:.6f} THEN '{name}'"
    return out + " END"


_VALUES = ", ".join(f"('{k}', {v[1]}, {v[2]}, {v[3]}, {v[4]}, {v[5]}::DOUBLE, {v[6]}::DOUBLE, {v[7]}::DOUBLE, {v[8]}::DOUBLE, {v[9]}, {v[10]}, '{v[11]}')" for k, v in history.KINDS.items())
_LINES = """ l AS (SELECT ROW_NUMBER() OVER () AS rid, l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_orderdate AS DATE) AS day, o_custkey AS account_id, r_name AS region, o_orderpriority AS channel, p_type AS category,
  l_returnflag AS tier, 'WH-' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS shop, CAST(l_quantity AS DOUBLE) AS units, l_extendedprice AS price, l_linestatus = 'O' AS on_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
_PLAN = f"""{_LINES}, k(kind, a, z, wa, wz, lo, hi, lo2, hi2, dlo, dhi, metric) AS (VALUES {_VALUES}),
 sl AS (SELECT region, list_sort(list(DISTINCT shop)) AS shops, list_sort(list(DISTINCT channel)) AS channels, list_sort(list(DISTINCT category)) AS categories FROM l GROUP BY 1),
 sp AS (SELECT MIN(day) AS first, MAX(day) AS last FROM l),
 s0 AS (SELECT sl.*, first, CAST(g.slot AS INTEGER) AS slot FROM sl, sp, LATERAL (SELECT UNNEST(range(0, CAST(FLOOR((last - first - {history.WARMUP + history.SLOT + history.JITTER - 1}) / {history.SLOT}) AS BIGINT))) AS slot) g),
 s1 AS (SELECT *, first + {history.WARMUP} + {history.SLOT} * slot + CAST(FLOOR({_u('start', 'region', 'slot')} * {history.JITTER}) AS INTEGER) AS t, 'EP-' || region || '-' || LPAD(CAST(slot AS VARCHAR), 4, '0') AS episode_id,
  CASE WHEN {_u('planted', 'region', 'slot')} < {history.PLANTED} THEN {_kinds()} END AS lead FROM s0),
 s2 AS (SELECT *, list_filter(['service_failure', 'external_market', 'price_change', 'mix_shift'], lambda x: x <> lead) AS others FROM s1),
 eps AS (SELECT episode_id, COALESCE(metric, CASE WHEN {_u('metric', 'region', 'slot')} < 0.5 THEN 'net_revenue' ELSE 'order_volume' END) AS metric, t + COALESCE(wa, 7) AS ws, t + COALESCE(wz, 20) AS we, region, lead IS NULL AS null_episode FROM s2 LEFT JOIN k ON lead = kind),
 dr AS (SELECT *, 0 AS driver, lead AS kind FROM s2 WHERE lead IS NOT NULL
  UNION ALL SELECT *, 1, others[1 + CAST(FLOOR({_u('other', 'region', 'slot')} * len(others)) AS INTEGER)] FROM s2 WHERE lead IS NOT NULL AND {_u('second', 'region', 'slot')} < {history.SECOND}),
 d2 AS (SELECT dr.*, a, z, {_u('entity', 'region', 'slot', 'driver')} AS pick, FLOOR((lo + {_u('strength', 'region', 'slot', 'driver')} * (hi - lo)) * 1000 + 0.5) / 1000.0 AS strength,
  FLOOR((lo2 + {_u('second value', 'region', 'slot', 'driver')} * (hi2 - lo2)) * 1000 + 0.5) / 1000.0 AS second, CAST(dlo + FLOOR({_u('docs', 'region', 'slot', 'driver')} * (dhi - dlo + 1)) AS INTEGER) AS docs FROM dr JOIN k USING (kind)),
 fx AS (SELECT episode_id, driver, kind, region, t + a AS start, t + z AS stop, strength, second, docs, docs > 0 AND {_u('contested', 'episode_id', 'driver')} < {history.CONTESTED} AS contested,
  CASE WHEN kind IN ('service_failure', 'instrumentation') THEN shops[1 + CAST(FLOOR(pick * len(shops)) AS INTEGER)] WHEN kind = 'external_market' THEN channels[1 + CAST(FLOOR(pick * len(channels)) AS INTEGER)]
   WHEN kind = 'price_change' THEN categories[1 + CAST(FLOOR(pick * len(categories)) AS INTEGER)] ELSE '{history.CHEAP}' END AS entity FROM d2)"""


def _lines(spark, sf_dir):
    return history.lines_of({n: _t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")})


def _when(kind: str, test: str, value: str) -> str:
    return f"COALESCE(PRODUCT(CASE WHEN f.kind = '{kind}' AND {test} THEN {value} ELSE 1.0 END), 1.0)"


_HERE, _SHOP = "f.region = l.region", "f.entity = l.shop"
_SINCE = "(l.day - f.start)"


@query(f"""{_PLAN},
 x AS (SELECT l.rid, {_when('external_market', f'{_HERE} AND f.entity = l.channel', 'f.strength')} AS volume,
  {_when('service_failure', f'{_HERE} AND {_SHOP}', f'(1 - (1 - f.strength) * LEAST(1.0, GREATEST(0.0, ({_SINCE} - {history.LAG}) / {history.RAMP}.0)))')} AS health,
  {_when('service_failure', f'{_SHOP} AND l.day <= f.stop', 'f.second')} AS rate, {_when('price_change', f'{_HERE} AND f.entity = l.category', '(1 + f.strength)')} AS dearer,
  {_when('price_change', f'{_HERE} AND f.entity = l.category AND {_SINCE} >= 2', 'GREATEST(0.55, 1 - f.strength * f.second * 4)')} AS fewer,
  {_when('mix_shift', _HERE, '(1 - f.strength)')} AS stays, {_when('instrumentation', f'{_HERE} AND {_SHOP}', '(1 - f.strength)')} AS loads
  FROM l LEFT JOIN fx f ON l.day BETWEEN f.start AND f.stop + CASE WHEN f.kind = 'service_failure' THEN {history.AFTER} ELSE 0 END GROUP BY 1),
 y AS (SELECT l.*, x.*, on_time AND {_u('late', 'order_id', 'line_no')} >= rate AS late, tier <> '{history.CHEAP}' AND {_u('tier', 'order_id', 'line_no')} >= stays AS moved,
  CASE WHEN fewer < 1 THEN GREATEST(1.0, FLOOR(units * fewer + 0.5)) ELSE units END AS units2 FROM l JOIN x USING (rid)),
 c AS (SELECT *, {_u('market', 'order_id')} < volume AND {_u('health', 'order_id', 'shop')} < health AND NOT ((NOT on_time OR late) AND {_u('load', 'order_id', 'line_no')} >= loads) AS kept,
  CASE WHEN moved OR dearer <> 1 OR fewer < 1 THEN FLOOR(price * (units2 / units) * dearer * CASE WHEN moved THEN {history.CHEAPER} ELSE 1.0 END * 100 + 0.5) / 100.0 ELSE price END AS price2 FROM y),
 d AS (SELECT episode_id, STRING_AGG(kind || '/' || entity || CASE WHEN contested THEN '/contested' ELSE '' END, ',' ORDER BY driver) AS drivers FROM fx GROUP BY 1)
 SELECT e.episode_id, e.metric, e.ws, e.we, e.null_episode, d.drivers, COUNT(*) AS lines_before, SUM(kept::INT)::BIGINT AS lines_after, SUM(units) AS units_before, COALESCE(SUM(units2) FILTER (kept), 0.0) AS units_after,
  ROUND(SUM(price), 2) AS sales_before, ROUND(COALESCE(SUM(price2) FILTER (kept), 0.0), 2) AS sales_after, COUNT(*) FILTER (NOT on_time) AS late_before, COUNT(*) FILTER (kept AND (NOT on_time OR late)) AS late_after, COUNT(*) FILTER (moved AND kept) AS cheaper_lines
 FROM eps e JOIN c ON c.region = e.region AND c.day BETWEEN e.ws AND e.we LEFT JOIN d ON d.episode_id = e.episode_id GROUP BY ALL""")
def planned_past(spark, sf_dir):
    """Every planned episode over the given lines: what its region's window holds before and after all effects."""
    lines = _lines(spark, sf_dir)
    episodes, effects = history.plan(lines, SEED)
    days = episodes.select("*", F.col("value").alias("region"), F.explode(F.sequence("ws", "we")).alias("order_date")).drop("dim", "value")
    # what no window holds goes before the lines are dealt out by part
    lines = lines.join(F.broadcast(days.select("region", "order_date").distinct()), ["region", "order_date"], "left_semi")
    after = history.compose(lines.withColumns({"_units": F.col("units"), "_price": F.col("price"), "_on": F.col("on_time"), "_tier": F.col("tier")}), effects, SEED)
    said = effects.groupBy("episode_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("driver", F.concat("kind", F.lit("/"), "entity", F.when(F.col("contested"), "/contested").otherwise("")).alias("s")))), lambda x: x.s)).alias("drivers"))
    kept = F.col("kept")
    met = after.join(F.broadcast(days), ["region", "order_date"]).groupBy("episode_id", "metric", "ws", "we", "null_episode").agg(
        F.count(F.lit(1)).alias("lines_before"), F.count_if(kept).alias("lines_after"), F.sum("_units").alias("units_before"), F.coalesce(F.sum(F.when(kept, F.col("units"))), F.lit(0.0)).alias("units_after"),
        F.sum("_price").alias("sales_before"), F.coalesce(F.sum(F.when(kept, F.col("price"))), F.lit(0.0)).alias("sales_after"), F.count_if(~F.col("_on")).alias("late_before"), F.count_if(kept & ~F.col("on_time")).alias("late_after"), F.count_if(kept & (F.col("tier") != F.col("_tier"))).alias("cheaper_lines"))
    return _r(met.join(said, "episode_id", "left"), 2)


@query(f"""{_PLAN}, own(kind, theme) AS (VALUES ('service_failure', 'service_failure'), ('external_market', 'competitor_activity'), ('price_change', 'price_objection'), ('mix_shift', 'price_objection')),
 n AS (SELECT fx.*, theme AS own, list_filter(['service_failure', 'price_objection', 'competitor_activity'], lambda x: x <> theme) AS rivals, CASE WHEN contested THEN 1 + CAST(FLOOR({_u('rivals', 'episode_id', 'driver')} * (docs // 2 + 1)) AS INTEGER) ELSE 0 END AS more FROM fx JOIN own USING (kind) WHERE docs > 0),
 r AS (SELECT *, 'false' AS rival, UNNEST(range(1, docs + 1)) AS n, own AS theme FROM n UNION ALL SELECT *, 'true', UNNEST(range(1, more + 1)), rivals[1 + CAST(FLOOR({_u('rival', 'episode_id', 'driver')} * 2) AS INTEGER)] FROM n)
 SELECT episode_id, theme, rival = 'true' AS rival, COUNT(*) AS reports, MIN(start + CAST(FLOOR({_u('day', 'episode_id', 'driver', 'rival', 'n')} * 19) AS INTEGER)) AS earliest, MAX(start + CAST(FLOOR({_u('day', 'episode_id', 'driver', 'rival', 'n')} * 19) AS INTEGER)) AS latest, TRUE AS from_own_region FROM r GROUP BY 1, 2, 3""")
def contested_evidence(spark, sf_dir):
    """Reports of every planned episode by theme, own and rival ones, all from accounts of the episode's region."""
    lines = _lines(spark, sf_dir)
    episodes, effects = history.plan(lines, SEED)
    # lines are parted into distinct rows by hash before anything takes a least one, which sorts
    places = stored(lines.select("account_id", "region", "warehouse_id").distinct(), "past-places")
    accounts = places.groupBy("account_id").agg(F.min("region").alias("region"), F.min("warehouse_id").alias("warehouse_id"))
    said = history.texts(effects, accounts.unionByName(places).distinct(), SEED)
    own = said.join(episodes.select("episode_id", "value"), "episode_id")
    return own.groupBy("episode_id", "theme", F.col("doc_id").contains("-r-").alias("rival")).agg(F.count(F.lit(1)).alias("reports"), F.min("day").alias("earliest"), F.max("day").alias("latest"), F.bool_and(F.col("region") == F.col("value")).alias("from_own_region"))


@query(f"""{_LINES}, s AS (SELECT region, day, SUM(price) AS v FROM l GROUP BY 1, 2), m AS (SELECT region, AVG(v) AS mean, MIN(day) AS lo, MAX(day) AS hi FROM s GROUP BY 1),
 g AS (SELECT region, mean, CAST(UNNEST(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM m)
 SELECT region, CAST(YEAR(m) AS INTEGER) AS year, CAST(MONTH(m) AS INTEGER) AS month, CAST(DAY(LAST_DAY(m)) AS INTEGER) AS days_in_month, ROUND(mean * DAY(LAST_DAY(m)) * 1.04, 2) AS plan_net_revenue FROM g""")
def regional_targets(spark, sf_dir):
    """Plan figures of every region and month, from its mean day of sales."""
    return history.targets(_lines(spark, sf_dir))
