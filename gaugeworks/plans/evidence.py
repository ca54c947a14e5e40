"""Queries of the evidence stage over many hypotheses at once, with their SQL: postings, event cohorts,
batched counterfactuals, onsets, and all levels of a hierarchy.

Dated texts are the documents, each on the day that its number gives it; market events are the events
table, moved to the estate's years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import cohorts, hierarchy, postings
from gaugeworks.operators.retrieval import RIVALS
from gaugeworks.plans.catalogue import _STOP_SQL, NET, QUERY_TERMS, WE, WS, _view, _r, _t, query

# ---------------------------------------------------------------- postings


def _dated_texts(spark, sf_dir) -> DataFrame:
    day = F.date_add(F.lit(WS), (F.col("doc_id") % 28).cast("int") - 14)
    theme = F.element_at(F.array(*map(F.lit, (*RIVALS, "routine"))), (F.col("doc_id") % 4).cast("int") + 1)
    return _t(spark, sf_dir, "documents").select("doc_id", day.alias("day"), "text", "source", "lang", theme.alias("theme"), F.concat(F.lit("role-"), F.col("doc_id") % 3).alias("author_role"), F.col("lang").alias("type"), (F.col("doc_id") % 50).alias("account_id"), F.col("source").alias("domain"))


def _asks(spark, sf_dir) -> DataFrame:
    """A question for each source and language, in a window of its own, and one for everything."""
    pairs = _t(spark, sf_dir, "documents").select("source", "lang").distinct()
    own = pairs.select(F.concat_ws("/", "source", "lang").alias("ask"), F.date_sub(F.lit(WS), F.length("source")).alias("lo"), F.date_add(F.lit(WS), 3 * F.length("lang")).alias("hi"), F.array(F.array(F.concat(F.lit("source="), "source")), F.array(F.concat(F.lit("lang="), "lang"))).alias("scope"))
    every = own.agg(F.lit("*").alias("ask"), F.date_sub(F.lit(WS), 14).alias("lo"), F.lit(WE).alias("hi"), F.lit(None).cast("array<array<string>>").alias("scope"))
    return own.unionByName(every).withColumn("terms", F.array(*map(F.lit, QUERY_TERMS)))


_ASKED = f""" w AS (SELECT doc_id, source, lang, ws - 14 + CAST(doc_id % 28 AS INTEGER) AS day, list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP_SQL}, x)) AS words FROM documents, p),
 a AS (SELECT DISTINCT source || '/' || lang AS ask, source AS s, lang AS l, ws - CAST(length(source) AS INTEGER) AS lo, ws + CAST(3 * length(lang) AS INTEGER) AS hi FROM documents, p UNION ALL SELECT '*', NULL, NULL, ws - 14, we FROM p),
 m AS (SELECT ask, doc_id, words, len(words) AS dl FROM a JOIN w ON day BETWEEN lo AND hi AND (s IS NULL OR (s = source AND l = lang))),
 st AS (SELECT ask, COUNT(*) AS n, AVG(dl) AS mean FROM m GROUP BY 1),
 tf AS (SELECT ask, doc_id, dl, term, COUNT(*) AS tf FROM (SELECT ask, doc_id, dl, UNNEST(words) AS term FROM m) WHERE term IN (SELECT UNNEST({QUERY_TERMS!r})) GROUP BY ALL),
 df AS (SELECT ask, term, COUNT(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT ask, doc_id, ROUND(SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * GREATEST(dl, 1) / mean))), 6) AS score
  FROM (SELECT UNNEST({QUERY_TERMS!r}) AS term) q JOIN tf USING (term) JOIN df USING (ask, term) JOIN st USING (ask) GROUP BY 1, 2)"""


def _scored(spark, sf_dir):
    index = postings.build(_dated_texts(spark, sf_dir), ("source", "lang"))
    return index, _r(postings.retrieve(index, _asks(spark, sf_dir)), 6)


@query(_ASKED + " SELECT ask, doc_id, score FROM sc WHERE score > 0")
def postings_scores(spark, sf_dir):
    """Every document with a positive score for every question: one read of the stored index."""
    return _scored(spark, sf_dir)[1]


_VISIBLE = _ASKED + """, v AS (SELECT ask, doc_id, score, ROW_NUMBER() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE score > 0 AND source <> 'web')"""


@query(_VISIBLE + " SELECT ask, doc_id, score, CAST(rank AS INTEGER) AS rank FROM v WHERE rank <= 12")
def postings_evidence(spark, sf_dir):
    """Each question's best dozen that a reader without the web domain may see, of every document with a score."""
    index, scored = _scored(spark, sf_dir)
    return postings.best_visible(scored, index.documents, F.col("domain") != "web")[0].select("ask", "doc_id", "score", "rank")


#: As an investigation does (postings.POOL): of a question's best three dozen, those that may be seen.
_TOP = _ASKED + """, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0),
 v AS (SELECT t.ask, t.doc_id, t.score, source, lang, ROW_NUMBER() OVER (PARTITION BY t.ask ORDER BY t.score DESC, t.doc_id) AS rank FROM t JOIN documents d USING (doc_id) WHERE r <= 36 AND source <> 'web')"""


_RIVAL_SQL = "['" + "', '".join((*RIVALS, "routine")) + "']"


@query(_TOP + f""", e AS (SELECT ask, {_RIVAL_SQL}[doc_id % 4 + 1] AS theme, (doc_id % 3, lang) AS pair, doc_id % 50 AS account FROM v WHERE rank <= 12),
 g AS (SELECT a.ask, COUNT(*) FILTER (WHERE theme = '{RIVALS[0]}') AS on_theme, COUNT(DISTINCT CASE WHEN theme = '{RIVALS[0]}' THEN pair END) AS pairs, COUNT(DISTINCT CASE WHEN theme = '{RIVALS[0]}' THEN account END) AS accounts,
  COUNT(*) FILTER (WHERE theme IN ('{RIVALS[1]}', '{RIVALS[2]}')) AS conflicting FROM a LEFT JOIN e USING (ask) GROUP BY 1),
 h AS (SELECT *, ROUND(COALESCE(conflicting / NULLIF(on_theme + conflicting, 0), 0), 6) AS conflict_ratio FROM g)
 SELECT *, CASE WHEN on_theme >= 3 AND pairs >= 2 AND accounts >= 2 AND conflict_ratio < 0.4 THEN 'corroborated' WHEN conflict_ratio >= 0.4 THEN 'contested' ELSE 'insufficient' END AS verdict FROM h""")
def postings_corroboration(spark, sf_dir):
    """Whether each question's evidence agrees on the first theme or speaks for a rival."""
    index, scored = _scored(spark, sf_dir)
    found, _ = postings.best_visible(scored, index.documents, F.col("domain") != "web", pool=postings.POOL)
    wanted = _asks(spark, sf_dir).select("ask", F.lit(RIVALS[0]).alias("theme"))
    return _r(postings.corroborated(found, wanted, RIVALS).drop("corroborated", "conflicting_themes"), 6)


# ---------------------------------------------------------------- cohorts


def _market_events(spark, sf_dir) -> DataFrame:
    """The events table as a calendar: an error is a competitor's promotion, of a region and channel by its numbers."""
    regions = _t(spark, sf_dir, "region").select((F.col("r_regionkey") % 5).cast("long").alias("k"), F.col("r_name").alias("region"))
    channels = _view(spark, sf_dir).select("channel").distinct()
    first = F.substring("channel", 1, 1).cast("long")
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", cohorts.COMPETITOR).otherwise(F.col("event_type")).alias("event_type"), F.date_add(F.lit(WS), F.datediff(F.to_date("ts"), F.lit("2024-01-15").cast("date"))).alias("start_date"), F.floor(F.col("value") / 10).cast("int").alias("length"))
    e = e.withColumn("end_date", F.date_add("start_date", F.col("length"))).withColumn("k", F.col("user_id") % 5).withColumn("c", F.col("event_id") % 5 + 1)
    return e.join(F.broadcast(regions), "k").join(F.broadcast(channels.withColumn("c", first)), "c").select("event_id", "event_type", "start_date", "end_date", "region", "channel")


def _windows(spark, sf_dir) -> DataFrame:
    """Three windows of every region, and one of all."""
    own = _t(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.explode(F.array(*map(F.lit, (0, 10, 20)))).alias("k"))
    every = own.agg(F.lit(None).cast("string").alias("region"), F.lit(5).alias("k"))
    both = own.unionByName(every)
    return both.select(F.concat_ws("@", F.coalesce("region", F.lit("*")), F.col("k").cast("string")).alias("window"), "region", F.date_add(F.lit(WS), F.col("k")).alias("ws"), F.date_add(F.lit(WS), F.col("k") + 9).alias("we"))


_EVENTS_SQL = f""" ch AS (SELECT DISTINCT channel FROM fact),
 ev AS (SELECT event_id, CASE event_type WHEN 'error' THEN '{cohorts.COMPETITOR}' ELSE event_type END AS event_type, ws + CAST(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS INTEGER) AS s, CAST(FLOOR(value / 10) AS INTEGER) AS len, r_name AS region, channel, ws AS p_ws
  FROM events JOIN p ON TRUE JOIN region ON r_regionkey % 5 = user_id % 5 JOIN ch ON CAST(channel[1:1] AS INTEGER) = event_id % 5 + 1),
 win AS (SELECT r_name || '@' || k AS win, r_name AS wr, ws + k AS ws, ws + k + 9 AS we FROM region, p, (VALUES (0), (10), (20)) t(k) UNION ALL SELECT '*@5', NULL, ws + 5, ws + 14 FROM p),
 hit AS (SELECT * FROM ev JOIN win ON s <= win.we AND s + len >= win.ws - 14 AND len >= 0 AND (wr IS NULL OR wr = region))"""


@query(_EVENTS_SQL + " SELECT event_id, win AS \"window\", region, s AS start_date FROM hit")
def events_touching(spark, sf_dir):
    """Interval join of events and windows by buckets of days."""
    return cohorts.touching(_market_events(spark, sf_dir), _windows(spark, sf_dir)).select("event_id", "window", "region", "start_date")


@query(_EVENTS_SQL + f""", hc AS (SELECT * FROM hit WHERE event_type = '{cohorts.COMPETITOR}')
 SELECT win AS "window", 'H-COMP-' || event_id AS hyp, 't' AS role, 'region' AS dim, region AS value FROM hc UNION ALL SELECT win, 'H-COMP-' || event_id, 't', 'channel', channel FROM hc
 UNION ALL SELECT win, 'H-COMP-' || event_id, 'c', 'region', region FROM hc UNION ALL SELECT win, 'H-COMP-' || event_id, 'c', 'channel', ch.channel FROM hc JOIN ch ON ch.channel <> hc.channel""")
def event_cohorts(spark, sf_dir):
    """Exposed and control cohorts of every competitor event that touches a window."""
    channels = _view(spark, sf_dir).select("channel").distinct()
    return cohorts.event_hypotheses(_market_events(spark, sf_dir), _windows(spark, sf_dir), channels).select("window", "hyp", "role", "dim", "value")


def _cohorts(spark, sf_dir) -> DataFrame:
    """Every warehouse against the others, and every channel of a region against its others, in three windows each."""
    fact = _view(spark, sf_dir)
    shops = fact.select("warehouse_id").distinct()
    entry = lambda role, dim, value, need: F.struct(F.lit(role).alias("role"), F.lit(dim).alias("dim"), value.alias("value"), F.lit(need).alias("need"))
    own = shops.select(F.col("warehouse_id").alias("hyp"), F.lit("warehouse_id").alias("dim"), F.col("warehouse_id").alias("mine"))
    a = own.crossJoin(shops).select("hyp", entry("t", "warehouse_id", F.col("mine"), 1).alias("m"), entry("c", "warehouse_id", F.col("warehouse_id"), 1).alias("n"), (F.col("mine") == F.col("warehouse_id")).alias("same"))
    a = a.select("hyp", F.when(F.col("same"), F.col("m")).otherwise(F.col("n")).alias("m"))
    pairs = fact.select("region", "channel").distinct()
    b = pairs.select(F.concat_ws("/", "region", "channel").alias("hyp"), "region", "channel").join(pairs.withColumnRenamed("channel", "other"), "region")
    mine = F.array(entry("t", "region", F.col("region"), 2), entry("t", "channel", F.col("channel"), 2), entry("c", "region", F.col("region"), 2))
    b = b.select("hyp", F.explode(F.when(F.col("other") == F.col("channel"), mine).otherwise(F.array(entry("c", "channel", F.col("other"), 2)))).alias("m"))
    rows = a.unionByName(b).select("hyp", "m.*").withColumn("k", F.explode(F.array(*map(F.lit, (0, 30, 60)))))
    return rows.select(F.concat_ws("@", "hyp", F.col("k").cast("string")).alias("hyp"), F.date_add(F.lit(WS), F.col("k")).alias("ws"), F.date_add(F.lit(WS), F.col("k") + 13).alias("we"), "role", "dim", "value", "need")


@query(""" k(k) AS (VALUES (0), (30), (60)), h AS (SELECT DISTINCT warehouse_id || '@' || k AS hyp, ws + k AS ws, ws + k + 13 AS we, warehouse_id AS w, NULL AS region, NULL AS channel FROM fact, p, k
  UNION ALL SELECT DISTINCT region || '/' || channel || '@' || k, ws + k, ws + k + 13, NULL, region, channel FROM fact, p, k),
 c AS (SELECT order_date AS d, warehouse_id, region, channel, SUM(net_revenue) AS v FROM fact GROUP BY ALL),
 s AS (SELECT hyp, h.ws, d, d >= h.ws AS cur, SUM(v) FILTER (WHERE c.warehouse_id = w OR c.channel = h.channel) AS t, SUM(v) FILTER (WHERE c.warehouse_id <> w OR c.channel <> h.channel) AS ct
  FROM h JOIN c ON d BETWEEN h.ws - 29 AND h.we AND (w IS NOT NULL OR h.region = c.region) GROUP BY ALL),
 r AS (SELECT *, CASE WHEN t > 0 AND ct > 0 THEN LN(t) - LN(ct) END AS r FROM s),
 n AS (SELECT *, CASE WHEN r IS NOT NULL AND NOT cur THEN ROW_NUMBER() OVER (PARTITION BY hyp, r IS NOT NULL AND NOT cur ORDER BY d) END AS i, COUNT(r) FILTER (WHERE NOT cur) OVER (PARTITION BY hyp) // 2 AS half FROM r),
 g AS (SELECT hyp, AVG(r) FILTER (WHERE cur) AS m1, AVG(r) FILTER (WHERE NOT cur) AS m0, VAR_SAMP(r) FILTER (WHERE cur) AS s1, VAR_SAMP(r) FILTER (WHERE NOT cur) AS s0, COUNT(r) FILTER (WHERE cur) AS n1, COUNT(r) FILTER (WHERE NOT cur) AS n0, MAX(half) AS half,
  AVG(r) FILTER (WHERE i <= half) AS early, AVG(r) FILTER (WHERE i > half) AS late, COUNT(t) FILTER (WHERE cur) AS a, COUNT(t) FILTER (WHERE NOT cur) AS b, COUNT(ct) FILTER (WHERE cur) AS e, COUNT(ct) FILTER (WHERE NOT cur) AS f,
  AVG(t) FILTER (WHERE cur) AS t1, AVG(t) FILTER (WHERE NOT cur) AS t0, AVG(ct) FILTER (WHERE cur) AS c1, AVG(ct) FILTER (WHERE NOT cur) AS c0 FROM n GROUP BY 1),
 x AS (SELECT *, m1 - m0 AS did, CASE WHEN half >= 3 THEN late - early ELSE 0 END AS placebo FROM g)
 SELECT hyp, LEAST(a, b, e, f) >= 5 AS enough, n1, n0, ROUND(did, 5) AS did, ROUND(SQRT(s1 / n1 + s0 / n0), 5) AS se, ROUND(placebo, 5) AS placebo, ABS(placebo) < GREATEST(0.04, 0.5 * ABS(did)) AS parallel, ROUND((t1 - t0 * c1 / c0) * 14, 1) AS attributable FROM x""")
def batched_counterfactuals(spark, sf_dir):
    """Difference in differences of some ninety hypotheses in one scan of the fact."""
    series = cohorts.cohort_series(_view(spark, sf_dir), _cohorts(spark, sf_dir), ("warehouse_id", "region", "channel"))
    out = cohorts.counterfactuals(series).drop("t_stat")
    return out.select(*[F.round(c, 1 if c == "attributable" else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(""" k(k) AS (VALUES (0), (20), (40)), q AS (SELECT r_name || '@' || k AS ask, r_name AS region, ws + k AS ws, ws + k + 13 AS we FROM region, p, k),
 s AS (SELECT region, order_date AS d, SUM(net_revenue) / SUM(units) AS v FROM fact GROUP BY ALL),
 i AS (SELECT ask, ws, d, v, CASE WHEN COUNT(v) OVER l >= 4 THEN AVG(v) OVER l END AS m, ROW_NUMBER() OVER (PARTITION BY ask ORDER BY d) AS k FROM q JOIN s USING (region) WHERE d BETWEEN ws - 45 AND we WINDOW l AS (PARTITION BY ask ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
 b AS (SELECT ask, MEDIAN(m) FILTER (WHERE k <= 21 AND d < ws) AS ref, COUNT(*) AS n FROM i GROUP BY 1),
 h AS (SELECT ask, d, COALESCE(m > ref * 1.02, FALSE)::INT AS hit FROM i JOIN b USING (ask)),
 u AS (SELECT ask, d, SUM(hit) OVER (PARTITION BY ask ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS runs FROM h)
 SELECT q.ask, CASE WHEN MAX(n) > 20 THEN MIN(d) FILTER (WHERE runs = 3) - 2 END AS onset, COALESCE(MAX(n), 0) AS "rows" FROM q LEFT JOIN u USING (ask) LEFT JOIN b USING (ask) GROUP BY 1""")
def price_break_onsets(spark, sf_dir):
    """When each region's realised price rose for good before each of three windows."""
    asks = _t(spark, sf_dir, "region").select(F.col("r_name").alias("slice"), F.explode(F.array(*map(F.lit, (0, 20, 40)))).alias("k"))
    asks = asks.select(F.concat_ws("@", "slice", F.col("k").cast("string")).alias("ask"), "slice", F.date_add(F.lit(WS), F.col("k")).alias("ws"), F.date_add(F.lit(WS), F.col("k") + 13).alias("we"))
    return cohorts.price_onsets(_view(spark, sf_dir), asks, F.col("region"))


# ---------------------------------------------------------------- hierarchy


@query(""" a AS (SELECT region, city, account_id, GROUPING_ID(region, city, account_id) AS gid, SUM(net_revenue) FILTER (WHERE order_date BETWEEN ws AND we) AS n1, SUM(net_revenue) FILTER (WHERE order_date BETWEEN bs AND be) * MIN(sc) AS n0
  FROM fact, p WHERE order_date BETWEEN bs AND we GROUP BY ROLLUP (region, city, account_id))
 SELECT CASE gid WHEN 7 THEN 'all' WHEN 3 THEN 'region' WHEN 1 THEN 'city' ELSE 'account_id' END AS level, region, city, account_id, ROUND(COALESCE(n1, 0), 4) AS "current", ROUND(COALESCE(n0, 0), 4) AS expected, ROUND(COALESCE(n1, 0) - COALESCE(n0, 0), 4) AS move, TRUE AS closes FROM a""")
def hierarchy_closure(spark, sf_dir):
    """All levels from the whole down to accounts in one scan; every parent is the sum of its children."""
    return _r(hierarchy.closure(_view(spark, sf_dir), NET, ("region", "city", "account_id"), WS, WE).drop("children"))
