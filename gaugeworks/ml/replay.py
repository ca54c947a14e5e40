"""All past episodes replayed in one plan: candidates and their tests keyed by episode.

corpus.replay runs a whole investigation for each episode. Here an episode is a row: the fact meets the
episodes' days by equality, detection and decomposition run by episode, and all hypotheses of all
episodes take their tests together. The number of jobs does not depend on the number of episodes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.contract import Contract
from gaugeworks.functions.scalars import LADDER_CONFIDENCE, normal_two_sided_p, student_two_sided_p
from gaugeworks.ml.ranker import CANDIDATE
from gaugeworks.operators import causal, cohorts, postings, retrieval, series, split, triage
from gaugeworks.operators.graph import CausalGraph
from gaugeworks.sources.store import stored

#: Days before a window that a baseline begins.
BACK = 29
#: The dimensions by which an episode may be filtered.
FILTERS = ("region", "channel", "segment", "category")


@F.pandas_udf(T.DoubleType())
def _student_p(rho, n):  # noqa: ANN001
    import pandas as pd

    one = lambda r, k: None if r is None or math.isnan(r) or k < 3 else student_two_sided_p(r * ((k - 2) / max(1e-12, 1 - r * r)) ** 0.5, int(k) - 2)
    return pd.Series([one(r, k) for r, k in zip(rho, n, strict=True)], dtype="float64")


def _filtered(rows: DataFrame) -> Column:
    """Whether a row passes its episode's filter: dim and value, or none."""
    own = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in FILTERS])
    return F.col("dim").isNull() | F.coalesce(own == F.col("value"), F.lit(False))


def movements(fact: DataFrame, episodes: DataFrame, contract: Contract, metric: str) -> tuple[DataFrame, DataFrame]:
    """(a row of detection, the band by day up to the window's end) of each episode of one metric.

    The fact is added up once to daily series of every value that an episode may be filtered by."""
    m = contract.metric(metric)
    own = episodes.where(F.col("metric") == metric)
    daily = triage.sweep_series(fact.withColumn("all", F.lit("*")), [m], (*FILTERS, "all"))
    slices = own.select("episode_id", "ws", "we", F.concat(F.coalesce("dim", F.lit("all")), F.lit("="), F.coalesce("value", F.lit("*"))).alias("_s"))
    sent = daily.drop("metric").join(F.broadcast(slices), F.col("slice") == F.col("_s")).where("d <= we")
    sliced = stored(sent.select(F.col("episode_id").alias("slice"), "d", "v", "ws", "we"), "replay-series")
    return triage.detect_windows(sliced, m).withColumnRenamed("slice", "episode_id"), series.expected_band(sliced, ("slice",)).withColumnRenamed("slice", "episode_id")


def _candidates(fact: DataFrame, episodes: DataFrame, contract: Contract, events: DataFrame | None) -> DataFrame:
    """episode_id, ws, we, dim, value, metric, candidate_id, driver_type, cause, explanatory_power, arithmetic_only,
    warehouse, region, channel, start_date of every hypothesis: the rules of ladder.hypotheses by episode."""
    days = episodes.select("episode_id", "ws", "we", "dim", "value", F.explode(F.sequence(F.date_sub("ws", BACK), F.col("we"))).alias("order_date"))
    met = fact.join(days, "order_date").where(_filtered(fact)).withColumn("cur", F.col("order_date") >= F.col("ws")).withColumn("base", F.col("order_date") < F.col("ws"))
    met = met.withColumn("_scale", (F.datediff("we", "ws") + 1) / F.lit(float(BACK)))
    cells = split.lattice(met, F.col("_scale"), by=("episode_id",))
    top = Window.partitionBy("episode_id").orderBy(F.desc("score"), "dimension", "value")
    shops = cells.withColumn("_r", F.row_number().over(top)).where("_r <= 8 AND dimension = 'warehouse_id' AND abs(explanatory_power) > 0.25")
    none = F.lit(None).cast("string")
    rows = shops.select("episode_id", F.concat(F.lit("H-SLA-"), "value").alias("candidate_id"), F.lit("service_failure").alias("driver_type"), F.lit("warehouse_sla").alias("cause"), "explanatory_power", F.lit(False).alias("arithmetic_only"), F.col("value").alias("warehouse"), none.alias("region"), none.alias("channel"), F.lit(None).cast("date").alias("start_date"))
    identity = split.price_volume_mix(met, F.col("_scale"), by=("episode_id",)).select("episode_id", F.try_divide("mix_effect", "total").alias("share")).where("abs(share) > 0.05")
    fixed = lambda df, id_, kind, cause, power, exact: df.select("episode_id", F.lit(id_).alias("candidate_id"), F.lit(kind).alias("driver_type"), F.lit(cause).alias("cause"), power.alias("explanatory_power"), F.lit(exact).alias("arithmetic_only"), none.alias("warehouse"), none.alias("region"), none.alias("channel"), F.lit(None).cast("date").alias("start_date"))
    rows = rows.unionByName(fixed(identity, "H-MIX", "mix_shift", "tier_mix", F.col("share"), True))
    rows = rows.unionByName(fixed(episodes.where("metric = 'order_volume'"), "H-PRICE", "price_change", "price_level", F.lit(None).cast("double"), False))
    if events is not None:
        windows = episodes.select(F.col("episode_id").alias("window"), "ws", "we", F.when(F.col("dim") == "region", F.col("value")).alias("region"))
        hit = cohorts.touching(events.where(F.col("event_type") == cohorts.COMPETITOR), windows)
        rows = rows.unionByName(hit.select(F.col("window").alias("episode_id"), F.concat(F.lit("H-EVENT-"), F.col("event_id").cast("string")).alias("candidate_id"), F.lit("external_market").alias("driver_type"), F.lit("competitor_promo").alias("cause"), F.lit(None).cast("double").alias("explanatory_power"), F.lit(False).alias("arithmetic_only"), none.alias("warehouse"), "region", "channel", "start_date"))
    return rows.join(episodes.select("episode_id", "ws", "we", "dim", "value", "metric"), "episode_id").withColumn("hyp", F.concat_ws("|", "episode_id", "candidate_id"))


def _cohorts(found: DataFrame, fact: DataFrame) -> DataFrame:
    """Cohort rows of the hypotheses with an exposure; an episode's filter narrows both cohorts."""
    members = lambda c: fact.agg(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"all_{c}"))
    rows = found.where("warehouse IS NOT NULL OR channel IS NOT NULL").join(F.broadcast(members("warehouse_id"))).join(F.broadcast(members("channel")))
    entry = lambda role, dim, value: F.struct(F.lit(role).alias("role"), dim.alias("dim"), value.alias("value"))
    each = lambda role, dim, values: F.transform(values, lambda v: entry(role, F.lit(dim), v))
    by_shop = F.concat(each("t", "warehouse_id", F.array("warehouse")), each("c", "warehouse_id", F.array_except("all_warehouse_id", F.array("warehouse"))))
    by_event = F.concat(each("t", "channel", F.array("channel")), each("c", "channel", F.array_except("all_channel", F.array("channel"))), each("t", "region", F.array("region")), each("c", "region", F.array("region")))
    # a filter that an event's own cohort repeats is one condition
    extra = F.col("dim").isNotNull() & ~(F.col("warehouse").isNull() & F.col("dim").isin("region", "channel"))
    narrowed = F.when(extra, F.array(entry("t", F.col("dim"), F.col("value")), entry("c", F.col("dim"), F.col("value")))).otherwise(F.array().cast("array<struct<role:string,dim:string,value:string>>"))
    need = F.when(F.col("warehouse").isNotNull(), 1).otherwise(2) + extra.cast("int")
    return rows.select("hyp", "ws", "we", need.alias("need"), F.explode(F.concat(F.when(F.col("warehouse").isNotNull(), by_shop).otherwise(by_event), narrowed)).alias("m")).select("hyp", "ws", "we", "m.role", "m.dim", "m.value", "need")


def _doses(fact: DataFrame, ships: DataFrame, episodes: DataFrame) -> DataFrame:
    """episode_id, dose_rho, dose_n: Spearman's correlation of late shipments, those sent by the window's end,
    and change by account."""
    days = episodes.select("episode_id", "ws", "we", "dim", "value", F.explode(F.sequence(F.date_sub("ws", BACK), F.col("we"))).alias("order_date"))
    late = ships.where(~F.col("on_time")).groupBy("order_id", "line_no").agg(F.collect_list("dispatch_date").alias("late"))
    lines = fact.join(late, ["order_id", "line_no"], "left").join(days, "order_date").where(_filtered(fact))
    post = F.col("order_date") >= F.col("ws")
    per = lines.groupBy("episode_id", "account_id").agg(F.avg(F.when(post, F.col("net_revenue"))).alias("post"), F.avg(F.when(~post, F.col("net_revenue"))).alias("pre"), F.coalesce(F.sum(F.size(F.filter("late", lambda d: d <= F.col("we")))), F.lit(0)).alias("late"))
    per = per.where("pre > 0 AND post IS NOT NULL").select("episode_id", "late", (F.col("post") / F.col("pre") - 1).alias("change"))
    # mean ranks among the accounts of an episode
    rank = lambda c: F.rank().over(Window.partitionBy("episode_id").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("episode_id", c)) - 1) / 2.0
    ranked = per.withColumn("rx", rank("late")).withColumn("ry", rank("change"))
    return ranked.groupBy("episode_id").agg(causal.correlation("rx", "ry").alias("dose_rho"), F.count(F.lit(1)).alias("dose_n"))


def replay_all(fact: DataFrame, ships: DataFrame, episodes: DataFrame, contract: Contract, events: DataFrame | None = None, index: postings.Index | None = None) -> DataFrame:
    """Candidate rows (ranker.CANDIDATE, heuristic and window_start) of all episodes, as an investigation at the
    end of each window would have seen them: nothing after a window is read for it.

    episodes: episode_id, metric (of the orders: net_revenue, order_volume, asp), ws, we, dim and value (a
    filter on one of FILTERS, or null). events: event_id, event_type, start_date, end_date, region, channel.
    index: postings of dated texts. Episodes of too little history, and those without a hypothesis, give no
    rows; an unknown metric is an error. The fitness gate is not applied: a table's fitness is judged once,
    before its past is replayed."""
    contract = contract.resolved()
    names = sorted(r["metric"] for r in episodes.select("metric").distinct().collect())
    graph = CausalGraph(contract.edges, contract.blocked)
    known = {a for e in contract.edges for a in e[:2]}
    moved, bands = zip(*[movements(fact, episodes, contract, m) for m in names], strict=True)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    movement = stored(union(moved), "replay-movements")
    live = episodes.join(movement.where("NOT sparse AND actual IS NOT NULL").select("episode_id"), "episode_id", "left_semi")
    found = stored(_candidates(fact, live, contract, events), "replay-candidates")

    # mechanisms: a few rows of the contract
    causes = ("warehouse_sla", "tier_mix", "competitor_promo", "price_level")
    paths = [(c, m, graph.paths(c, m if m in known else "net_revenue")) for c in causes for m in names]
    mechanisms = fact.sparkSession.createDataFrame([(c, m, len(p[0]), float(graph.lag_of(p[0]))) for c, m, p in paths if p], "cause string, metric string, path_len int, mechanism_lag_days double")
    rows = found.join(F.broadcast(mechanisms), ["cause", "metric"], "left")

    tried = cohorts.counterfactuals(cohorts.cohort_series(fact, stored(_cohorts(found, fact), "replay-cohorts"), ("warehouse_id", *FILTERS), contract.measure_column("net_revenue")))
    did = tried.select("hyp", "did", F.col("t_stat").alias("did_t"), normal_two_sided_p(F.col("t_stat")).alias("did_p"), F.col("placebo").alias("did_placebo"), F.col("n1").alias("did_n_post"), F.col("parallel").alias("did_parallel"), "enough")
    rows = rows.join(did, "hyp", "left")

    asks = found.where("warehouse IS NOT NULL").select(F.col("hyp").alias("ask"), F.col("warehouse").alias("slice"), "ws", "we")
    rate = ships.groupBy(F.col("warehouse_id").alias("slice"), F.col("dispatch_date").alias("d")).agg(F.avg(F.col("on_time").cast("double")).alias("v"))
    begun = cohorts.onsets(rate, asks, shift=0.10, lookback=60).select("ask", "onset")
    if "order_volume" in names:
        priced = found.where("driver_type = 'price_change'").select(F.col("hyp").alias("ask"), F.concat(F.coalesce("dim", F.lit("all")), F.lit("="), F.coalesce("value", F.lit("*"))).alias("slice"), "ws", "we")
        price = triage.sweep_series(fact.withColumn("all", F.lit("*")), [contract.metric("asp")], (*FILTERS, "all")).select("slice", "d", "v")
        begun = begun.unionByName(cohorts.onsets(price, priced, factor=1.02).select("ask", "onset"))
    rows = rows.join(begun.withColumnRenamed("ask", "hyp"), "hyp", "left").withColumn("onset", F.coalesce("start_date", "onset"))
    sigma = movement.select("episode_id", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))
    effect = causal.effect_onset(union(bands).join(sigma, "episode_id"), F.col("ws"), F.col("we"), F.col("sigma"), by=("episode_id",)).select("episode_id", F.col("onset").alias("effect_onset"))
    rows = rows.join(effect, "episode_id", "left").withColumn("gap_days", F.datediff("effect_onset", "onset"))
    consistent = F.col("path_len").isNotNull() & F.coalesce(F.col("gap_days").between(-3, F.col("mechanism_lag_days") + 10), F.lit(False))
    rows = rows.withColumn("precedence_consistent", F.when(F.col("onset").isNotNull(), consistent))

    dosed = _doses(fact, ships, found.where("warehouse IS NOT NULL").select("episode_id", "ws", "we", "dim", "value").distinct())
    rows = rows.join(dosed, "episode_id", "left").withColumn("dose_rho", F.when(F.col("warehouse").isNotNull(), F.col("dose_rho"))).withColumn("dose_p", F.when(F.col("dose_rho").isNotNull(), _student_p(F.col("dose_rho"), F.coalesce("dose_n", F.lit(0)))))

    said = ("on_theme", "pairs", "accounts", "conflict_ratio", "corroborated")
    if index is not None:
        themes = fact.sparkSession.createDataFrame([(k, t, list(w)) for k, (t, w) in retrieval.THEMES.items()], "driver_type string, theme string, terms array<string>")
        scope = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(f"{d}="), F.col(c)))) for c, d in (("warehouse", "warehouse_id"), ("region", "region")) if d in index.dimensions])) if index.dimensions else F.lit(None).cast("array<array<string>>")
        told = rows.join(F.broadcast(themes), "driver_type").select(F.col("hyp").alias("ask"), F.date_sub("ws", F.coalesce("mechanism_lag_days", F.lit(0.0)).cast("int")).alias("lo"), F.col("we").alias("hi"), "terms", scope.alias("scope"), "theme")
        best, _ = postings.best_visible(postings.retrieve(index, told.drop("theme")), index.documents, F.lit(True), pool=postings.POOL)
        heard = postings.corroborated(best, told.select("ask", "theme"), retrieval.RIVALS).select(F.col("ask").alias("hyp"), *said)
        rows = rows.join(heard, "hyp", "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("boolean" if c == "corroborated" else "double").alias(c) for c in said])

    rows = rows.join(movement.select("episode_id", "z", "pct_change", "history_days", "sparse"), "episode_id").join(found.groupBy("episode_id").agg(F.count(F.lit(1)).cast("double").alias("n_candidates")), "episode_id")
    rows = rows.withColumn("exposure_depth", (F.when(F.col("warehouse").isNotNull(), 1).otherwise(0) + F.when(F.col("channel").isNotNull(), 2).otherwise(0)).cast("double"))
    rows = rows.withColumnRenamed("pairs", "independent_types").withColumnRenamed("accounts", "distinct_accounts").withColumn("evidence_withheld", F.lit(0.0))
    kept = [F.coalesce("path_len", F.lit(0)).cast("double").alias("path_len") if f.name == "path_len" else (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields]
    return rows.select(*kept, heuristic().alias("heuristic"), F.col("ws").alias("window_start"))


def heuristic() -> Column:
    """ladder.rank_score of a row with the tests of ladder.grade: share of the movement times the rung's confidence."""
    did = F.coalesce(F.col("enough") & F.col("did_parallel") & F.col("did_p").isNotNull(), F.lit(False))
    step = lambda test, level: F.when(F.coalesce(test, F.lit(False)), level).otherwise(0)
    rung = F.greatest(step(F.col("arithmetic_only"), 3), step(F.col("precedence_consistent"), 1), step((F.col("dose_p") < 0.05) & (F.col("dose_rho") < 0), 1), step(F.col("corroborated"), 2), step(did & (F.col("did_p") < 0.05), 3), step(did & (F.col("did_p") < 0.20), 1))
    sure = F.when(F.col("path_len").isNull(), LADDER_CONFIDENCE["REJECTED"]).otherwise(F.get(F.array(*[F.lit(LADDER_CONFIDENCE[f"L{k}"]) for k in range(4)]), rung))
    return F.greatest(F.abs(F.coalesce("explanatory_power", F.lit(0.0))), F.lit(0.02)) * sure
