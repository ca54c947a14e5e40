"""One investigation from contract to narrative: ten stages, each a few bounded jobs."""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.contract import Contract
from gaugeworks.functions.fiscal import period_bounds
from gaugeworks.ml.ranker import Ranker, candidate_frame, featurize, fuse
from gaugeworks.operators import actions, causal, cohorts, definitions, drift, fitness, forecast, ladder, narrative, postings, propagation, retrieval, series, sift, split
from gaugeworks.operators.graph import CausalGraph
from gaugeworks.operators.security import Persona, personas
from gaugeworks.sources.estate import Estate
from gaugeworks.telemetry import Telemetry

STAGES = ("SEMANTIC", "FITNESS", "DRIFT", "SIFT", "SPLIT", "SOURCE", "PROPAGATE", "FORECAST", "SOLVE", "NARRATE")


def investigate(estate: Estate, contract: Contract, metric: str, persona: str, ws: date | None = None, we: date | None = None, filters: dict | None = None, period: str | None = None, priors: dict[str, float] | None = None, evidence: DataFrame | None = None, events: DataFrame | None = None, plan: DataFrame | None = None,
                model: Ranker | None = None, cache: narrative.NarrativeCache | None = None, outbox: str | None = None, mode: str = "offline", writer=None) -> dict:  # noqa: ANN001
    """The finding as a nested dict. Refusals are results with a status: an undefined metric, a view
    that the persona may not have (no query is issued), unfit data, too little history.

    evidence: texts (doc_id, day, text, theme, author_role, type, account_id, domain and the dimensions of
    row security and exposure), or a postings.Index of them, which is not built again. events: market events
    (event_id, start_date, end_date; event_type, region, channel where known). plan: year, month, plan_value
    (else, for the metric in INR, from the days before the window). model: a driver ranker; it reorders
    hypotheses and never changes a rung or a verdict's status by itself. cache, outbox, mode, writer: see narrative."""
    tel, reader = Telemetry(), personas(contract.personas)[persona]
    refused = definitions.refusal(contract, metric)
    if refused:
        return refused
    denied = reader.refused(filters)
    if denied:
        return {"status": "ENTITLEMENT_DENIED", "metric": metric, "dimensions": denied}
    if period:
        ws, we = period_bounds(period, contract.fiscal_start_month)
    contract = contract.resolved()
    m, out = contract.metric(metric), {"metric": metric, "window": (ws, we), "persona": persona, "stages": list(STAGES)}
    fact, ships = estate.fact(), estate.dispatch()
    mine = fact.where(reader.rows({k: v for k, v in (filters or {}).items() if k in fact.columns}))
    with tel.stage("SEMANTIC"):
        if metric in contract.definitions:
            row = definitions.measure_gap(mine.where(F.col("order_date").between(F.lit(ws), F.lit(we))), contract.definitions[metric]).first()
            out["definitions"] = {**definitions.resolve(contract.definitions[metric]), "measured": row.asDict()}
            tel.method("SEMANTIC", "SQL", "all definitions in one aggregate")
    with tel.stage("FITNESS"):
        orders = estate.table("orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))
        accounts = estate.table("customer").select(F.col("c_custkey").alias("account_id"))
        issues = fitness.assess(fact, ships, orders, accounts, we)
        out["fitness"] = fitness.score(issues, 12).first().asDict() | {"issues_found": [r.asDict() for r in issues.collect()]}
        tel.method("FITNESS", "RULES", "issues weighted by severity")
        if out["fitness"]["verdict"] == "UNFIT":
            return out | {"status": "UNFIT_DATA", "telemetry": tel.summary()}
    with tel.stage("DRIFT"):
        out["drift"] = [r.asDict() for r in drift.psi(drift.share_table(fact, ws, we)).collect()]
        tel.method("DRIFT", "STATISTICS", "population stability of five dimensions in one scan")
    with tel.stage("SIFT"):
        if m.source == "dispatch":
            s = series.daily_series(ships.where(reader.rows({k: v for k, v in (filters or {}).items() if k in ships.columns})) if not reader.row_filter else ships, m, "dispatch_date")
        else:
            s = series.daily_series(mine, m) if m.kind != "derived" else series.reorder_rate(mine).select("d", "v")
        s = s.cache()
        planned = plan
        if planned is None and metric == "net_revenue":
            planned = sift.plan_before(mine, ws, we)
        if planned is not None:
            spine = estate.spark.createDataFrame([(ws, we)], "ws date, we date")
            planned = sift.prorated_plan(spine, planned).select(F.lit(1).alias("_all"), "plan")
        movement = sift.detect_many(s, ws, we, m, plan=planned).first().asDict()
        out["movement"] = movement
        tel.method("SIFT", "STATISTICS", "robust band and materiality gates")
        if movement["verdict"] == "INSUFFICIENT_HISTORY":
            return out | {"status": "INSUFFICIENT_HISTORY", "telemetry": tel.summary()}
    with tel.stage("SPLIT"):
        parts = split.split(mine, ws, we)
        cells = [r.asDict() for r in parts["top"].collect()]
        identity = parts["identity"].first().asDict()
        out |= {"contributors": cells, "identity": identity}
        tel.method("SPLIT", "DETERMINISTIC", "identity and lattice")
    with tel.stage("SOURCE"):
        graph = CausalGraph(contract.edges, contract.blocked)
        # a metric that the graph does not know is judged by its effect on net revenue
        effect = metric if any(metric in (a, b) for a, b, _ in contract.edges) else "net_revenue"
        flags = [r["warehouse_id"] for r in sift.late_row_collapse(ships.where(~F.col("on_time")).withColumnRenamed("dispatch_date", "d"), we, ("warehouse_id",)).where("partial_load").collect()] if m.source == "dispatch" else []
        touching = [] if events is None else market_events(events, ws, we, (filters or {}).get("region"))
        began = causal.effect_onset(series.expected_band(series.until(s, we)), ws, we, float(movement["sigma"] or 0.0)).first()
        began = began["onset"] if began else None
        found = ladder.hypotheses(metric, cells, identity, touching, flags)
        graded = {h["id"]: graph.paths(h["cause"], effect) for h in found}
        lags = {k: graph.lag_of(v[0]) if v else 0 for k, v in graded.items()}
        tests = source_tests(found, lags, mine, ships, ws, we, reader, evidence, contract.measure_column("net_revenue"), tel)
        items = []
        for h in found:
            onset, own = h.get("start_date") or tests["onset"].get(h["id"]), dict(tests["tests"].get(h["id"], {}))
            if onset is not None:
                gap = (began - onset).days if began else None
                own["precedence"] = {"cause_onset": onset, "effect_onset": began, "gap_days": gap, "consistent": bool(graded[h["id"]]) and causal.consistent_gap(gap, lags[h["id"]])}
            g = ladder.grade(h, effect, graph, own)
            items.append({"hyp": h, "grade": g, "score": ladder.rank_score(h, g, (priors or {}).get(h["id"], 1.0))})
        if model is not None and items:
            _rank(estate, items, movement, model, tel)
        verdict = ladder.verdict(items)
        out |= {"hypotheses": ladder.order(items), "status": verdict["status"], "separating_test": ladder.separating_test(verdict)}
        tel.method("SOURCE", "CAUSAL", "graph, dose-response and difference in differences")
    with tel.stage("PROPAGATE"):
        lead = verdict["leaders"][0] if verdict["leaders"] else None
        if lead and lead["hyp"]["exposure"]:
            cohort = reduce(lambda x, y: x & y, [F.col(c) == v for c, v in lead["hyp"]["exposure"].items()])
            led = propagation.mechanism_ledger(mine, lead["grade"]["path"], {(a, b): n for a, b, n in contract.edges}, cohort, ws, we)
            out["ledger"] = [r.asDict() for r in led.collect()] if led is not None else []
            tel.method("PROPAGATE", "DETERMINISTIC", "lag-aligned hops")
    with tel.stage("FORECAST"):
        out["forecast"] = [r.asDict() for r in forecast.project(series.until(s, we)).orderBy("h").collect()]
        tel.method("FORECAST", "STATISTICS", "median slope with a widening band")
    with tel.stage("SOLVE"):
        recs = actions.recommend(contract, metric, verdict, movement["delta"] or 0.0)
        out["recommendations"] = [r | {"mode": actions.route(contract, r, verdict["status"])} for r in recs]
        tel.method("SOLVE", "RULES", "playbook similarity and decision rights")
    with tel.stage("NARRATE"):
        packet = narrative.evidence_packet(movement, cells, verdict, recs, out["separating_test"], reader, metric)
        told = narrative.told(packet, reader, mode, writer, cache)
        out |= {"packet": packet, "narrative": told["text"], "guard": told["guard"], "narrated": {k: told[k] for k in ("mode", "attempts", "cached")}}
        if outbox:
            out["queued"] = narrative.queue(outbox, narrative.rendered(told["text"], packet, reader))
        tel.method("NARRATE", "LLM" if told["mode"] == "model" else "DETERMINISTIC", "text from the packet, checked against it")
    out["advisories"] = advisories(reader, items)
    s.unpersist()
    return out | {"telemetry": tel.summary()}


def market_events(events: DataFrame, ws: date, we: date, region: str | None = None) -> list[dict]:
    """Every competitor promotion that touches the window or the fortnight before it, in the region looked at
    (any, where events or the view have none): a calendar's few rows."""
    spark = events.sparkSession
    known = events if "event_type" not in events.columns else events.where(F.col("event_type") == cohorts.COMPETITOR)
    placed = known if "region" in events.columns else known.withColumn("region", F.lit(None).cast("string"))
    window = spark.createDataFrame([("w", ws, we, region if "region" in events.columns else None)], "window string, ws date, we date, region string")
    return [r.asDict() for r in cohorts.touching(placed, window).drop("window", "ws", "we").orderBy("start_date", "event_id").collect()]


def source_tests(found: list[dict], lags: dict[str, int], mine: DataFrame, ships: DataFrame, ws: date, we: date, reader: Persona, evidence, measure: str, tel: Telemetry) -> dict:  # noqa: ANN001
    """Tests and onsets of all hypotheses, each kind in one plan however many they are: counterfactuals from
    one scan of the fact, on-time rates of all warehouses from one of the shipments, one read of the postings.

    Returns tests (by hypothesis: counterfactual, dose_response, corroboration) and onset (first day of the cause)."""
    tests: dict[str, dict] = {h["id"]: {} for h in found}
    onset: dict[str, date] = {}
    shops = [h for h in found if "warehouse_id" in h["exposure"]]
    exposed = [h for h in found if h["exposure"] and all(c in mine.columns for c in h["exposure"])]
    if exposed:
        dims = tuple(sorted({c for h in exposed for c in h["exposure"]}))
        members = {c: [r[0] for r in mine.select(F.col(c).cast("string")).distinct().collect()] for c in dims if c in ("warehouse_id", "channel")}
        tried = [h | {"ws": ws, "we": we} | ({"control": {"region": h["exposure"]["region"], "channel": [c for c in members["channel"] if c != h["exposure"]["channel"]]}} if {"region", "channel"} <= set(h["exposure"]) else {}) for h in exposed]
        rows = cohorts.cohort_rows(mine.sparkSession, tried, members)
        for r in cohorts.counterfactuals(cohorts.cohort_series(mine, rows, dims, measure)).collect():
            t = r["t_stat"]
            tests[r["hyp"]]["counterfactual"] = r.asDict() | {"p_value": None if t is None or math.isnan(t) else math.erfc(abs(t) / math.sqrt(2))}
        tel.method("SOURCE", "CAUSAL", "difference in differences of every cohort in one scan")
    if shops:
        names = [h["exposure"]["warehouse_id"] for h in shops]
        rate = ships.where(F.col("warehouse_id").isin(names) & F.col("dispatch_date").between(F.date_sub(F.lit(ws), 60), F.lit(we))).groupBy(F.col("warehouse_id").alias("slice"), F.col("dispatch_date").alias("d")).agg(F.avg(F.col("on_time").cast("double")).alias("v"))
        asks = mine.sparkSession.createDataFrame([(h["id"], h["exposure"]["warehouse_id"], ws, we) for h in shops], "ask string, slice string, ws date, we date")
        onset |= {r["ask"]: r["onset"] for r in cohorts.onsets(rate, asks, shift=0.10, lookback=60).where("onset IS NOT NULL").collect()}
        rho = causal.spearman(causal.exposure_table(mine, ships, ws, we, measure), "late", "change").first()
        dose = {"rho": rho["rho"], "p_value": causal.spearman_p(rho["rho"], rho["n"])}
        for h in shops:
            tests[h["id"]]["dose_response"] = dose
    priced = [h for h in found if h["driver_type"] == "price_change"]
    if priced:
        asks = mine.sparkSession.createDataFrame([(h["id"], "all", ws, we) for h in priced], "ask string, slice string, ws date, we date")
        onset |= {r["ask"]: r["onset"] for r in cohorts.price_onsets(mine, asks, F.lit("all")).where("onset IS NOT NULL").collect()}
    told = [h for h in found if h["driver_type"] in retrieval.THEMES]
    if evidence is not None and told:
        for ask, found_ in corroborations(told, lags, ws, we, reader, evidence).items():
            tests[ask]["corroboration"] = found_
        tel.method("SOURCE", "RETRIEVAL", "best evidence of each hypothesis' window and scope by BM25, then entitlements")
    return {"tests": tests, "onset": onset}


def corroborations(found: list[dict], lags: dict[str, int], ws: date, we: date, reader: Persona, evidence) -> dict[str, dict]:  # noqa: ANN001
    """What the texts of each hypothesis' own window (with its mechanism's lag) and scope say of its theme.

    A frame of texts without `day` is one that the caller has chosen for this window; a dimension that the
    texts do not have cannot narrow them."""
    index = evidence if isinstance(evidence, postings.Index) else None
    if index is None:
        dims = tuple(c for c in ("region", "city", "segment", "category", "tier", "warehouse_id") if c in evidence.columns)
        dated = evidence if "day" in evidence.columns else evidence.withColumn("day", F.lit(we))
        index = postings.build(dated, dims)
    asks = []
    for h in found:
        scope = postings.scope_of({k: v for k, v in h["exposure"].items() if k != "channel" and k in index.dimensions})
        asks.append((h["id"], ws - timedelta(days=lags.get(h["id"], 0)), we, list(retrieval.THEMES[h["driver_type"]][1]), scope or None, retrieval.THEMES[h["driver_type"]][0]))
    frame = index.documents.sparkSession.createDataFrame(asks, "ask string, lo date, hi date, terms array<string>, scope array<array<string>>, theme string")
    visible = ~F.coalesce(F.col("domain").isin(list(reader.deny_domains)), F.lit(False))
    for column, allowed in reader.row_filter.items():
        visible = visible & F.arrays_overlap("dims", F.array(*[F.lit(f"{column}={v}") for v in allowed]))
    best, withheld = postings.best_visible(postings.retrieve(index, frame.drop("theme")), index.documents, visible, pool=postings.POOL)
    hidden: dict[str, dict] = {}
    for r in withheld.collect():
        why, own = f"domain:{r['domain']}" if r["domain"] in reader.deny_domains else "row", hidden.setdefault(r["ask"], {})
        own[why] = own.get(why, 0) + r["n"]
    out = postings.corroborated(best, frame.select("ask", "theme"), retrieval.RIVALS).collect()
    return {r["ask"]: {k: v for k, v in r.asDict().items() if k != "ask"} | {"withheld": hidden.get(r["ask"], {})} for r in out}


def _rank(estate: Estate, items: list[dict], movement: dict, model: Ranker, tel: Telemetry) -> None:
    """Give each item its fused score; with a candidate out of the model's range, or without a usable
    score, the heuristic orders alone."""
    rows = candidate_frame(estate.spark, items, movement)
    scored = model.score(featurize(rows))
    both = rows.select("episode_id", "candidate_id", "heuristic").join(scored, ["episode_id", "candidate_id"])
    for r in fuse(both, model.alpha).collect():
        item = next(x for x in items if x["hyp"]["id"] == r["candidate_id"])
        item |= {"fused": r["fused"], "p": r["p"], "in_distribution": r["in_distribution"]}
    tel.method("SOURCE", "ML", "learnt order of drivers, bounded and withdrawn outside its range")


def advisories(reader: Persona, items: list[dict]) -> list[dict]:
    """Where a row entitlement takes away the cohort that a counterfactual needs, say so."""
    if not reader.row_filter:
        return []
    weak = [x for x in items if (did := x["grade"]["tests"].get("counterfactual")) and not (did.get("enough") and did.get("parallel"))]
    return [{"type": "ENTITLEMENT_WEAKENED_EVIDENCE", "hypothesis": x["hyp"]["id"], "ladder": x["grade"]["ladder"], "entitlement": {k: list(v) for k, v in reader.row_filter.items()}} for x in weak]


def persona_of(contract: Contract, name: str) -> Persona:
    return personas(contract.personas)[name]
