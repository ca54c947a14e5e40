"""Playbook retrieval, recommendations, and routing by decision rights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.contract import Contract, Playbook
from gaugeworks.functions.scalars import LADDER_CONFIDENCE

#: Shares of a similarity, its floor, and factors of an outcome's confidence.
SIMILARITY = {"metric": 0.35, "driver": 0.40, "path": 0.25}
FLOOR = 0.45
OUTCOME_CONFIDENCE = {"high": 1.0, "medium": 0.85, "low": 0.6}
ABSTAIN = ("UNKNOWN", "COMPETING", "INSUFFICIENT_HISTORY", "DATA_QUALITY", "KPI_DEFINITION_UNRESOLVED", "UNFIT_DATA", "ENTITLEMENT_DENIED")


def similarity(p: Playbook, metric: str, driver_type: str, path: tuple[str, ...]) -> float:
    a, b = set(p.path), set(path)
    jaccard = len(a & b) / len(a | b) if a and b else 0.0
    return round(SIMILARITY["metric"] * (p.metric == metric) + SIMILARITY["driver"] * (p.driver_type == driver_type) + SIMILARITY["path"] * jaccard, 4)


def similarity_columns(metric: Column, driver: Column, path: Column, p_metric: Column, p_driver: Column, p_path: Column) -> Column:
    """The same over columns: hypotheses by playbooks in one join."""
    both = F.size(F.array_intersect(path, p_path)) / F.greatest(F.size(F.array_union(path, p_path)), F.lit(1))
    return F.round(SIMILARITY["metric"] * (metric == p_metric).cast("double") + SIMILARITY["driver"] * (driver == p_driver).cast("double") + SIMILARITY["path"] * both, 4)


def recommend(contract: Contract, metric: str, verdict: dict, delta: float, playbooks: tuple[Playbook, ...] | None = None) -> list[dict]:
    """Actions of the most similar playbook of each of three leaders at most, by impact times confidence;
    without a confirmed cause the one recommendation is to watch."""
    if verdict["status"] in ABSTAIN:
        lever = contract.levers["monitor_only"]
        return [{"lever": lever.name, "owner_role": lever.owner_role, "expected_impact": 0.0, "confidence": 0.25, "abstention": True, "playbook": None, "lead_days": 0}]
    out = []
    for x in verdict["leaders"][:3]:
        hyp, graded = x["hyp"], x["grade"]
        ranked = sorted(((similarity(p, metric, hyp["driver_type"], graded["path"]), p) for p in playbooks or contract.playbooks), key=lambda t: -t[0])
        if not ranked or ranked[0][0] < FLOOR:
            continue
        sim, p = ranked[0]
        confidence = LADDER_CONFIDENCE[graded["ladder"]] * OUTCOME_CONFIDENCE.get(p.confidence, 0.85) * min(1.0, 0.7 + 0.3 * sim)
        impact = abs(hyp.get("explanatory_power") or 0.0) * abs(delta) * p.recovered_pct / len(p.levers)
        out += [{"lever": n, "owner_role": contract.levers[n].owner_role, "expected_impact": impact, "confidence": confidence, "abstention": False, "playbook": p.id, "lead_days": contract.levers[n].lead_days, "ladder": graded["ladder"]} for n in p.levers]
    return sorted(out, key=lambda r: -r["expected_impact"] * r["confidence"])


def route(contract: Contract, rec: dict, status: str) -> str:
    """AI_LED at L3, HUMAN_LED at L2, else HUMAN_ONLY; over the lever's limit or hard to undo, one step down."""
    if rec.get("abstention") or status in ABSTAIN:
        return "HUMAN_ONLY"
    lever = contract.levers[rec["lever"]]
    mode = {"L3": "AI_LED", "L2": "HUMAN_LED"}.get(rec.get("ladder"), "HUMAN_ONLY")
    over = lever.authority_limit > 0 and rec["expected_impact"] > lever.authority_limit
    return "HUMAN_LED" if mode == "AI_LED" and (over or lever.reversibility == "hard_to_reverse") else mode


def route_column(ladder: Column, impact: Column, limit: Column, reversibility: Column, abstention: Column) -> Column:
    demote = ((limit > 0) & (impact > limit)) | (reversibility == "hard_to_reverse")
    return F.when(abstention, "HUMAN_ONLY").when(ladder == "L3", F.when(demote, "HUMAN_LED").otherwise("AI_LED")).when(ladder == "L2", "HUMAN_LED").otherwise("HUMAN_ONLY")


def apply_learning(playbooks: tuple[Playbook, ...], outcomes: dict[str, tuple[float, int]]) -> tuple[Playbook, ...]:
    """Playbooks with the measured mean effect over theirs; three observations make high confidence."""
    return tuple(replace(p, recovered_pct=outcomes[p.id][0], n_observations=outcomes[p.id][1], confidence="high" if outcomes[p.id][1] >= 3 else p.confidence) if p.id in outcomes else p for p in playbooks)


def decision_days(recs: list[dict], now_to_review: int = 1) -> int:
    """Days until the first action can work."""
    return now_to_review + min((r["lead_days"] for r in recs), default=0)


def lever_frame(contract: Contract, spark) -> DataFrame:
    return spark.createDataFrame([(x.name, x.owner_role, float(x.authority_limit), x.reversibility, x.lead_days) for x in contract.levers.values()], "lever string, owner_role string, authority_limit double, reversibility string, lead_days int")
