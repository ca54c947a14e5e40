"""Competing definitions of a metric: comparison, resolution, and the measured gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.contract import Contract, Definition, DefinitionSet, parse

COMPUTATIONAL, CONTEXTUAL = ("expression", "unit", "grain", "source"), ("owner", "authority", "scope", "formula")


def normal(text: str) -> str:
    """Case and white space do not make a difference."""
    return " ".join(str(text).lower().split())


def compare(a: Definition, b: Definition) -> dict:
    """Fields in which two definitions differ; they conflict if they compute something else."""
    differs = lambda fields: [f for f in fields if normal(getattr(a, f)) != normal(getattr(b, f))]
    computed = differs(COMPUTATIONAL)
    return {"computational": computed, "contextual": differs(CONTEXTUAL), "conflict": bool(computed)}


def resolve(entry: DefinitionSet) -> dict:
    """Agreed, resolved by authority, or unresolved: without a rule nothing is chosen."""
    keys = [d.key for d in entry.definitions]
    conflict = any(compare(entry.definitions[0], d)["conflict"] for d in entry.definitions[1:])
    if not conflict:
        return {"status": "AGREED", "selected": keys[0] if keys else None, "rejected": []}
    if entry.rule == "authority_precedence":
        for k in entry.precedence:
            if k in keys:
                return {"status": "RESOLVED", "selected": k, "rejected": [x for x in keys if x != k]}
    return {"status": "UNRESOLVED", "selected": None, "rejected": keys}


def summary(entry: DefinitionSet) -> dict:
    """Audit record."""
    first, r = entry.definitions[0], resolve(entry)
    return {"metric": entry.metric, **r, "differences": {d.key: compare(first, d) for d in entry.definitions[1:]}}


def measure_gap(fact: DataFrame, entry: DefinitionSet, by: tuple[str, ...] = ()) -> DataFrame:
    """All definitions measured in one aggregate, with each other's gap to the selected one."""
    chosen = resolve(entry)["selected"] or entry.definitions[0].key
    out = fact.groupBy(*by).agg(*[parse(d.expression).alias(d.key) for d in entry.definitions])
    for d in entry.definitions:
        if d.key != chosen:
            gap = F.col(chosen) - F.col(d.key)
            out = out.withColumn(f"gap_{d.key}", gap).withColumn(f"gap_pct_{d.key}", F.try_divide(gap, F.abs(d.key)))
    return out


def refusal(contract: Contract, metric: str) -> dict | None:
    """The answer when a metric's definition is unresolved: a result, not an exception."""
    if metric in contract.unresolved():
        return {"status": "KPI_DEFINITION_UNRESOLVED", "metric": metric, "detail": summary(contract.definitions[metric])}
    return None
