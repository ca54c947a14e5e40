"""The governed contract: metrics, definitions, hierarchies, calendar, causal graph, personas, levers.

A contract is data. `Contract.from_yaml` reads one; `default_contract()` is the one that the queries
over the driver's tables use. Metric expressions are parsed by Spark (F.expr) after a check against
an allow-list of functions, and so become part of the optimised plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions that a metric expression may call.
ALLOWED_FUNCTIONS = {"sum", "avg", "count", "min", "max", "nullif", "coalesce", "case", "abs", "round", "count_if", "try_divide"}
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")


class ContractError(ValueError):
    """The contract contradicts itself or is asked for what it does not declare."""


@dataclass(frozen=True)
class Metric:
    """kind: additive (sum), ratio (numerator over denominator) or derived (no roll-up)."""

    name: str
    kind: str
    source: str
    unit: str = ""
    numerator: str = ""
    denominator: str = ""
    column: str = ""
    sliceable_by: tuple[str, ...] = ()
    warn_sigma: float = 2.0
    abs_floor: float = 0.0
    pct_floor: float = 0.0
    persistence_days: int = 3

    def parts(self) -> tuple[Column, Column]:
        """Aggregates of numerator and denominator (1 for additive metrics)."""
        return parse(self.numerator), parse(self.denominator) if self.denominator else F.lit(1.0)

    def value(self) -> Column:
        n, d = self.parts()
        return n if self.kind == "additive" else F.try_divide(n, d)


@dataclass(frozen=True)
class Definition:
    """One system's definition of a metric."""

    key: str
    expression: str
    column: str
    owner: str = ""
    authority: str = ""
    unit: str = ""
    grain: str = ""
    scope: str = ""
    source: str = ""
    formula: str = ""


@dataclass(frozen=True)
class DefinitionSet:
    metric: str
    definitions: tuple[Definition, ...]
    rule: str | None = None
    precedence: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lever:
    name: str
    owner_role: str
    authority_limit: float
    reversibility: str
    lead_days: int
    external_facing: bool


@dataclass(frozen=True)
class Playbook:
    id: str
    metric: str
    driver_type: str
    path: tuple[str, ...]
    levers: tuple[str, ...]
    recovered_pct: float
    confidence: str
    n_observations: int = 1


@dataclass(frozen=True)
class Contract:
    metrics: dict[str, Metric]
    definitions: dict[str, DefinitionSet]
    hierarchies: dict[str, dict]
    edges: tuple[tuple[str, str, int], ...]
    blocked: tuple[tuple[str, str], ...]
    personas: dict[str, dict]
    levers: dict[str, Lever]
    playbooks: tuple[Playbook, ...]
    sources: dict[str, dict]
    fiscal_start_month: int = 4
    version: str = "1"
    selected: dict[str, str] = field(default_factory=dict)

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise KeyError(f"the contract declares no metric {name!r}")
        return self.metrics[name]

    def kpis(self) -> list[str]:
        return sorted(self.metrics)

    def source_of(self, metric: str) -> str:
        return self.metric(metric).source

    def lineage(self, metric: str) -> dict:
        """Where a metric comes from: source, its date column and limit, definition and measure."""
        source = self.source_of(metric)
        return {"metric": metric, "source": source, **{k: self.sources[source][k] for k in ("date", "sla_minutes")}, "definition": self.selected.get(metric), "measure": self.measure_column(metric)}

    def levers_of(self, role: str) -> list[str]:
        return sorted(n for n, x in self.levers.items() if x.owner_role == role)

    def sliceable(self, metric: str, dimension: str) -> bool:
        """Whether the metric's grain has the dimension."""
        return dimension in self.metric(metric).sliceable_by

    def measure_column(self, metric: str) -> str | None:
        """The materialised row-level column of an additive metric, after definitions are resolved."""
        return self.metric(metric).column or None

    def freshness(self, source: str, lag_minutes: float) -> dict:
        sla = self.sources[source]["sla_minutes"]
        return {"source": source, "sla_minutes": sla, "lag_minutes": lag_minutes, "breached": lag_minutes > sla}

    def resolved(self) -> Contract:
        """The contract with each metric rewritten by its winning definition; unresolved ones stay out of `selected`."""
        from gaugeworks.operators.definitions import resolve

        metrics, selected = dict(self.metrics), {}
        for name, entry in self.definitions.items():
            winner = resolve(entry).get("selected")
            if winner and name in metrics:
                d = next(x for x in entry.definitions if x.key == winner)
                metrics[name] = replace(metrics[name], numerator=d.expression, column=d.column)
                selected[name] = winner
        return replace(self, metrics=metrics, selected=selected)

    def unresolved(self) -> list[str]:
        from gaugeworks.operators.definitions import resolve

        return sorted(k for k, v in self.definitions.items() if not resolve(v).get("selected"))

    @classmethod
    def from_yaml(cls, text: str) -> Contract:
        d = yaml.safe_load(text)
        tup = lambda v: tuple(v or ())
        return cls(
            metrics={k: Metric(name=k, **{**v, "sliceable_by": tup(v.get("sliceable_by"))}) for k, v in d["metrics"].items()},
            definitions={k: DefinitionSet(k, tuple(Definition(key=a, **b) for a, b in v["definitions"].items()), v.get("rule"), tup(v.get("precedence"))) for k, v in (d.get("definitions") or {}).items()},
            hierarchies=d.get("hierarchies") or {}, edges=tuple(tuple(e) for e in d.get("edges") or ()), blocked=tuple(tuple(e) for e in d.get("blocked") or ()),
            personas=d.get("personas") or {}, levers={k: Lever(name=k, **v) for k, v in (d.get("levers") or {}).items()},
            playbooks=tuple(Playbook(**{**p, "path": tup(p["path"]), "levers": tup(p["levers"])}) for p in d.get("playbooks") or ()),
            sources=d.get("sources") or {}, fiscal_start_month=d.get("fiscal_start_month", 4), version=str(d.get("version", "1")),
        )


def parse(expression: str) -> Column:
    """A metric expression as a column; calls outside the allow-list are an error."""
    bad = sorted({c.lower() for c in _CALL.findall(expression)} - ALLOWED_FUNCTIONS)
    if bad or ";" in expression:
        raise ContractError(f"expression calls {', '.join(bad) or 'more than one statement'}")
    return F.expr(expression)


_SLICES = ("region", "city", "segment", "channel", "category", "tier", "warehouse_id", "account_id")

#: The causal graph's edges with lags in days, and its blocks.
EDGES = (
    ("warehouse_sla", "delivery_delay", 0), ("delivery_delay", "customer_trust", 3), ("customer_trust", "reorder_behaviour", 7),
    ("reorder_behaviour", "order_volume", 0), ("order_volume", "net_revenue", 0), ("price_level", "net_revenue", 0),
    ("price_level", "order_volume", 2), ("tier_mix", "price_level", 0), ("competitor_promo", "order_volume", 1),
    ("seasonality", "order_volume", 0), ("weather", "delivery_delay", 0), ("data_pipeline", "net_revenue", 0),
)
BLOCKED = (("weather", "reorder_behaviour"), ("competitor_promo", "otd_pct"), ("tier_mix", "warehouse_sla"), ("seasonality", "data_pipeline"))


def default_contract() -> Contract:
    """The contract over the star schema (see sources.estate.fact). Thresholds, levers, limits and
    playbook effects are fixed values."""
    net = "sum(gross_revenue) - sum(discount_amount)"
    metrics = (
        Metric("net_revenue", "additive", "orders", "INR", net, column="net_revenue", sliceable_by=_SLICES, abs_floor=2_500_000, pct_floor=0.08, persistence_days=3),
        Metric("order_volume", "additive", "orders", "units", "sum(units)", column="units", sliceable_by=_SLICES, pct_floor=0.02, persistence_days=3),
        Metric("asp", "ratio", "orders", "INR", net, "nullif(sum(units), 0)", sliceable_by=_SLICES, pct_floor=0.01, persistence_days=5),
        Metric("otd_pct", "ratio", "dispatch", "pct", "sum(case when on_time then 1.0D else 0.0D end)", "nullif(count(on_time), 0)", sliceable_by=("region", "warehouse_id", "category"), pct_floor=0.03, persistence_days=2),
        Metric("reorder_rate_28d", "derived", "orders", "rate", sliceable_by=_SLICES, pct_floor=0.02, persistence_days=7),
    )
    definitions = {
        "net_revenue": DefinitionSet("net_revenue", (
            Definition("finance", net, "net_revenue", "Group Controller", "statutory", "INR", "order_line", "booked lines", "orders", "gross - discounts"),
            Definition("operations", net + " - sum(shipping_cost)", "net_revenue_ops", "Supply Chain Finance", "management", "INR", "order_line", "contribution view", "orders", "gross - discounts - shipping"),
        ), "authority_precedence", ("finance", "operations")),
        "order_volume": DefinitionSet("order_volume", (
            Definition("finance", "sum(units)", "units", "Group Controller", "statutory", "units", "order_line", "booked lines", "orders", "sum of units"),
            Definition("operations", "sum(units)", "units", "Supply Chain Finance", "management", "units", "order_line", "booked lines", "orders", "sum of units"),
        ), "authority_precedence", ("finance", "operations")),
    }
    levers = (
        Lever("service_credit", "regional_sales_manager", 2_500_000, "reversible", 3, True), Lever("named_rep_outreach", "regional_sales_manager", 500_000, "reversible", 10, True),
        Lever("warehouse_capacity", "supply_chain_lead", 6_000_000, "costly_to_reverse", 14, False), Lever("price_correction", "cfo", 0, "hard_to_reverse", 7, True),
        Lever("promo_response", "cfo", 5_000_000, "costly_to_reverse", 5, True), Lever("monitor_only", "data_analyst", 0, "reversible", 0, False),
    )
    playbooks = (
        Playbook("PB-SLA", "net_revenue", "service_failure", ("warehouse_sla", "delivery_delay", "customer_trust", "reorder_behaviour"), ("service_credit", "named_rep_outreach", "warehouse_capacity"), 0.71, "high"),
        Playbook("PB-TIER", "asp", "mix_shift", ("tier_mix", "price_level"), ("price_correction",), 0.60, "medium"),
        Playbook("PB-PROMO", "order_volume", "external_market", ("competitor_promo", "order_volume"), ("promo_response",), 0.45, "medium"),
    )
    personas = {
        "cfo": {"rows": {}, "deny_columns": (), "deny_domains": ("web",), "pii": "redact", "depth": "executive", "max_words": 150},
        "regional_manager": {"rows": {"region": ("ASIA",)}, "deny_columns": ("net_revenue_ops",), "deny_domains": (), "pii": "mask_contact", "depth": "operational", "max_words": 180},
        "supply_chain_lead": {"rows": {}, "deny_columns": ("net_revenue", "asp"), "deny_domains": ("web",), "pii": "redact", "depth": "operational", "max_words": 160},
        "data_analyst": {"rows": {}, "deny_columns": (), "deny_domains": (), "pii": "mask_contact", "depth": "technical", "max_words": 220},
    }
    sources = {"orders": {"date": "order_date", "sla_minutes": 180}, "dispatch": {"date": "dispatch_date", "sla_minutes": 2880}, "events": {"date": "ts", "sla_minutes": 120}}
    return Contract({m.name: m for m in metrics}, definitions, {"region": {"levels": ("region", "city")}}, EDGES, BLOCKED, personas, {x.name: x for x in levers}, playbooks, sources)
