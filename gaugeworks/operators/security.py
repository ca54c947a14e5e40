"""Row, column and domain security; personal data."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import scrub_pii

RESTRICTED = "[restricted by entitlement]"


@dataclass(frozen=True)
class Persona:
    name: str
    row_filter: dict[str, tuple] = field(default_factory=dict)
    deny_columns: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    pii: str = "redact"
    max_words: int = 200
    depth: str = "technical"

    def rows(self, filters: dict | None = None) -> Column:
        """Entitled rows that also pass the filters (value or list of values): literals, so no quoting."""
        tests = [F.col(c).isin(list(v)) for c, v in self.row_filter.items()]
        tests += [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in (filters or {}).items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def refused(self, filters: dict | None) -> list[str]:
        """Dimensions of which the filters ask for nothing that the persona may see: no query is needed."""
        out = []
        for c, allowed in self.row_filter.items():
            asked = (filters or {}).get(c)
            if asked is not None and not set(asked if isinstance(asked, (list, tuple, set)) else [asked]) & set(allowed):
                out.append(c)
        return out

    def may_see_row(self, row: dict) -> bool:
        return all(row.get(c) in v for c, v in self.row_filter.items())

    def may_see_column(self, name: str) -> bool:
        return name not in self.deny_columns

    def may_see_domain(self, domain: str) -> bool:
        return domain not in self.deny_domains

    def columns(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.deny_columns)

    def scrub_measures(self, values: dict) -> dict:
        return {k: v if self.may_see_column(k) else RESTRICTED for k, v in values.items()}


def personas(spec: dict[str, dict]) -> dict[str, Persona]:
    return {k: Persona(k, {c: tuple(v) for c, v in p.get("rows", {}).items()}, tuple(p.get("deny_columns", ())), tuple(p.get("deny_domains", ())), p.get("pii", "redact"), p.get("max_words", 200), p.get("depth", "technical")) for k, p in spec.items()}


def filter_evidence(evidence: DataFrame, persona: Persona, domain: str = "domain", text: str = "text") -> DataFrame:
    """Evidence with the reason for which it is withheld (null: visible, its text scrubbed)."""
    reason = F.when(F.col(domain).isin(list(persona.deny_domains)), F.concat(F.lit("domain:"), F.col(domain))).when(~persona.rows(), F.lit("row"))
    return evidence.withColumn("withheld_reason", reason).withColumn(text, F.when(F.col("withheld_reason").isNull(), scrub_pii(F.col(text))))
