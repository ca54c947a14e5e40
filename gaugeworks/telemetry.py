"""Method ledger and stage timers of a run."""

from __future__ import annotations

import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("SQL", "DETERMINISTIC", "STATISTICS", "ML", "CAUSAL", "RETRIEVAL", "RULES", "LLM")


class Telemetry:
    def __init__(self) -> None:
        self.entries: list[dict] = []
        self.seconds: dict[str, float] = {}

    def method(self, stage: str, kind: str, what: str, why: str = "") -> None:
        if kind not in METHODS:
            raise ValueError(f"unknown method {kind}")
        self.entries.append({"stage": stage, "method": kind, "what": what, "why": why})

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def summary(self) -> dict:
        n = Counter(e["method"] for e in self.entries)
        total = sum(n.values())
        return {"by_method": dict(n), "steps": total, "non_llm_pct": 100.0 * (total - n["LLM"]) / total if total else 100.0, "seconds": self.seconds}


def method_mix(ledger: DataFrame, by: tuple[str, ...], price_in: float, price_out: float) -> DataFrame:
    """by, steps, a count of each method, non_llm_pct and cost of every group of a stored ledger (method, tokens_in,
    tokens_out): Telemetry.summary and cost of many runs. Rows of no known method are left out; tokens that are
    null cost nothing."""
    known = ledger.where(F.col("method").isin(*METHODS))
    counts = [F.count_if(F.col("method") == m).alias(m.lower()) for m in METHODS]
    spent = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")]
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), *counts, *spent)
    return out.withColumn("non_llm_pct", 100.0 * (F.col("steps") - F.col("llm")) / F.col("steps")).withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)


def timed(run, reps: int = 3) -> tuple[float, object]:  # noqa: ANN001
    """Median seconds of some runs of a function, and its last result."""
    took, result = [], None
    for _ in range(reps):
        began = time.perf_counter()
        result = run()
        took.append(time.perf_counter() - began)
    return sorted(took)[len(took) // 2], result


def cost(tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> float:
    """Prices are per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
