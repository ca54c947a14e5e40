"""Mechanism ledger: the movement measured hop by hop along a causal path."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.causal import cohort_change

#: Node of the graph to the row-level column that shows it; other nodes cannot be observed.
OBSERVABLE = {"order_volume": "units", "net_revenue": "net_revenue", "price_level": "discount_amount"}


def mechanism_ledger(fact: DataFrame, path: tuple[str, ...], lags: dict[tuple[str, str], int], exposed: Column, ws: date, we: date) -> DataFrame | None:
    """pos, node, did_pct, attributable, transmission of the hops that can be measured, each in the
    window moved back by the lag that is left after it; None with fewer than two such hops."""
    rows = []
    for pos, node in enumerate(path):
        if node not in OBSERVABLE:
            continue
        left = sum(lags.get(e, 0) for e in zip(path[pos:], path[pos + 1 :], strict=False))
        back = timedelta(days=left)
        hop = cohort_change(fact, exposed, ws - back, we - back, OBSERVABLE[node])
        pick = lambda c, flag: F.sum(F.when(F.col("exposed") == flag, F.col(c)))
        rows.append(hop.agg(pick("cur", True).alias("t1"), pick("base", True).alias("t0"), pick("cur", False).alias("c1"), pick("base", False).alias("c0")).select(F.lit(pos).alias("pos"), F.lit(node).alias("node"), F.lit(left).alias("lag_left"), "t1", "t0", "c1", "c0"))
    if len(rows) < 2:
        return None
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    t, c = F.try_divide(F.col("t1") - F.col("t0"), F.col("t0")), F.try_divide(F.col("c1") - F.col("c0"), F.col("c0"))
    out = out.select("pos", "node", "lag_left", t.alias("treated_pct"), c.alias("control_pct"), (t - c).alias("did_pct"), (F.col("t1") - F.col("t0") - F.col("t0") * c).alias("attributable"))
    return out.withColumn("transmission", F.try_divide("did_pct", F.lag("did_pct").over(Window.orderBy("pos"))))
