"""Hierarchies: members, roll-up, drill-down with closure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.contract import Contract, ContractError, Metric
from gaugeworks.operators.split import baseline, scale_of, two_windows


class Hierarchy:
    """Levels from the top down and the parent of every member; one parent a member."""

    def __init__(self, name: str, levels: tuple[str, ...], members: dict[str, str]) -> None:
        if len(levels) < 2:
            raise ContractError(f"hierarchy {name} needs two levels")
        self.name, self.levels, self.parent_of = name, levels, dict(members)

    @classmethod
    def from_table(cls, name: str, levels: tuple[str, ...], rows: DataFrame) -> Hierarchy:
        """From a dimension table of places (levels of at most 100,000 members: larger ones are rolled up as
        frames, see roll_up_frame); two parents of a member are an error."""
        pairs = rows.select(levels[1], levels[0]).distinct().limit(100_001).collect()
        if len(pairs) > 100_000:
            raise ContractError(f"hierarchy {name} has too many members for the driver")
        seen: dict[str, str] = {}
        for child, parent in pairs:
            if seen.setdefault(child, parent) != parent:
                raise ContractError(f"{child} has two parents: {seen[child]} and {parent}")
        return cls(name, levels, seen)

    def members(self, level: str) -> list[str]:
        i = self.levels.index(level)
        return sorted(set(self.parent_of) if i == 1 else set(self.parent_of.values()))

    def roll_up(self, child: str) -> str:
        return self.parent_of[child]

    def drill_down(self, parent: str) -> list[str]:
        return sorted(c for c, p in self.parent_of.items() if p == parent)

    def level_of(self, value: str) -> str | None:
        return self.levels[1] if value in self.parent_of else self.levels[0] if value in self.parent_of.values() else None

    def child_level(self, level: str) -> str | None:
        i = self.levels.index(level)
        return self.levels[i + 1] if i + 1 < len(self.levels) else None


def available_levels(contract: Contract, metric: str, hierarchy: str = "region") -> list[dict]:
    return [{"level": x, "available": contract.sliceable(metric, x)} for x in contract.hierarchies[hierarchy]["levels"]]


def by_level(fact: DataFrame, metric: Metric, level: str) -> DataFrame:
    """level, num, den, v. Derived metrics cannot be rolled up."""
    if metric.kind == "derived":
        raise ContractError(f"{metric.name} is derived and has no roll-up")
    n, d = metric.parts()
    agg = [n.alias("num"), (d if metric.denominator else F.max(F.lit(1.0))).alias("den")]
    return fact.groupBy(level).agg(*agg).withColumn("v", F.col("num") if metric.kind == "additive" else F.try_divide("num", "den"))


def roll_up_frame(children: DataFrame, metric: Metric, parent: str) -> DataFrame:
    """Parents from children: sums of values, or of numerators over denominators; never means of ratios."""
    s = children.groupBy(parent).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return s.withColumn("v", F.col("num") if metric.kind == "additive" else F.try_divide("num", "den"))


def drill_down(fact: DataFrame, metric: Metric, parent: str, child: str, ws: date, we: date, days: int = 28) -> DataFrame:
    """Each child's current and expected value, move and share of its parent's move, and whether the
    children add up to the parent. One scan for both windows."""
    bs, be = baseline(ws, days)
    scale = scale_of(ws, we, bs, be)
    rows = two_windows(fact, ws, we, bs, be)
    n, d = metric.parts()
    both = rows.groupBy(parent, child, "cur").agg(n.alias("num"), (d if metric.denominator else F.max(F.lit(1.0))).alias("den"))
    pick = lambda c, flag: F.sum(F.when(F.col("cur") == flag, F.col(c)))
    out = both.groupBy(parent, child).agg(pick("num", True).alias("n1"), pick("den", True).alias("d1"), pick("num", False).alias("n0"), pick("den", False).alias("d0"))
    w = Window.partitionBy(parent)
    if metric.kind == "additive":
        cur, exp = F.coalesce("n1", F.lit(0.0)), F.coalesce("n0", F.lit(0.0)) * F.lit(scale)
        whole = F.sum(F.coalesce("n1", F.lit(0.0))).over(w)
    else:
        cur, exp = F.try_divide("n1", "d1"), F.try_divide("n0", "d0")
        whole = F.try_divide(F.sum("n1").over(w), F.sum("d1").over(w))
    rolled = F.sum("current").over(w) if metric.kind == "additive" else F.col("parent_current")
    out = out.select(parent, child, cur.alias("current"), exp.alias("expected"), whole.alias("parent_current")).withColumn("move", F.col("current") - F.col("expected"))
    share = F.try_divide("move", F.sum("move").over(w)) if metric.kind == "additive" else F.lit(None).cast("double")
    return out.select(parent, child, "current", "expected", "move", share.alias("share_of_move"), (F.abs(rolled - F.col("parent_current")) <= F.greatest(F.lit(1.0), F.abs("parent_current") * 1e-6)).alias("closes"))


def closure(fact: DataFrame, metric: Metric, levels: tuple[str, ...], ws: date, we: date, days: int = 28) -> DataFrame:
    """level ('all' or a name of levels), the levels' columns (null below the row's own), current, expected,
    move, children (what the children's numerators and denominators give) and closes, for every member of
    every level, from the top down.

    One scan and one rollup for both windows; numerators and denominators are sums, so a parent's ratio
    is that of its children's sums, never a mean of ratios. Children are added up by their parent's key
    with partial sums and joined with it: a parent of a third of all accounts is no hot group. A null
    member is a member of its own, told from the rollup's nulls by the grouping."""
    bs, be = baseline(ws, days)
    scale = scale_of(ws, we, bs, be)
    n, d = metric.parts()
    den = d if metric.denominator else F.lit(None).cast("double")
    rows = two_windows(fact, ws, we, bs, be)
    # sums by the lowest members first: the rollup multiplies these, not the lines
    low = rows.groupBy(*levels, "cur").agg(n.cast("double").alias("n"), den.alias("d"))
    pick = lambda c, flag: F.sum(F.when(F.col("cur") == flag, F.col(c)))
    all_ = low.rollup(*levels).agg(F.grouping_id(*levels).alias("gid"), pick("n", True).alias("n1"), pick("d", True).alias("d1"), pick("n", False).alias("n0"), pick("d", False).alias("d0"))
    depth = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))
    named = F.element_at(F.array(F.lit("all"), *map(F.lit, levels)), depth + 1)
    all_ = all_.withColumn("depth", depth).withColumn("level", named)
    # the parent of a row is its own key without the last member
    up = all_.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.when(F.col("depth") > i + 1, F.col(x)).alias(x) for i, x in enumerate(levels)], *[F.col(c).alias(f"c_{c}") for c in ("n1", "d1", "n0", "d0")])
    sums = up.groupBy("depth", *levels).agg(*[F.sum(f"c_{c}").alias(f"c_{c}") for c in ("n1", "d1", "n0", "d0")])
    same = [all_["depth"] == sums["depth"], *[all_[x].eqNullSafe(sums[x]) for x in levels]]
    both = all_.join(sums, same, "left").select(all_["level"], all_["depth"], *[all_[x] for x in levels], "n1", "d1", "n0", "d0", "c_n1", "c_d1")
    if metric.kind == "additive":
        cur, exp, below = F.coalesce("n1", F.lit(0.0)), F.coalesce("n0", F.lit(0.0)) * F.lit(scale), F.coalesce("c_n1", F.lit(0.0))
    else:
        cur, exp, below = F.try_divide("n1", "d1"), F.try_divide("n0", "d0"), F.try_divide("c_n1", "c_d1")
    out = both.select("level", "depth", *levels, cur.alias("current"), exp.alias("expected"), F.when(F.col("depth") < len(levels), below).alias("children"))
    near = F.abs(F.col("children") - F.col("current")) <= F.greatest(F.lit(1.0), F.abs("current") * 1e-6)
    return out.select("level", *levels, "current", "expected", (F.col("current") - F.col("expected")).alias("move"), "children", (F.col("children").isNull() | near).alias("closes"))
