"""The curated causal graph: admissible paths, blocks, lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class CausalGraph:
    def __init__(self, edges: tuple[tuple[str, str, int], ...], blocked: tuple[tuple[str, str], ...]) -> None:
        self.lag = {(a, b): n for a, b, n in edges}
        self.next: dict[str, list[str]] = {}
        for a, b, _ in edges:
            self.next.setdefault(a, []).append(b)
        self.blocked = set(blocked)

    def is_blocked(self, a: str, b: str) -> bool:
        return (a, b) in self.blocked

    def paths(self, a: str, b: str, most: int = 6) -> list[tuple[str, ...]]:
        """Simple paths of at most `most` nodes, shortest first; none if the pair is blocked."""
        if self.is_blocked(a, b):
            return []
        out, stack = [], [(a,)]
        while stack:
            path = stack.pop()
            if path[-1] == b and len(path) > 1:
                out.append(path)
            elif len(path) < most:
                stack += [(*path, n) for n in self.next.get(path[-1], []) if n not in path]
        return sorted(out, key=lambda p: (len(p), p))

    def lag_of(self, path: tuple[str, ...]) -> int:
        return sum(self.lag[e] for e in zip(path, path[1:], strict=False))


def all_paths(spark: SparkSession, edges: tuple[tuple[str, str, int], ...], target: str, most: int = 6) -> DataFrame:
    """Every path to a target with its lag, by a recursive query over the edge table."""
    spark.createDataFrame(list(edges), "src string, dst string, lag int").createOrReplaceTempView("causal_edges")
    return spark.sql(f"""
        WITH RECURSIVE walk(start, node, path, lag, n) AS (
          SELECT src, dst, concat(src, '>', dst), lag, 2 FROM causal_edges
          UNION ALL
          SELECT w.start, e.dst, concat(w.path, '>', e.dst), w.lag + e.lag, w.n + 1
          FROM walk w JOIN causal_edges e ON w.node = e.src WHERE w.n < {most} AND NOT contains(w.path, e.dst))
        SELECT start, path, lag, n FROM walk WHERE node = '{target}'""")
