"""Connected components by repeated contraction, in shared tables; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges: a, b long. Returns id, component (an id of it) for every node that has an edge, as a
    table of scratch (of its own kept one without).

    Each round points every node at its least neighbour, follows these pointers to their end by
    doubling, and goes on with the edges between different ends. Rounds shrink geometrically; an
    aggregate finds the least neighbour, so a hub's edges never meet in one task.
    """
    spark = edges.sparkSession
    with Scratch(spark) as own:
        left = own.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        maps: list[DataFrame] = []
        while left.limit(1).count():
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            table = own.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "pointer")
            point, done = table, False
            while not done:
                far = point.select(F.col("id").alias("to"), F.col("to").alias("further")).where("`to` <> further")
                moved = own.write(point.join(far, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "pointer")
                done = not moved.where("moved").limit(1).count()
                own.drop(table)
                table, point = moved, moved.select("id", "to")
            maps.append(point)
            ends = left.join(point.withColumnRenamed("id", "a").withColumnRenamed("to", "x"), "a").join(point.withColumnRenamed("id", "b").withColumnRenamed("to", "y"), "b")
            rest = own.write(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
            own.drop(left)
            left = rest
        out = maps[0].withColumnRenamed("to", "component") if maps else spark.createDataFrame([], "id long, component long")
        for m in maps[1:]:
            out = out.join(m.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        return scratch.write(out, "components") if scratch else own.keep(out, "components")
