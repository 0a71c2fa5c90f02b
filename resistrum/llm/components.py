"""Connected components by alternating stars: union-find as joins; a hub's neighbours are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import BROADCAST_ROWS, dropped, narrow_join, written


def components(edges: DataFrame) -> DataFrame:
    """A row (id, component) for each id in edges (a, b), written; component is the smallest id that can be reached.

    Null ids and loops are left out; an empty table gives an empty one. A step moves the neighbours above each id to
    its least neighbour, then those at most as large. Its edges are written to the shared folder, and those before it
    deleted. In a forest of stars an id above its least neighbour has no other one; then the least neighbours are the
    components. No step has more edges than the one before; at most BROADCAST_ROWS are moved by one write a step.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    few = edges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), (F.min("v") < F.max("v")).alias("_more"), F.count("*").alias("_n")), "least")
        if least.where("m < u AND _more").isEmpty():
            dropped(edges)
            return least.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = both.where("v > u").join(F.broadcast(least.select("u", "m")), "u") if few else narrow_join(both.where("v > u"), least.select("u", "m"), ["u"], F.xxhash64("v"), least.select("u", "_n"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if few:
            lower = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(F.broadcast(lower.select("u", "m")), "u")
        else:
            large = written(large, "large")
            lower = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "lower")
            moved = narrow_join(large, lower.select("u", "m"), ["u"], F.xxhash64("v"), lower.select("u", "_n"))
        stars = written(moved.where("v <> m").select("v", "m").union(lower.select("u", "m")).toDF("a", "b").distinct(), "edges")
        for done in (edges, least) if few else (edges, least, large, lower):
            dropped(done)
        edges = stars
