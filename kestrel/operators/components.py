"""Connected components of a large edge list (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


ROWS_PER_TASK = 250_000   # edges that one task reads; a round over few edges is a few tasks


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Every round replaces edges by edges to smaller nodes, so their number doesn't
    grow, and O(log^2 n) rounds suffice. A node's smallest neighbour comes from an
    aggregation with map-side combine and its edges are joined back, so a hub's
    edges are never gathered in one task. Rounds run until nothing changes. The
    number of edges is known, and tasks are as many as it needs. Joins merge, so that
    no round sends a table through the driver.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    marks = _marks(e)
    tasks = max(1, -(-2 * marks[0] // ROWS_PER_TASK))
    while marks[0]:
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        e = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = e.coalesce(tasks)
        low = e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        near = e.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = near.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        e = cut_lineage(e.coalesce(tasks))
        now = _marks(e)
        if now == marks:
            break
        marks = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
