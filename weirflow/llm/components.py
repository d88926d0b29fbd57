"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a map-side combined minimum per node and a join back to the
edges; edges are never collected and a node's neighbours never gathered. Hub
nodes make skewed join keys; adaptive execution splits these, for which both
sides must be shuffled for the join itself (``apart``). Each round ends
in a table in the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, partitions_for, stored

#: A round's table has a task and a file for so many edges.
EDGES_A_FILE = 100_000


def apart(low: DataFrame, key: str = "u") -> DataFrame:
    """``low`` with its key as an expression, so that a join shuffles it anew and can be split where a key is hot."""
    return low.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the exact sum of their ends.

    Both steps of a round map each edge to one whose ends add up to no more, onto
    the new set of edges. With as many edges as before, the map is one to one; with
    the same sum, no edge moved. So equal states mean that nothing changed.
    """
    ends = F.col("u").cast("decimal(20,0)") + F.col("v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(ends)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected edges of longs to (node, component), component the smallest reachable node.

    Loops, repeated edges and edges with a null end change nothing; nodes with
    no other neighbour are not in the result. An empty table gives an empty one.
    Rounds go on until one changes no edge; each makes the number of edges or the
    sum of their ends smaller, so they end.
    """
    e = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u > v")
        .distinct()
    )
    e = stored(e, "edges")
    before = _state(e)
    parts = partitions_for(edges.sparkSession)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(apart(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        again = small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = stored(again.coalesce(min(parts, 4 + before[0] // EDGES_A_FILE)), "edges")  # no more edges than before
        now = _state(after)
        drop_stored(e.sparkSession, e)
        e = after
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
