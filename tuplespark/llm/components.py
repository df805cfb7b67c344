"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation (least neighbour per node) and one equi-join, so
a node with millions of neighbours is spread by partial aggregation and AQE
skew splits; no adjacency list is ever collected. Each pair of steps is
written to the shared folder, where the lineage ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(u, v)``, u > v. Large: a node's larger
    neighbours are linked to its least neighbour. Small: its smaller
    neighbours and itself are."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root is the least id.

    ``edges`` holds columns u and v of an orderable type, in any order and
    with repeats; loops and edges with a null end are left out."""
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        e = stored(_star(_star(e, True), False), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
