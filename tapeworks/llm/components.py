"""Connected components of an edge table, by DataFrame operations only.

Each round first links every node's larger neighbours to its smallest neighbour, then its smaller
ones (the alternating large-star and small-star steps); paths shrink to stars in a logarithmic
number of rounds. Only aggregates with map-side combine and equi joins are used, so a hub with a
third of all edges is split by Spark's skew join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import written


def _larger(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo), hi > lo: every node's larger neighbours are linked to the smallest of all; edges may repeat."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    least = written(least, "least")  # a table of its own, so that the edges of a hot hub can be split
    return edges.withColumnRenamed("lo", "node").join(least, "node").select("hi", F.col("m").alias("lo"))


def _smaller(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them; edges are distinct."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """`edges`, written, and figures that differ if the edges do."""
    seen, h = Observation(), F.xxhash64("hi", "lo")
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.shiftright(h, 24)).alias("sum"), F.bit_xor(h).alias("xor")), "edges")
    return table, tuple(seen.get.values())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without an edge to another node are left out.

    Null ends and loops are ignored, repeated edges count once, any ordered type will do.
    """
    now, known = _round(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    for _ in range(max_rounds):
        now, found = _round(_smaller(_larger(now)))
        if found == known:
            break
        known = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
