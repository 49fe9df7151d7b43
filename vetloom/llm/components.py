"""Connected components of a graph too large for one machine, by alternating large and small stars.

Every round links each node's larger neighbours, then its smaller ones, to the least node near
it, until no link changes; then each node is linked to the least of its component. A round is
two sums by node and two joins, whose hot keys adaptive execution splits; each is written to the
shared folder, so no round depends on an executor that may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.session import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node to the least of itself and its neighbours: from the larger ones, or from the others."""
    near = edges.union(edges.select("b", "a")) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
    joined = near.join(least, near["a"] == least["n"])
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    links = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return links.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that edges(a, b), of long ids, touch; component is the least node reachable."""
    # a link goes from its larger to its smaller end
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, name)
    mark = None
    while True:
        after = materialise(_star(_star(edges, True), False), name)
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(edges)
        edges = after
        if sums == mark or not sums[0]:
            break
        mark = sums
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
