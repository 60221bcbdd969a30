"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import stored


def _hook(pairs: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the node itself, point to the least of them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (pairs.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
            .filter("v <> m").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is its least node; nodes without an edge to another are not listed.

    ``edges`` has long columns a and b in any order; rows with a null or a = b count for nothing, repeated ones once.
    Alternates two steps until nothing changes: each node's larger neighbours hook to its least neighbour, then its
    smaller ones do. The edges shrink to a star around each component's least node; a chain of n nodes takes about
    log n turns. A node's neighbours are only reduced to their least, never gathered.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(),
                 "edges")
    marked = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    seen = marked(now)
    while seen[0]:
        both = now.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                            F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, before = stored(_hook(large), "edges"), seen
        seen = marked(now)
        if seen == before:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).union(
        now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
