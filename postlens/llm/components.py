"""Connected components of a graph of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlens.llm.tables import stored


def _star(edges: DataFrame, name: str) -> DataFrame:
    """Links every neighbour of u to the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = edges.join(least, edges["u"] == least["w"])
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, root): each linked vertex with the smallest one it reaches.

    Vertices without a link don't appear. Every round shuffles links keyed by
    a vertex and keeps at most one link per vertex and star; the number of
    rounds grows with the logarithm of the longest chain. Rounds are written
    to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = stored(_star(large.where("u <> v"), "small"), "links")
        roots = small.select(F.col("v").alias("r")).distinct()
        if small.join(roots, small["u"] == roots["r"], "left_semi").isEmpty():
            if small.groupBy("u").count().where("count > 1").isEmpty():
                return small.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = small
