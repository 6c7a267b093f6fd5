"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it reaches.

    Nodes are bigints. Edges may repeat, point either way or run from a node to itself; edges with a null end are
    left out, and no edges give no rows. Each round is a few joins and minima over the edges, combined before they
    are shuffled, so a node with very many neighbours is no single group; the number of rounds grows with the
    logarithm of the longest path. Every round's edges are checkpointed. The driver only reads whether they changed.
    """
    now = kept(_downward(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")))
    before = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == before:
            break
        before = tuple(found)
        now = kept(_downward(_small_star(_downward(_large_star(now)))))
    # what is left are stars around the roots
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
