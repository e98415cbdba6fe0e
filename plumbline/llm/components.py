"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join
from plumbline.session import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def contract(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, with the components of the edges given; without `rounds`, every u has its root as only v.

    Each round hangs the neighbours of a node onto the smallest of them, first the larger ones, then the
    smaller ones; the number of rounds grows with the logarithm of the longest chain.  Minima combine before
    the shuffle and are joined back with salt, so a node with very many links is no single task.  Rounds are kept in files,
    so that the planner's sizes do not multiply from round to round.
    """
    edges = stored(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        # larger neighbours move to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct())
        if rounds is None:
            now = _state(edges)
            if now == before:
                break
            before = now
    return edges


def labels(edges: DataFrame) -> DataFrame:
    """(node, root) of contracted edges: the smallest v of a node; a node that is only a v is its own root."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return both.groupBy("node").agg(F.min("root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table: root is the smallest node it is linked with."""
    return labels(contract(edges))
