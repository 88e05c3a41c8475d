"""Connected components of links, and storage that outlives executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..storage import Scratch


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: lineage ends here, and nothing is computed twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def unfinished(edges: DataFrame) -> int:
    """The number of nodes that keep `edges` (u, v), v < u, from being stars around their smallest nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return nodes.filter("ups > 1 or ups > 0 and least = 0").count()


def star_edges(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): every node of `links` (columns a, b) but the smallest of its component, with that smallest node; a table of `scratch`.

    Alternating stars: each round links larger neighbours, then smaller ones, to the smallest neighbour. All steps are equi-joins and
    minimum aggregates, which combine before the shuffle; a node with many links is no larger than the join of its rows, which
    adaptive execution splits. The number of rounds is logarithmic in the size of the largest component. Links only ever join nodes of one component,
    so all is done when they form stars: no node has two smaller neighbours, or both a smaller and a larger one. Null ends are ignored.
    """
    edges = scratch.stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct()
    )
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, scratch.stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        scratch.drop(before)
        turn += 1
        if turn > 1 and not unfinished(edges):
            return edges


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of stars."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b): root is the smallest node it is connected with."""
    return rooted(star_edges(links, Scratch(links.sparkSession)))
