"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevane.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours of each node to the least of them and itself.

    A large star moves the neighbours above the node, a small star those below
    it and the node; both keep components as they are.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = edges.join(least, "a")
    if large:
        moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its least node.

    Rounds end when a pair of stars changes nothing; their number grows with
    the logarithm of the longest path.  Tables go to the shared folder, never
    to the driver; the result is one that ``store.drop`` takes.  Links with a
    null end, and of a node with itself, are none; a table without links gives
    no rows.
    """
    edges = store.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        half = store.written(_star(edges, True))
        stars = store.written(_star(half, False))
        store.drop(half, edges)
        edges = stars
    # every edge now ties a node to the least of its component
    found = store.written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    store.drop(edges)
    return found
