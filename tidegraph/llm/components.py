"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) -> (node, root), root the smallest node of the component; only linked nodes appear.

    A round is two grouped minima, each joined back to the links, so a node with very many links
    is pre-aggregated and its join can be split. The loop ends when a round changes nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.cut(edges, "links")
    mark = None
    while True:
        both = scratch.cut(edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))), "both")
        low = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        # large star: neighbours above a node move to the smallest vertex of its neighbourhood
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = scratch.cut(moved, "large")
        low = scratch.cut(moved.groupBy("u").agg(F.min("v").alias("m")), "low")
        # small star: the neighbours below a node, and the node, move to the smallest of them
        pairs = moved.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        new = scratch.cut(pairs.where("u <> v").distinct(), "small")
        for old in (both, edges, moved):
            scratch.drop(old)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return scratch.cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
        mark = now
