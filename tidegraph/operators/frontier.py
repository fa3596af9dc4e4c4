"""Set operations on frontiers (v or sid, v), and order-free forms of queue building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.semiring import Semiring


def mixed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two frontiers."""
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of a that are not in b."""
    return a.join(b, a.columns, "left_anti")


def total(frontier: DataFrame) -> DataFrame:
    """Vertices active in any snapshot."""
    return frontier.select("v").distinct()


def active(state: DataFrame, ring: Semiring) -> DataFrame:
    """Rows with a value other than the initial one."""
    return state.where(ring.reached(F.col("val")))


def near_far(frontier: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Split by value, for delta-stepping schedules."""
    return frontier.where(F.col("val") <= threshold), frontier.where(F.col("val") > threshold)


def active_edges(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges that leave active vertices (semi join; AQE broadcasts a small frontier)."""
    return edges.join(total(frontier), F.col("src") == F.col("v"), "left_semi")


def vertex_ranges(degrees: DataFrame, budget: int) -> DataFrame:
    """(part, first, last, edges): consecutive vertices whose edge lists begin in the same stretch of ``budget`` edges.

    A range holds fewer than ``budget`` edges plus those of its last vertex, so a frequent vertex ends its range.
    """
    at = edge_offsets(degrees).withColumn("part", F.floor(F.col("start") / budget).cast("long"))
    return at.groupBy("part").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.sum("degree").alias("edges"))


def edge_offsets(degrees: DataFrame, slices: int = 256) -> DataFrame:
    """Exclusive prefix sum of degrees in vertex order: (v, degree, start).

    Vertices are cut into ``slices`` equal id ranges; sums of earlier ranges (at most ``slices`` rows) are
    broadcast, and each range is summed in its own task.
    """
    top = degrees.agg(F.max("v")).first()[0] or 0
    cut = degrees.withColumn("_s", F.floor(F.col("v") * slices / (top + 1)).cast("int"))
    sums = cut.groupBy("_s").agg(F.sum("degree").alias("_d"))
    before = sums.select("_s", (F.sum("_d").over(Window.orderBy("_s")) - F.col("_d")).alias("_b"))
    w = Window.partitionBy("_s").orderBy("v")
    return cut.join(F.broadcast(before), "_s").select("v", "degree", (F.col("_b") + F.sum("degree").over(w) - F.col("degree")).alias("start"))
