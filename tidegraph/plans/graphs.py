"""Evolving graphs derived from the test tables, prepared once per session and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.config import EvolveConfig
from tidegraph.operators import evolve
from tidegraph.session import Scratch

CONFIG = EvolveConfig()
_ready: dict[tuple[str, str, str], str] = {}


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): who supplied what, over all line items. Supplier ids are even, part ids odd."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))


def event_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, snap_a, snap_d): users that follow each other in time, alive from the first to the last such meeting.

    Succession inside a day is a window per day; the first event of a day follows the last one
    of the day before that has any (a table of one row per day).
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    ev = ev.where("ts is not null")
    order = ["ts", "event_id"]
    inside = ev.withColumn("before", F.lag("user_id").over(Window.partitionBy("day").orderBy(*order)))
    key = F.struct(*order, "user_id")
    days = ev.groupBy("day").agg(F.max(key).alias("last"), F.min(key).alias("first"))
    over = days.select("day", F.col("first.ts").alias("ts"), F.col("first.user_id").alias("user_id"), F.lag("last.user_id").over(Window.orderBy("day")).alias("before"))
    pairs = inside.select("day", "user_id", "before").unionByName(over.select("day", "user_id", "before")).where("before is not null and before <> user_id")
    at = F.datediff("day", F.lit("2024-01-01").cast("date"))
    return pairs.groupBy(F.least("user_id", "before").alias("u"), F.greatest("user_id", "before").alias("v")).agg(
        F.floor(F.min(at) / 6).cast("int").alias("snap_a"), (F.floor(F.max(at) / 6) + 1).cast("int").alias("snap_d")
    )


def evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored supplier-part edges with weight, lifetime and bitmap."""
    key = (spark.sparkContext.applicationId, sf_dir, "sp")
    if key not in _ready:
        scratch = Scratch(spark, "graph")
        life = evolve.assign_lifetimes(evolve.canonical(supplier_part(spark, sf_dir)), CONFIG, scratch)
        edges = evolve.symmetrize(life, CONFIG.weight_modulus, CONFIG.snapshots)
        _ready[key] = scratch.cut(edges, "mirrored").scratch_path
    return spark.read.parquet(_ready[key])
