"""From a static edge list to edges with lifetimes, deltas and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import NEVER, EvolveConfig
from tidegraph.functions import bits
from tidegraph.operators.ranking import among_first
from tidegraph.session import Scratch

#: Deletions that are worked out side by side before lifetimes are written to a table.
OPEN_CASES = 8


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct undirected edges (u <= v). Self loops stay."""
    return edges.select(
        F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v")
    ).distinct()


def assign_lifetimes(edges: DataFrame, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """(u, v) -> (u, v, snap_a, snap_d).

    The first rows in hash order are the base graph, the next ones the additions of snapshot
    1, 2, ...; later rows are left out. Deletions of snapshot s are the first rows, in the hash
    order of that snapshot, of those alive in s-1. An edge has one interval only.
    """
    edges = scratch.cut(edges.select("u", "v"), "edges")
    base, add, gone = cfg.sizes(edges.count())
    ends = ["u", "v"]
    there = among_first(edges, bits.edge_hash(cfg.seed), ends, [base + s * add for s in range(cfg.snapshots + 1)])
    since = _first_of(list(enumerate(there)), F.lit(None)).cast("int")
    life = scratch.cut(edges.select("u", "v", since.alias("snap_a"), F.lit(NEVER).alias("snap_d")).where("snap_a is not null"), "since")
    gone_at: list[tuple[int, Column]] = []
    ending = lambda: life.withColumn("snap_d", _first_of(gone_at, F.col("snap_d")))
    for s in range(1, cfg.snapshots + 1):
        # an edge ends in the first snapshot that deletes it; the cases go into a table when they are many
        if len(gone_at) == OPEN_CASES:
            life, gone_at = scratch.cut(ending(), f"life{s}"), []
        alive = (F.col("snap_a") < s) & (F.col("snap_d") > s)
        gone_at.append((s, alive & among_first(ending().where(alive), bits.edge_hash(cfg.seed + s), ends, [gone])[0]))
    return ending()


def _first_of(cases: list[tuple[int, Column]], otherwise: Column) -> Column:
    """The number of the first case that holds."""
    for s, holds in reversed(cases):
        otherwise = F.when(holds, s).otherwise(otherwise)
    return otherwise


def symmetrize(life: DataFrame, modulus: int = 50, snapshots: int | None = None) -> DataFrame:
    """Both directions of each undirected edge with its weight; a self loop appears once.

    Built with one explode instead of a union, so the scan below runs once.
    """
    ends = F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst")),
    )
    ends = F.when(F.col("u") == F.col("v"), F.slice(ends, 1, 1)).otherwise(ends)
    out = life.select(F.inline(ends), "snap_a", "snap_d")
    out = out.select("src", "dst", bits.weight(modulus).alias("w"), "snap_a", "snap_d")
    return out if snapshots is None else out.withColumn("bitmap", bits.bitmap(snapshots))


def with_weights(edges: DataFrame, weighted: DataFrame) -> DataFrame:
    """edges with the weights of ``weighted`` (src, dst, w), in both directions, the least of parallel ones; an edge without a weight keeps its own."""
    w = weighted.groupBy(F.least("src", "dst").alias("_u"), F.greatest("src", "dst").alias("_v")).agg(F.min("w").alias("_w"))
    both = edges.join(w, (F.least("src", "dst") == F.col("_u")) & (F.greatest("src", "dst") == F.col("_v")), "left")
    return both.withColumn("w", F.coalesce("_w", "w").cast("int")).drop("_u", "_v", "_w")


def common_edges(edges: DataFrame, snapshots: int) -> DataFrame:
    """Edges alive in every snapshot."""
    return edges.where(bits.common(snapshots))


def noncommon_edges(edges: DataFrame, snapshots: int) -> DataFrame:
    """Edges alive in some snapshot 0..snapshots, but not in all."""
    return edges.where(~bits.common(snapshots) & (F.col("snap_a") <= snapshots) & (F.col("snap_d") > 0) & (F.col("snap_a") < F.col("snap_d")))


def snapshot_edges(edges: DataFrame, sid: int) -> DataFrame:
    return edges.where(bits.alive(sid))


def changes(edges: DataFrame, snapshots: int) -> DataFrame:
    """Change rows (sid, op, src, dst, w) of snapshots 1..snapshots."""
    ops = F.array(
        F.struct(F.col("snap_a").alias("sid"), F.lit("add").alias("op")),
        F.struct(F.col("snap_d").alias("sid"), F.lit("del").alias("op")),
    )
    return (
        edges.select(F.inline(ops), "src", "dst", "w").where((F.col("sid") >= 1) & (F.col("sid") <= snapshots)).select("sid", "op", "src", "dst", "w")
    )


def affected_vertices(change_rows: DataFrame) -> DataFrame:
    """Vertices at which a change of a snapshot arrives."""
    return change_rows.select("sid", F.col("dst").alias("v")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct ends of mirrored edges."""
    return edges.select(F.col("src").alias("v")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def top_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k vertices of highest degree over the union of all snapshots; ties by id."""
    return out_degree(edges).orderBy(F.desc("degree"), "v").limit(k)


def snapshot_counts(edges: DataFrame, snapshots: int) -> DataFrame:
    """Directed edges alive in each snapshot."""
    sids = F.sequence(F.greatest(F.col("snap_a"), F.lit(0)), F.least(F.col("snap_d") - 1, F.lit(snapshots)))
    there = edges.where((F.col("snap_a") <= snapshots) & (F.col("snap_d") > F.col("snap_a")))
    return there.select(F.explode(sids).alias("sid")).groupBy("sid").agg(F.count("*").alias("edges"))
