"""Small graphs whose fixpoint is close to that of the whole graph, and the bound prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.config import EvolveConfig
from tidegraph.functions import bits
from tidegraph.functions.semiring import Semiring
from tidegraph.operators import dependency, evolve, fixpoint
from tidegraph.session import Scratch, light


def trees(edges: DataFrame, degrees: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch, few: bool = False) -> DataFrame:
    """Dependency states on snapshot 0 from the vertices of highest degree, all roots in one fixpoint; rows of reached vertices alone.

    Without a source all runs are the same, so there is one.
    """
    first = evolve.snapshot_edges(edges, 0)
    if not ring.sourced:
        state = scratch.cut(dependency.start(degrees.select("v"), ring, None), "trees")
        return dependency.relax(state, state, first, ring, scratch)
    roots = [r.v for r in degrees.orderBy(F.desc("degree"), "v").limit(cfg.roots).collect()]  # cfg.roots rows
    at = degrees.where(F.col("v").isin(roots))
    state = at.select(F.col("v").alias("k"), "v", F.lit(ring.at_source).cast("long").alias("val"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"))
    state = scratch.cut(state, "trees")
    return dependency.relax(state, state, first, ring, scratch, few)


def proxy_edges(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch, degrees: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Tree edges in both directions, and additions between hubs or at vertices that no tree reaches.

    One pass over the edges, which meet the tree edges and what is known of their ends: of the vertices that a tree reaches and
    those that none does, the fewer are marked, and the hubs.
    """
    degrees = scratch.cut(evolve.out_degree(edges), "degrees") if degrees is None else degrees
    tied = trees(edges, degrees, ring, cfg, scratch, few).where("parent is not null")
    links = tied.select(F.inline(F.array(F.struct(F.col("parent").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("parent").alias("dst"))))).distinct()
    links = scratch.cut(links.withColumn("tree", F.lit(True)), "links")
    met = tied.select("v").distinct().withColumn("met", F.lit(True))
    known = degrees.join(met, "v", "left").select("v", (F.col("degree") > cfg.degree_limit).alias("hub"), F.col("met").isNotNull().alias("met"))
    known = scratch.cut(known, "known")
    most = 2 * known.where("met").count() > known.count()
    marks = known.where(F.col("hub") | (F.col("met") != most))
    n = marks.count()
    cols = ["src", "dst", "w", "snap_a", "snap_d"]
    rows = edges.select(cols).join(light(links, links.count()), ["src", "dst"], "left")
    for end in ("src", "dst"):
        at = marks.select(F.col("v").alias(end), F.col("hub").alias(f"{end}_hub"), F.col("met").alias(f"{end}_met"))
        rows = rows.join(light(at, n), end, "left")
    hub, reached = (lambda end: F.coalesce(f"{end}_hub", F.lit(False))), (lambda end: F.coalesce(f"{end}_met", F.lit(most)))
    added = (F.col("snap_a") > 0) & (F.col("snap_a") <= cfg.snapshots)
    return rows.where(F.col("tree").isNotNull() | (added & ((hub("src") & hub("dst")) | ~reached("src") | ~reached("dst")))).select(cols)


def hub_hint(edges: DataFrame, core: DataFrame, share: float = 0.05) -> DataFrame:
    """(v, degree) of one more root worth trying: where the core has less than ``share`` of the snapshot-0 edges, the vertex of highest degree that
    the core does not touch; no row otherwise."""
    sparse = core.count() < share * evolve.snapshot_edges(edges, 0).count()
    touched = core.select(F.inline(F.array(F.struct(F.col("src").alias("v")), F.struct(F.col("dst").alias("v"))))).distinct()
    return evolve.out_degree(edges).join(touched, "v", "left_anti").orderBy(F.desc("degree"), "v").limit(1 if sparse else 0)


def light_edges(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """Snapshot-0 edges whose weight is at most the given exact percentile."""
    first = evolve.snapshot_edges(edges, 0)
    limit = first.agg(F.expr(f"percentile_disc({share}) within group (order by w)").alias("p")).first()["p"]
    return first.where(F.col("w") <= F.lit(limit))


def random_edges(edges: DataFrame, share: float = 0.1, seed: int = 7) -> DataFrame:
    """About that share of undirected edges, the same on each run, both directions together."""
    both = edges.withColumn("_u", F.least("src", "dst")).withColumn("_v", F.greatest("src", "dst"))
    return both.where(bits.edge_hash(seed, "_u", "_v") < int(share * bits.HASH_MODULUS)).drop("_u", "_v")


def bounded_edges(edges: DataFrame, state: DataFrame, ring: Semiring) -> DataFrame:
    """Edges that may still improve some snapshot.

    If the best value of src in any snapshot cannot beat the worst value of dst in any snapshot,
    no snapshot gains from the edge; it is dropped before rows multiply by snapshot. Nothing gains from a src that no snapshot reaches.
    """
    best, worst = ("hi", "lo") if ring.maximise else ("lo", "hi")
    reached = state.where(ring.reached(F.col("val")))
    s = fixpoint.min_max(reached).select(F.col("v").alias("src"), F.col(best).alias("_best"))
    d = fixpoint.min_max(state).select(F.col("v").alias("dst"), F.col(worst).alias("_worst"))
    kept = edges.join(light(s, reached.count()), "src").join(d, "dst").where(ring.improves(ring.extend(F.col("_best"), F.col("w")), F.col("_worst")))
    return kept.select("src", "dst", "w", "snap_a", "snap_d")
