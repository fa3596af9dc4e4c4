"""Re-evaluation, incremental maintenance, common graph, and proxy graph with exact refinement.

All semirings are monotone, so a value found on a subgraph is never better than the true one;
relaxing every edge from such values to a fixpoint is exact. Only deletions need repair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.config import EvolveConfig
from tidegraph.functions.semiring import Semiring
from tidegraph.operators import dependency, evolve, fixpoint, whole
from tidegraph.plans.proxy import bounded_edges, proxy_edges
from tidegraph.session import Scratch, light


def _sids(cfg: EvolveConfig) -> list[int]:
    return list(range(cfg.snapshots + 1))


def _first_frontier(state: DataFrame, ring: Semiring) -> DataFrame:
    return state.where(ring.reached(F.col("val")))


def reevaluate(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """All snapshots from scratch in one fixpoint; the yardstick for the other strategies."""
    state = fixpoint.dense_state(evolve.vertices(edges), _sids(cfg), ring, cfg.source)
    state = scratch.cut(state, "init")
    return fixpoint.relax(state, _first_frontier(state, ring), edges, ring, scratch)[0]


def _all_snapshots(base: DataFrame, sids: list[int]) -> DataFrame:
    return base.select(F.explode(F.array(*[F.lit(s) for s in sids])).alias("sid"), "v", "val")


def _spread(state: DataFrame, first_edges: DataFrame, edges: DataFrame, ring: Semiring, scratch: Scratch, few: bool = False) -> DataFrame:
    """One pass of every reached value over first_edges, then rounds over edges."""
    return fixpoint.relax(state, _first_frontier(state, ring), edges, ring, scratch, first_edges=first_edges, few=few)[0]


def common_graph(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """Converge once on the edges that all snapshots share, then only add edges to each."""
    base = scratch.cut(fixpoint.dense_state(evolve.vertices(edges), [0], ring, cfg.source), "init")
    shared = evolve.common_edges(edges, cfg.snapshots)
    base = fixpoint.relax(base, _first_frontier(base, ring), shared, ring, scratch, within_lifetime=False)[0]
    state = scratch.cut(_all_snapshots(base, _sids(cfg)), "replicated")
    return _spread(state, evolve.noncommon_edges(edges, cfg.snapshots), edges, ring, scratch)


def concurrent_common_graph(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """The common graph once, then all snapshots together on compressed state: overrides of the shared values alone are kept.

    Edges that cannot improve any snapshot are left out of the first pass.
    """
    v = evolve.vertices(edges)
    base = scratch.cut(fixpoint.dense_state(v, [0], ring, cfg.source), "init")
    base = fixpoint.relax(base, _first_frontier(base, ring), evolve.common_edges(edges, cfg.snapshots), ring, scratch, within_lifetime=False)[0].select("v", "val")
    state = scratch.cut(_all_snapshots(base, _sids(cfg)), "replicated")
    extra = bounded_edges(evolve.noncommon_edges(edges, cfg.snapshots), state, ring)
    sent = fixpoint.candidates(_first_frontier(state, ring), extra, ring).join(base, "v")
    overrides = scratch.cut(sent.where(ring.improves(F.col("new"), F.col("val"))).select("sid", "v", F.col("new").alias("val")), "overrides")
    overrides = fixpoint.relax_compressed(base, overrides, overrides, edges, ring, scratch)
    return fixpoint.expand(base, overrides, _sids(cfg))


def incremental(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """Snapshot after snapshot; deletions repair the dependency forest."""
    first = evolve.snapshot_edges(edges, 0)
    state = scratch.cut(dependency.start(evolve.vertices(edges), ring, cfg.source), "init")
    state = dependency.relax(state, state, first, ring, scratch)
    done = [state.select(F.lit(0).alias("sid"), "v", "val")]
    for s in range(1, cfg.snapshots + 1):
        state = dependency.advance(
            state, evolve.snapshot_edges(edges, s), edges.where((F.col("snap_a") == s) & (F.col("snap_d") > s)), edges.where((F.col("snap_d") == s) & (F.col("snap_a") < s)), ring, cfg.source, scratch
        )
        done.append(state.select(F.lit(s).alias("sid"), "v", "val"))
    return reduce(DataFrame.unionByName, done)


def proxy_two_stage(edges: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """Warm start on a small proxy graph, one bound-pruned pass over all edges, then rounds.

    Vertices that no path from the source leads to keep their initial value. If the others have few edges, roots, proxy graph and rounds
    are theirs, and rounds are done by workers.
    """
    degrees = scratch.cut(evolve.out_degree(edges), "degrees")
    near = whole.reached_edges(edges, degrees, cfg.source, scratch) if ring.sourced and ring.arrays else None
    if near is None:
        return _two_stage(edges, degrees, ring, cfg, scratch, False)
    state = _two_stage(near, scratch.cut(evolve.out_degree(near), "degrees"), ring, cfg, scratch, True).where(ring.reached(F.col("val")))
    grid = degrees.select(F.explode(F.array(*[F.lit(s) for s in _sids(cfg)])).alias("sid"), "v")
    return grid.join(light(state, state.count()), ["sid", "v"], "left").select("sid", "v", F.coalesce("val", F.lit(ring.start).cast("long")).alias("val"))


def _two_stage(edges: DataFrame, degrees: DataFrame, ring: Semiring, cfg: EvolveConfig, scratch: Scratch, few: bool) -> DataFrame:
    proxy = scratch.cut(proxy_edges(edges, ring, cfg, scratch, degrees, few), "proxy")
    base = scratch.cut(fixpoint.dense_state(degrees.select("v"), [0], ring, cfg.source), "init")
    base = fixpoint.relax(base, _first_frontier(base, ring), evolve.common_edges(proxy, cfg.snapshots), ring, scratch, within_lifetime=False, few=few)[0]
    state = scratch.cut(_all_snapshots(base, _sids(cfg)), "replicated")
    state = _spread(state, evolve.noncommon_edges(proxy, cfg.snapshots), proxy, ring, scratch, few)
    return _spread(state, bounded_edges(edges, state, ring), edges, ring, scratch, few)


STRATEGIES = {"reevaluate": reevaluate, "commongraph": common_graph, "concurrent": concurrent_common_graph, "incremental": incremental, "proxy": proxy_two_stage}
