"""Rounds of relaxation until no value improves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.functions import bits
from tidegraph.functions.semiring import Semiring
from tidegraph import session
from tidegraph.operators import whole
from tidegraph.session import Scratch, light


def dense_state(vertices: DataFrame, sids: list[int], ring: Semiring, source: int | None) -> DataFrame:
    """(sid, v, val) with the initial value of each vertex in each snapshot."""
    grid = vertices.select(F.explode(F.array(*[F.lit(s) for s in sids])).alias("sid"), "v")
    return grid.select("sid", "v", ring.initial(F.col("v"), source).alias("val"))


def sent(frontier: DataFrame, edges: DataFrame, ring: Semiring, within_lifetime: bool = True) -> DataFrame:
    """(sid, v, new): what the frontier (sid, v, val) sends along each edge.

    One pass over an edge serves all snapshots: sid is part of the key, not of the plan.
    """
    rows = frontier.join(edges, frontier.v == edges.src)
    if within_lifetime:
        rows = rows.where(bits.alive(F.col("sid")))
    return rows.select("sid", F.col("dst").alias("v"), ring.extend(F.col("val"), F.col("w")).cast("long").alias("new"))


def candidates(frontier: DataFrame, edges: DataFrame, ring: Semiring, within_lifetime: bool = True) -> DataFrame:
    """Best value that the frontier (sid, v, val) sends to each (sid, dst)."""
    return sent(frontier, edges, ring, within_lifetime).groupBy("sid", "v").agg(ring.best(F.col("new")).alias("new"))


def merge(state: DataFrame, arriving: DataFrame, ring: Semiring) -> DataFrame:
    """State after taking over better values; ``changed`` marks the next frontier."""
    both = state.select("sid", "v", "val").join(arriving, ["sid", "v"], "left")
    better = F.coalesce(ring.improves(F.col("new"), F.col("val")), F.lit(False))
    return both.select("sid", "v", F.when(better, F.col("new")).otherwise(F.col("val")).alias("val"), better.alias("changed"))


#: Tables of improvements that a fixpoint reads side by side before it makes them one.
OPEN_DELTAS = 8


def narrowed(edges: DataFrame, met: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The edges that leave the vertices ``v`` of ``met``, in a table of their own; None if these are many."""
    v = met.select(F.col("v").alias("_v")).distinct()
    n = v.count()
    if n > session.LIGHT:
        return None
    few = edges.select([c for c in ("src", "dst", "w", "snap_a", "snap_d") if c in edges.columns])
    return scratch.cut(few.join(light(v, n), F.col("src") == F.col("_v"), "left_semi"), "narrow")


def relax(
    state: DataFrame,
    frontier: DataFrame,
    edges: DataFrame,
    ring: Semiring,
    scratch: Scratch,
    within_lifetime: bool = True,
    max_rounds: int | None = None,
    first_edges: DataFrame | None = None,
    few: bool = False,
) -> tuple[DataFrame, int]:
    """Fixpoint over ``edges``; returns the state and the number of rounds.

    The first round goes over ``first_edges`` instead, if given. Each round is one job that writes only the rows that
    improved, which are the next frontier; an observation on that write counts them. What a vertex has (the state and the
    improvements so far) and what it is sent meet in one aggregation: one shuffle a round, combined before it, and no sort.
    A frontier of few rows is broadcast to the edges, which then stay where they are.
    Rows that nothing has reached stay out of the rounds: a vertex without a row there has the initial value.
    After the first round that reaches no new vertex, rounds read only the edges of the vertices reached so far, where those
    are few, until a round does reach a new one.
    Where the caller says that ``edges`` are ``few`` (no more than session.FEW), what follows the round over ``first_edges`` is one job,
    in which a worker does all rounds of a snapshot.
    """
    rounds, deltas, columns = 0, [], ["sid", "v", "val"]
    frontier = frontier.where(ring.reached(F.col("val")))
    n, narrow, tried = frontier.count(), None, not ring.sourced

    def latest(tables: list[DataFrame]) -> DataFrame:
        return scratch.together(tables, columns).groupBy("sid", "v").agg(ring.best(F.col("val")).alias("val"))

    while max_rounds is None or rounds < max_rounds:
        if few and (rounds or first_edges is None):
            deltas.append(scratch.cut(whole.values(latest([state, *deltas]), edges, ring, within_lifetime), "whole"))
            break
        seen = Observation()
        over = first_edges if first_edges is not None and not rounds else edges if narrow is None else narrow
        both = scratch.together([state, *deltas], columns).where(ring.reached(F.col("val"))).unionByName(sent(light(frontier, n), over, ring, within_lifetime), allowMissingColumns=True)
        met = both.groupBy("sid", "v").agg(ring.best(F.col("val")).alias("val"), ring.best(F.col("new")).alias("new"))
        better = met.where(ring.gains(F.col("new"), F.col("val"))).observe(seen, F.count("*").alias("n"), F.count_if(F.col("val").isNull()).alias("fresh"))
        frontier = scratch.cut(better.select("sid", "v", F.col("new").alias("val")), f"round{rounds}")
        rounds, n = rounds + 1, seen.get["n"]
        if not n:
            break
        deltas.append(frontier)
        if len(deltas) > OPEN_DELTAS:
            one = scratch.cut(latest(deltas), "improved")
            for d in deltas[:-1]:
                scratch.drop(d)
            deltas = [one]
        if seen.get["fresh"]:
            narrow = None
        elif not tried:
            tried, narrow = True, narrowed(edges, scratch.together([state, *deltas], columns).where(ring.reached(F.col("val"))), scratch)
    return (scratch.cut(latest([state, *deltas]), "relaxed") if deltas else state.select(columns)), rounds


def relax_compressed(base: DataFrame, overrides: DataFrame, frontier: DataFrame, edges: DataFrame, ring: Semiring, scratch: Scratch) -> DataFrame:
    """Fixpoint over compressed state: base (v, val), shared by all snapshots, and overrides (sid, v, val).

    A value that improves in a snapshot becomes an override there; no row is made for snapshots that keep the base value.
    Returns the overrides.
    """
    b = base.select("v", F.col("val").alias("base_val"))
    while True:
        seen = Observation()
        known = candidates(frontier, edges, ring).join(overrides.withColumnRenamed("val", "over"), ["sid", "v"], "left").join(b, "v")
        better = known.where(ring.improves(F.col("new"), F.coalesce("over", "base_val"))).select("sid", "v", F.col("new").alias("val"))
        frontier = scratch.cut(better.observe(seen, F.count("*").alias("n")), "improved")
        if not seen.get["n"]:
            return overrides
        overrides = scratch.cut(overrides.join(frontier, ["sid", "v"], "left_anti").unionByName(frontier), "overrides")


def min_max(state: DataFrame) -> DataFrame:
    """Extremes of a vertex over its snapshots."""
    return state.groupBy("v").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))


def settled(state: DataFrame) -> DataFrame:
    """Vertices whose value is the same in all snapshots."""
    return min_max(state).where("lo = hi").select("v", F.col("lo").alias("val"))


def compress(state: DataFrame, base: DataFrame) -> DataFrame:
    """Sparse overrides (sid, v, val): only rows that differ from base (v, val)."""
    b = base.select("v", F.col("val").alias("base_val"))
    return state.join(b, "v").where("val <> base_val").select("sid", "v", "val")


def expand(base: DataFrame, overrides: DataFrame, sids: list[int]) -> DataFrame:
    """Inverse of compress()."""
    grid = base.select(F.explode(F.array(*[F.lit(s) for s in sids])).alias("sid"), "v", F.col("val").alias("base_val"))
    o = overrides.select("sid", "v", F.col("val").alias("over"))
    return grid.join(o, ["sid", "v"], "left").select("sid", "v", F.coalesce("over", "base_val").alias("val"))
