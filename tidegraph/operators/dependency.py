"""States that remember where each value came from, and their repair after deletions.

A dependency state has rows (k, v, val, level, parent): k separates runs that share a plan
(roots, for instance). ``parent`` is null for roots and for vertices without a value of their
own. A parent changes only with a strict improvement, so the parents always form a forest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.functions.semiring import Semiring
from tidegraph.operators import whole
from tidegraph.operators.fixpoint import narrowed
from tidegraph.session import Scratch, light

NO_LEVEL = 2147483646
#: Tables of improvements that a fixpoint reads side by side before it makes them one.
OPEN_DELTAS = 8


def start(vertices: DataFrame, ring: Semiring, source: int | None) -> DataFrame:
    """The state before any relaxation for a single run (k = 0)."""
    val = ring.initial(F.col("v"), source)
    root = F.lit(True) if not ring.sourced else F.col("v") == F.lit(source)
    return vertices.select(F.lit(0).cast("long").alias("k"), "v", val.alias("val"), _root_level(root).alias("level"), F.lit(None).cast("long").alias("parent"))


def _root_level(root: Column) -> Column:
    return F.when(root, 0).otherwise(NO_LEVEL).cast("int")


def _order(ring: Semiring, val: Column) -> Column:
    return -val if ring.maximise else val


def sent(frontier: DataFrame, edges: DataFrame, ring: Semiring) -> DataFrame:
    """(k, v, b): what reached vertices send along each edge; b sorts by value, then level, then parent."""
    value = ring.extend(F.col("val"), F.col("w")).cast("long")
    arriving = F.struct(_order(ring, value).alias("o"), (F.col("level") + 1).cast("int").alias("level"), F.col("src").alias("parent"))
    rows = frontier.join(edges, frontier.v == edges.src).where(ring.reached(F.col("val")))
    return rows.select("k", F.col("dst").alias("v"), arriving.alias("b"))


def candidates(frontier: DataFrame, edges: DataFrame, ring: Semiring) -> DataFrame:
    """Best arriving (val, level, parent) per (k, vertex): best value, then lowest level, then lowest parent."""
    best = sent(frontier, edges, ring).groupBy("k", "v").agg(F.min("b").alias("b"))
    return best.select("k", "v", _order(ring, F.col("b.o")).alias("new"), F.col("b.level").alias("new_level"), F.col("b.parent").alias("new_parent"))


def merge(state: DataFrame, arriving: DataFrame, ring: Semiring) -> DataFrame:
    """State after taking over better values; ``changed`` marks them."""
    both = state.select("k", "v", "val", "level", "parent").join(arriving, ["k", "v"], "left")
    better = F.coalesce(ring.improves(F.col("new"), F.col("val")), F.lit(False))
    pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select("k", "v", pick("new", "val"), pick("new_level", "level"), pick("new_parent", "parent"), better.alias("changed"))


def _cut_counting(df: DataFrame, scratch: Scratch, name: str, counted: Column) -> tuple[DataFrame, int]:
    seen = Observation()
    out = scratch.cut(df.observe(seen, F.coalesce(F.sum(counted.cast("long")), F.lit(0)).alias("n")), name)
    return out, seen.get["n"]


STATE = ("k", "v", "val", "level", "parent")


def relax(state: DataFrame, frontier: DataFrame, edges: DataFrame, ring: Semiring, scratch: Scratch, few: bool = False) -> DataFrame:
    """Rounds over ``edges`` (all of them alive) until nothing improves; each writes only what improved, the state is written at the end.

    As in fixpoint.relax(), what a vertex has and what it is sent meet in one aggregation, which rows that nothing has reached stay out of,
    and once no new vertex is reached, only the edges of those reached are read, where they are few.
    Where the caller says that all ``edges`` are ``few`` (no more than session.FEW), a worker does all rounds of a run ``k``.
    """
    if few:
        return scratch.cut(whole.forest(state, edges, ring), "whole")
    deltas: list[DataFrame] = []
    frontier = frontier.where(ring.reached(F.col("val")))
    n, narrow, tried = frontier.count(), None, not ring.sourced

    def known(tables: list[DataFrame]) -> DataFrame:
        # a later row of a vertex is strictly better than an earlier one
        own = F.struct(_order(ring, F.col("val")).alias("o"), "level", "parent").alias("a")
        return scratch.together(tables, list(STATE)).select("k", "v", "val", own)

    def plain(rows: DataFrame, at: str) -> DataFrame:
        return rows.select("k", "v", _order(ring, F.col(f"{at}.o")).alias("val"), f"{at}.level", f"{at}.parent")

    def latest(tables: list[DataFrame]) -> DataFrame:
        return plain(known(tables).drop("val").groupBy("k", "v").agg(F.min("a").alias("a")), "a")

    while True:
        both = known([state, *deltas]).where(ring.reached(F.col("val"))).drop("val").unionByName(sent(light(frontier, n), edges if narrow is None else narrow, ring), allowMissingColumns=True)
        met = both.groupBy("k", "v").agg(F.min("a").alias("a"), F.min("b").alias("b"))
        seen = Observation()
        better = met.where(ring.gains(_order(ring, F.col("b.o")), _order(ring, F.col("a.o")))).observe(seen, F.count("*").alias("n"), F.count_if(F.col("a").isNull()).alias("fresh"))
        frontier = scratch.cut(plain(better, "b"), "dep")
        n = seen.get["n"]
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
            tried, narrow = True, narrowed(edges, known([state, *deltas]).where(ring.reached(F.col("val"))), scratch)
    return scratch.cut(latest([state, *deltas]), "relaxed") if deltas else state.select(*STATE)


def cut_by(deleted: DataFrame, state: DataFrame) -> DataFrame:
    """Vertices whose own tree edge is among the deleted ones."""
    d = deleted.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    return state.join(d, (F.col("v") == F.col("_d")) & (F.col("parent") == F.col("_s")), "left_semi").select("k", "v")


def subtree(state: DataFrame, cut: DataFrame, scratch: Scratch) -> DataFrame | None:
    """All descendants of ``cut`` in the forest, ``cut`` included; None if it is empty.

    Invalidation runs to its end before anything is pulled: a value must never come back from
    a descendant that is itself about to be reset. A vertex has one parent, so it is met a second time only if it is in
    ``cut`` itself: what was found before is not read again, and plans stay of one size at any depth.
    """
    cut, n = _cut_counting(cut, scratch, "cut", F.lit(1))
    level, paths = cut, []
    starts = cut.select(F.col("k").alias("_k"), F.col("v").alias("_v"))
    while n:
        paths.append(level.scratch_path)
        above = level.select(F.col("k").alias("_ka"), F.col("v").alias("_p"))
        below = state.join(above, (F.col("parent") == F.col("_p")) & (F.col("k") == F.col("_ka")), "left_semi").select("k", "v")
        below = below.join(starts, (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v")), "left_anti")
        level, n = _cut_counting(below, scratch, "below", F.lit(1))
    return state.sparkSession.read.schema(cut.schema).parquet(*paths) if paths else None


def reset(state: DataFrame, lost: DataFrame, ring: Semiring, source: int | None) -> DataFrame:
    """Lost vertices back at their initial value."""
    marked = state.join(lost.withColumn("_lost", F.lit(True)), ["k", "v"], "left")
    gone = F.col("_lost").isNotNull()
    root = F.lit(True) if not ring.sourced else F.col("v") == F.lit(source)
    return marked.select(
        "k",
        "v",
        F.when(gone, ring.initial(F.col("v"), source)).otherwise(F.col("val")).alias("val"),
        F.when(gone, _root_level(root)).otherwise(F.col("level")).alias("level"),
        F.when(~gone, F.col("parent")).alias("parent"),
    )


def advance(state: DataFrame, alive: DataFrame, added: DataFrame, deleted: DataFrame, ring: Semiring, source: int | None, scratch: Scratch) -> DataFrame:
    """The state of the next snapshot.

    alive: edges of the next snapshot, added ones included. Deleted tree edges invalidate their
    subtrees; these pull once from their alive neighbours while added edges push, in one pass;
    what improved then spreads.
    """
    lost = subtree(state, cut_by(deleted, state), scratch)
    edges = added.select("src", "dst", "w")
    if lost is not None:
        state = scratch.cut(reset(state, lost, ring, source), "reset")
        inward = alive.join(lost.select(F.col("v").alias("_v")), F.col("dst") == F.col("_v"), "left_semi")
        edges = edges.unionByName(inward.select("src", "dst", "w"))
    first, n = _cut_counting(merge(state, candidates(state, edges, ring), ring), scratch, "pull", F.col("changed"))
    return relax(first, first.where("changed"), alive, ring, scratch) if n else first.drop("changed")
