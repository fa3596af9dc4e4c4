"""Fixpoints over few edges: a worker holds all edges of a snapshot or of a root and runs the rounds itself.

The rounds are those of fixpoint.relax() and dependency.relax(), over arrays: what the vertices that improved in the last round
send is compared with what its receivers have. Snapshots and roots do not touch, so each is a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph import session
from tidegraph.functions import bits
from tidegraph.functions.semiring import Semiring
from tidegraph.session import Scratch, light


def reached_edges(edges: DataFrame, degrees: DataFrame, source: int, scratch: Scratch) -> DataFrame | None:
    """All edges that leave the vertices which a path from ``source`` leads to, whatever their lifetimes; None if vertices or edges are many.

    Breadth-first: a round writes the edges of the vertices met in the round before, so each is written once. ``degrees`` tell how many
    these are before a round reads the edges.
    """
    cols = ["src", "dst", "w", "snap_a", "snap_d"]
    front, parts, met, rows = edges.sparkSession.range(source, source + 1).select(F.col("id").alias("v")), [], [], 0
    vertices = n = 1
    while n:
        rows += degrees.join(light(front, n), "v").agg(F.sum("degree").alias("n")).first()["n"] or 0
        if vertices > session.LIGHT or rows > session.FEW:
            return None
        parts.append(scratch.cut(edges.select(cols).join(light(front, n), F.col("src") == F.col("v"), "left_semi"), "leaving"))
        met.append(front)
        known = scratch.together(met, ["v"])
        front = scratch.cut(parts[-1].select(F.col("dst").alias("v")).distinct().join(light(known, vertices), "v", "left_anti"), "met")
        n = front.count()
        vertices += n
    out = scratch.together(parts, cols)
    unfit = out.where("dst is null or w is null").count()
    return None if unfit else scratch.cut(out.coalesce(out.sparkSession.sparkContext.defaultParallelism), "near")


def values(state: DataFrame, edges: DataFrame, ring: Semiring, within_lifetime: bool = True) -> DataFrame:
    """(sid, v, val) of all that is reached from the reached rows of ``state``; a task per snapshot."""
    extend, maximise, start = ring.arrays, ring.maximise, ring.start

    def run(state: pa.Table, edges: pa.Table) -> pa.Table:
        g = _Graph(state, edges)
        val = np.full(len(g.ids), start, dtype=np.int64)
        front = g.at(_array(state, "v"))
        val[front] = _array(state, "val")
        while len(front):
            e = g.leaving(front)
            to, new = g.dst[e], extend(val[g.src[e]], g.w[e])
            better = new > val[to] if maximise else new < val[to]
            (np.maximum if maximise else np.minimum).at(val, to[better], new[better])
            front = np.unique(to[better])
        met = val != start
        return pa.table({"sid": pa.repeat(state["sid"][0], int(met.sum())), "v": g.ids[met], "val": val[met]})

    alive = bits.alive(F.col("sid")) if within_lifetime else F.lit(True)
    return _by("sid", state.select("sid", "v", "val"), edges, alive, ring, run, "sid int, v long, val long")


def forest(state: DataFrame, edges: DataFrame, ring: Semiring) -> DataFrame:
    """(k, v, val, level, parent) of all that is reached from the reached rows of ``state``; a task per run ``k``."""
    extend, maximise, start = ring.arrays, ring.maximise, ring.start

    def run(state: pa.Table, edges: pa.Table) -> pa.Table:
        g = _Graph(state, edges)
        n = len(g.ids)
        val, level, parent, tied = np.full(n, start, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        front = g.at(_array(state, "v"))
        val[front], level[front], tied[front] = _array(state, "val"), _array(state, "level"), state["parent"].is_valid().to_numpy()
        parent[front] = state["parent"].fill_null(0).to_numpy()
        while len(front):
            e = g.leaving(front)
            s, to, new = g.src[e], g.dst[e], extend(val[g.src[e]], g.w[e])
            better = new > val[to] if maximise else new < val[to]
            s, to, new = s[better], to[better], new[better]
            # best value, then lowest level, then lowest parent: places in ids are in the order of ids
            order = np.lexsort((s, level[s], -new if maximise else new, to))
            first = order[np.r_[True, to[order][1:] != to[order][:-1]]] if len(order) else order
            s, front = s[first], to[first]
            val[front], level[front], parent[front], tied[front] = new[first], level[s] + 1, g.ids[s], True
        met = val != start
        return pa.table(
            {
                "k": pa.repeat(state["k"][0], int(met.sum())),
                "v": g.ids[met],
                "val": val[met],
                "level": level[met].astype(np.int32),
                "parent": pa.array(parent[met], mask=~tied[met]),
            }
        )

    return _by("k", state.select("k", "v", "val", "level", "parent"), edges, F.lit(True), ring, run, "k long, v long, val long, level int, parent long")


def _by(key: str, state: DataFrame, edges: DataFrame, holds: Column, ring: Semiring, run, schema: str) -> DataFrame:
    state = state.where(ring.reached(F.col("val")))
    of_each = edges.crossJoin(F.broadcast(state.select(key).distinct())).where(holds)
    of_each = of_each.select(F.col(key).alias("_by"), "src", "dst", F.col("w").cast("long").alias("w"))  # cogroup() takes no column for both sides

    def whole(state: pa.Table, edges: pa.Table) -> pa.Table:
        with np.errstate(divide="raise"):  # as in SQL
            return run(state, edges)

    return state.groupBy(key).cogroup(of_each.groupBy("_by")).applyInArrow(whole, schema)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


class _Graph:
    """Edges by their first end, ends as places in the sorted ids."""

    def __init__(self, state: pa.Table, edges: pa.Table) -> None:
        src, dst = _array(edges, "src"), _array(edges, "dst")
        self.ids = np.unique(np.concatenate([_array(state, "v"), src, dst]))
        place = self.at(src)
        order = np.argsort(place, kind="stable")
        self.src, self.dst, self.w = place[order], self.at(dst)[order], _array(edges, "w")[order]
        self.first = np.searchsorted(self.src, np.arange(len(self.ids) + 1))

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def leaving(self, front: np.ndarray) -> np.ndarray:
        """Places of the edges that leave the vertices ``front``."""
        n = self.first[front + 1] - self.first[front]
        return np.repeat(self.first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
