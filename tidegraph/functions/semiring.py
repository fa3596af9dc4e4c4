"""The six path algebras. A user may add a Semiring of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.config import INF, ONE


@dataclass(frozen=True)
class Semiring:
    """``extend(value, weight)`` along an edge, the best of the arriving values at its end.

    ``start`` None means that each vertex starts with its own id and is active from the outset.
    ``extend`` must be monotone and never improve on its argument; then every strategy that
    relaxes all edges to a fixpoint from reachable values gives the same result.
    """

    name: str
    maximise: bool
    start: int | None
    at_source: int | None
    extend: Callable[[Column, Column], Column]
    #: The same extension as SQL text over {v} and {w} with integer division //.
    sql: str
    #: The same extension over numpy arrays of longs; without it all rounds are Spark's.
    arrays: Callable | None = None

    @property
    def sourced(self) -> bool:
        return self.start is not None

    def best(self, c: Column) -> Column:
        return F.max(c) if self.maximise else F.min(c)

    def better_of(self, a: Column, b: Column) -> Column:
        """Null-safe: a missing side loses."""
        return F.greatest(a, b) if self.maximise else F.least(a, b)

    def improves(self, new: Column, old: Column) -> Column:
        return new > old if self.maximise else new < old

    def reached(self, val: Column) -> Column:
        return val != self.start if self.sourced else F.lit(True)

    def gains(self, new: Column, old: Column) -> Column:
        """improves() where ``old`` is null for vertices that nothing has reached yet."""
        return self.improves(new, F.coalesce(old, F.lit(self.start).cast("long"))) if self.sourced else self.improves(new, old)

    def initial(self, v: Column, source: int | None) -> Column:
        if not self.sourced:
            return v.cast("long")
        return F.when(v == F.lit(source), F.lit(self.at_source).cast("long")).otherwise(F.lit(self.start).cast("long"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b.cast("long"))


SEMIRINGS: dict[str, Semiring] = {
    s.name: s
    for s in (
        Semiring("sssp", False, INF, 0, lambda v, w: v + w, "{v} + {w}", lambda v, w: v + w),
        Semiring("ssnp", False, INF, 0, lambda v, w: F.greatest(v, w.cast("long")), "greatest({v}, {w})", np.maximum),
        Semiring("sswp", True, 0, INF, lambda v, w: F.least(v, w.cast("long")), "least({v}, {w})", np.minimum),
        Semiring("viterbi", True, 0, ONE, _div, "{v} // {w}", np.floor_divide),
        Semiring("bfs", False, INF, 0, lambda v, w: v + 1, "{v} + 1", lambda v, w: v + 1),
        Semiring("cc", False, None, None, lambda v, w: v, "{v}"),
    )
}
