"""Validated settings of an evolving-graph run."""

from __future__ import annotations

from dataclasses import dataclass

#: Beyond all distances: the value of unreached vertices, and the width of the source. No sum of weights comes near it.
INF = 1 << 62
#: Fixed values of the data model: the unit of a Viterbi probability and the end of an edge that is never deleted.
ONE = 32767
NEVER = 2147483647
MAX_SNAPSHOTS = 62


@dataclass(frozen=True)
class EvolveConfig:
    """Rates are percentages of the undirected edge count; snapshots are numbered 0..snapshots."""

    snapshots: int = 4
    init_percent: float = 50.0
    add_percent: float = 5.0
    del_percent: float = 5.0
    seed: int = 999
    weight_modulus: int = 50
    source: int = 2
    degree_limit: int = 800
    roots: int = 10

    def __post_init__(self) -> None:
        if not 0 <= self.snapshots <= MAX_SNAPSHOTS:
            raise ValueError(f"snapshots must be within 0..{MAX_SNAPSHOTS}")
        for name in ("init_percent", "add_percent", "del_percent"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be a percentage")
        if self.weight_modulus < 1:
            raise ValueError("weight_modulus must be positive")

    def sizes(self, edges: int) -> tuple[int, int, int]:
        """Undirected rows in the base graph, in each addition and in each deletion.

        The base is cut so that the additions of every snapshot fit behind it.
        """
        share = lambda p: int(edges * p / 100)
        return share(self.init_percent), share(self.add_percent), share(self.del_percent)
