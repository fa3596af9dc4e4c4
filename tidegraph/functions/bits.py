"""Lifetimes, snapshot bitmaps and integer hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_MODULUS = 1000003


def alive(sid: Column | int, snap_a: str = "snap_a", snap_d: str = "snap_d") -> Column:
    """True where the half-open lifetime holds snapshot sid."""
    sid = F.lit(sid) if isinstance(sid, int) else sid
    return (F.col(snap_a) <= sid) & (sid < F.col(snap_d))


def bitmap(snapshots: int, snap_a: str = "snap_a", snap_d: str = "snap_d") -> Column:
    """Bit s is set when the edge lives in snapshot s, 0 <= s <= snapshots <= 62."""
    end = F.least(F.col(snap_d), F.lit(snapshots + 1))
    # as many low ones as snapshots in the lifetime (1..63), moved up; a difference of powers would overflow at bit 62
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(64) - (end - F.col(snap_a)))
    return F.when(F.col(snap_a) < end, F.call_function("shiftleft", ones, F.col(snap_a))).otherwise(F.lit(0).cast("long"))


def bit_alive(sid: Column | int, mask: str = "bitmap") -> Column:
    """Snapshot predicate on a bitmap column."""
    sid = F.lit(sid) if isinstance(sid, int) else sid
    return F.call_function("bit_get", F.col(mask), sid.cast("int")) == 1


def all_alive(snapshots: int, mask: str = "bitmap") -> Column:
    """True where the edge lives in every snapshot."""
    full = (1 << (snapshots + 1)) - 1
    return F.col(mask).bitwiseAND(F.lit(full).cast("long")) == F.lit(full).cast("long")


def common(snapshots: int, snap_a: str = "snap_a", snap_d: str = "snap_d") -> Column:
    """The same predicate on lifetimes; both comparisons reach a parquet scan."""
    return (F.col(snap_a) == 0) & (F.col(snap_d) > snapshots)


def edge_hash(seed: int, u: str = "u", v: str = "v") -> Column:
    """Order key in 0..HASH_MODULUS-1 in integer arithmetic that any SQL engine repeats; ids of any size."""
    part = lambda c: F.col(c) % HASH_MODULUS
    return F.pmod(part(u) * 7919 + part(v) * 104729 + F.lit(seed * 1299709).cast("long"), F.lit(HASH_MODULUS).cast("long"))


def weight(modulus: int, src: str = "src", dst: str = "dst") -> Column:
    """Synthetic weight of an edge; symmetric in its ends."""
    return ((F.col(src) + F.col(dst)) % modulus + 1).cast("int")
