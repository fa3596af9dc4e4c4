"""The first rows in a total order, found without sending or sorting all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.bits import HASH_MODULUS

#: Order keys are hashes below HASH_MODULUS; so many slices of that range are counted side by side.
SLICES = 1024


def among_first(df: DataFrame, key: Column, ties: list[str], counts: list[int]) -> list[Column]:
    """For each of ``counts`` a condition that holds for as many rows of ``df``, the first by (key, ties); rows without a key come in none.

    Counts by slice of the key range (at most SLICES rows) tell in which slice the last of these rows lies; the rows of those
    slices alone are ranked, and the key of that row becomes part of the condition. So no row needs to move.
    """
    step = -(-HASH_MODULUS // SLICES)
    keyed = df.select(key.alias("_k"), *ties).where("_k is not null").withColumn("_slice", F.floor(F.col("_k") / step).cast("int"))
    sizes = sorted(keyed.groupBy("_slice").count().collect()) if max(counts) > 0 else []
    at: dict[int, tuple[int, int]] = {}
    before = 0
    for k, n in sizes:
        at |= {c: (k, c - before) for c in counts if before < c <= before + n}
        before += n
    last = {}
    if at:
        inside = Window.partitionBy("_slice").orderBy("_k", *ties)
        ranked = keyed.where(F.col("_slice").isin(sorted({k for k, _ in at.values()}))).withColumn("_n", F.row_number().over(inside))
        found = ranked.where(reduce(Column.__or__, ((F.col("_slice") == k) & (F.col("_n") == n) for k, n in set(at.values()))))
        last = {(r["_slice"], r["_n"]): [r["_k"], *(r[t] for t in ties)] for r in found.collect()}
    columns = [key, *map(F.col, ties)]
    return [F.lit(False) if c <= 0 else _not_after(columns, last[at[c]]) if c in at else key.isNotNull() for c in counts]


def _not_after(columns: list[Column], limit: list) -> Column:
    out = columns[-1] <= F.lit(limit[-1])
    for c, x in zip(columns[-2::-1], limit[-2::-1]):
        out = (c < F.lit(x)) | ((c == F.lit(x)) & out)
    return out
