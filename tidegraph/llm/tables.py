"""Joins whose small side is broadcast only after its size was checked, keys of rows, and names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes, that a table may have to be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _bytes(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, T.MapType):
        return F.greatest(F.size(c), F.lit(0)) * 24 + 16
    return F.lit(8)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; larger tables join by a shuffle. df must be cheap to read."""
    row = F.lit(16)
    for f in df.schema.fields:
        row = row + _bytes(f)
    n, held = df.agg(F.count("*"), F.sum(row.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most else df


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or name with as many underscores behind it as it takes to differ from all columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for the values of columns; nulls count, so a null differs from an empty string."""
    cols = [F.col(c) for c in columns]
    marks = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *marks).alias("k1"), F.xxhash64(F.lit(7919), *reversed(cols), *marks).alias("k2")]


def drop_rows(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are a row of gone, which has as many columns, distinct rows and no other columns.

    Keys may be null: null meets null. Texts move only if gone is too large to be broadcast.
    """
    names = []
    for i in range(len(keys)):
        names.append(fresh([*docs.columns, *names], f"_key{i}"))
    at = docs.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    right = checked(gone.toDF(*(f"{n}_gone" for n in names)))
    same = [at[n].eqNullSafe(right[f"{n}_gone"]) for n in names]
    return at.join(right, same, "left_anti").drop(*names)
