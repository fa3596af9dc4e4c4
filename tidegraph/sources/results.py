"""Result sinks: text rows, files, and the run log's timer lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.config import INF

TIMING = re.compile(r">>Processing finished in ([0-9.]+) \(ms\)\.")


def render(state: DataFrame, column: str = "val", first: int = 30, inf: int | None = INF) -> list[str]:
    """The first vertices as ``id value`` lines (a display, limited by nature); the sentinel reads INF."""
    return [r.line for r in lines(state, column, first, inf).collect()]


def lines(state: DataFrame, column: str = "val", first: int = 30, inf: int | None = INF) -> DataFrame:
    """(v, line) of the first vertices; a vertex without a parent, say, reads none."""
    shown = F.coalesce(F.col(column).cast("string"), F.lit("none"))
    if inf is not None:
        shown = F.when(F.col(column) == inf, "INF").otherwise(shown)
    return state.orderBy("v").limit(first).select("v", F.concat_ws(" ", F.col("v").cast("string"), shown).alias("line"))


def save(state: DataFrame, path: str, kind: str = "parquet") -> None:
    """All rows: parquet, csv, or text lines ``[sid] id value``."""
    if kind == "text":
        state.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("sid", "v", "val") if c in state.columns)).alias("value")).write.text(path)
    elif kind in ("parquet", "csv"):
        getattr(state.write, kind)(path)
    else:
        raise ValueError(f"unsupported result format: {kind}")


def processing_total(log: DataFrame) -> DataFrame:
    """(ms): sum of the timings in a table of log lines (value), of any size."""
    found = F.regexp_extract_all("value", F.lit(r">>Processing finished in ([0-9.]+) \(ms\)\."), 1)
    return log.select(F.explode(found).alias("ms")).agg(F.coalesce(F.sum(F.col("ms").cast("double")), F.lit(0.0)).alias("ms"))


def processing_ms(log: str) -> float:
    """Sum of the timings in a run log."""
    return sum(float(x) for x in TIMING.findall(log))
