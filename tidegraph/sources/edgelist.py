"""Edge lists: text (.el, .wel), little-endian binary (.bin) and parquet."""

from __future__ import annotations

import os
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import col

from tidegraph.functions.bits import edge_hash
from tidegraph.session import Scratch

HEADER = struct.Struct("<II")
ROW_BYTES = 8
ROWS_PER_BATCH = 1 << 18
SPLIT_ROWS = 1 << 23


class _Range(InputPartition):
    def __init__(self, path: str, start: int, rows: int) -> None:
        self.path, self.start, self.rows = path, start, rows


def _open(path: str):
    """An input file by URI or local path, seekable."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(os.path.abspath(path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _create(path: str):
    """An output file by URI or local path; its folder is made if need be."""
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner, compression=None)


class BinaryEdges(DataSource):
    """``spark.read.format("edge_bin").load(path)``: u32 vertices, u32 edges, then (u32, u32) rows.

    Splits by byte range, so one huge file is read by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "edge_bin"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return _BinaryReader(self.options["path"], int(self.options.get("splitrows", self.options.get("splitRows", SPLIT_ROWS))))


class _BinaryReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self):
        with _open(self.path) as f:
            _, rows = HEADER.unpack(f.read(HEADER.size))
            there = (f.size() - HEADER.size) // ROW_BYTES
        if rows > there:
            raise ValueError(f"{self.path}: the header promises {rows} edges, the file holds {there}")
        return [_Range(self.path, at, min(self.split, rows - at)) for at in range(0, rows, self.split)] or [_Range(self.path, 0, 0)]

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        with _open(part.path) as f:
            f.seek(HEADER.size + part.start * ROW_BYTES)
            left = part.rows
            while left:
                n = min(left, ROWS_PER_BATCH)
                pairs = np.frombuffer(f.read(n * ROW_BYTES), "<u4").reshape(-1, 2).astype("int64")
                left -= n
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryEdges)


def read_text(spark: SparkSession, path: str, comment: str = r"^\s*[%#]", weighted: bool = False) -> DataFrame:
    """Whitespace-separated ``src dst [w] [anything]`` lines; blank and comment lines are skipped, as is a header without ids.

    w is read if ``weighted``; a line without one has a null weight.
    """
    part = F.split(F.trim(col("value")), r"\s+")
    lines = spark.read.text(path).where(~col("value").rlike(comment))
    field = lambda i, kind, name: F.try_element_at(part, F.lit(i)).try_cast(kind).alias(name)
    ids = lines.select(field(1, "long", "src"), field(2, "long", "dst"), *([field(3, "int", "w")] if weighted else []))
    return ids.where("src is not null and dst is not null")


#: Extensions of weighted formats.
WEIGHTED = ("bwcsr", "wcsr", "wel")


def extension(path: str) -> str:
    """What follows the last dot of the file name; empty without one."""
    return os.path.splitext(path.rstrip("/"))[1].removeprefix(".").lower()


def is_weighted(path: str) -> bool:
    """Whether the extension stands for a format with weights."""
    return extension(path) in WEIGHTED


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) by file extension, and w of a weighted format."""
    kind = extension(path)
    if kind in ("el", "wel", "txt"):
        return read_text(spark, path, weighted=is_weighted(path))
    if kind == "bin":
        register(spark)
        return spark.read.format("edge_bin").load(path)
    if kind == "parquet":
        cols = spark.read.parquet(path)
        return cols.select(cols[cols.columns[0]].cast("long").alias("src"), cols[cols.columns[1]].cast("long").alias("dst"))
    raise ValueError(f"unsupported edge list: {path}")


def vertex_count(edges: DataFrame) -> int:
    """Ids are dense: one more than the largest."""
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if top is None else top + 1


def write_text(edges: DataFrame, path: str) -> None:
    """A folder of ``src<tab>dst[<tab>w]`` lines; with w if edges have it."""
    edges.select(F.concat_ws("\t", *(col(c).cast("string") for c in ("src", "dst", "w") if c in edges.columns)).alias("value")).write.text(path)


def write_binary(edges: DataFrame, path: str, scratch: Scratch, seed: int = 111) -> None:
    """Canonical distinct edges as one binary file (a URI or local path), in hash order.

    Tasks write the rows of their stretch of the order as headless pieces in the shared folder; the driver joins their bytes behind the header,
    a block at a time, and holds no rows.
    """
    pieces = scratch.path("pieces")
    und = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()

    def put(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        name, out, rows, top = f"{pieces}/{uuid.uuid4().hex}.rows", None, 0, -1
        for b in batches:
            if b.num_rows:
                out = out or _create(name)
                pairs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
                if pairs.min() < 0 or pairs.max() > 0xFFFFFFFF:
                    raise ValueError("the binary format holds ids from 0 to 4294967295")
                out.write(pairs.astype("<u4").tobytes())
                rows, top = rows + b.num_rows, max(top, int(pairs.max()))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n": pa.array([rows], pa.int64()), "top": pa.array([top], pa.int64())})

    ordered = und.withColumn("_h", edge_hash(seed)).repartitionByRange("_h", "u", "v").sortWithinPartitions("_h", "u", "v").select("u", "v")
    listed = scratch.cut(ordered.mapInArrow(put, "pid int, name string, n long, top long"), "listed").orderBy("pid").collect()  # a row per task
    with _create(path) as f:
        f.write(HEADER.pack(max((r["top"] + 1 for r in listed), default=0), sum(r["n"] for r in listed)))
        for r in listed:
            with _open(r["name"]) as piece:
                while block := piece.read(1 << 22):
                    f.write(block)
