"""Shared scratch space: where lineage is cut and intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of its own, since there driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Rows of a few numbers that go to every executor, some 30 MB; a join sends more by key. Spark's own limit goes by bytes of files.
LIGHT = 500_000

#: Edges that one worker holds, some 200 MB with the arrays it makes of them; a fixpoint over more is left to Spark's rounds.
FEW = 2_000_000


def light(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, of that many rows (None: not known), to be broadcast if they are few, so that the other side of a join stays where it is."""
    return F.broadcast(df) if rows is not None and rows <= LIGHT else df


#: Spark's setting by which a query's shuffle files are deleted as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch that a worker gets, about; Spark's own limit is 10,000 rows, whatever their length.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


class Scratch:
    """Tables written under the shared folder; each write ends a lineage."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.made: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        self.made.append(f"{self.root}/{self.count:03d}-{name}")
        return self.made[-1]

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write df and read it back: later plans start from files that survive lost executors."""
        path = self.path(name)
        df.write.parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    @contextmanager
    def lean(self):
        """Inside, each query deletes its shuffle files as it ends; else they stay until the driver happens to collect its garbage."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEANUP, before)

    @contextmanager
    def small_batches(self):
        """Inside, what cut() writes hands rows to Python workers in batches of BATCH_BYTES, unless the session names a size: a batch of long texts is held many times over."""
        before = self.spark.conf.get(BATCH, None)
        if before is None:
            self.spark.conf.set(BATCH, str(BATCH_BYTES))
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(BATCH)

    def together(self, tables: list[DataFrame], columns: list[str]) -> DataFrame:
        """These columns of all tables. Those that cut() wrote are read in one scan, so many small ones cost few tasks."""
        kinds = {c: k for c, k in tables[0].dtypes if c in columns}
        same = [t for t in tables if hasattr(t, "scratch_path") and kinds.items() <= dict(t.dtypes).items()]
        out = [t.select(columns) for t in tables if not any(t is s for s in same)]
        if same:
            schema = same[0].select(columns).schema
            out.append(self.spark.read.schema(schema).parquet(*(t.scratch_path for t in same)))
        return reduce(DataFrame.unionByName, out)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table written by cut()."""
        path = getattr(df, "scratch_path", None)
        if path:
            delete(self.spark, path)

    def sweep(self, *keep: DataFrame) -> None:
        """Delete all that was written here but the tables of ``keep``, which cut() gave: an operator calls it when nothing else will be read again."""
        stay = {df.scratch_path for df in keep}
        for path in self.made:
            if path not in stay:
                delete(self.spark, path)
        self.made = [p for p in self.made if p in stay]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
