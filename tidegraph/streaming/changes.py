"""Keeps a query's values current while change rows arrive.

``foreachBatch`` applies each micro-batch with the incremental operators and writes a version
of the state and of the alive edges named by the batch id, so a replayed batch overwrites its
own version and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.semiring import Semiring
from tidegraph.operators import dependency
from tidegraph.session import Scratch

CHANGE = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.IntegerType())])


class LiveQuery:
    """A semiring query over a graph that changes batch by batch."""

    def __init__(self, spark: SparkSession, ring: Semiring, source: int | None, vertices: DataFrame, edges: DataFrame, label: str = "live") -> None:
        self.spark, self.ring, self.source = spark, ring, source
        self.scratch = Scratch(spark, label)
        state = self.scratch.cut(dependency.start(vertices, ring, source), "init")
        state = dependency.relax(state, state, edges, ring, self.scratch)
        self._write(-1, state, edges.select("src", "dst", "w"))
        self.version = -1

    def _paths(self, version: int) -> tuple[str, str]:
        return f"{self.scratch.root}/state/v={version}", f"{self.scratch.root}/edges/v={version}"

    def _write(self, version: int, state: DataFrame, edges: DataFrame) -> None:
        s, e = self._paths(version)
        state.write.mode("overwrite").parquet(s)
        edges.write.mode("overwrite").parquet(e)

    def values(self, version: int | None = None) -> DataFrame:
        """(v, val) after a batch; -1 is the state before any."""
        return self.spark.read.parquet(self._paths(self.version if version is None else version)[0]).select("v", "val")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        s, e = self._paths(batch_id - 1)
        state, edges = self.spark.read.parquet(s), self.spark.read.parquet(e)
        batch = self.scratch.cut(batch.select("op", "src", "dst", "w"), "batch")
        added, deleted = batch.where("op = 'add'").drop("op").distinct(), batch.where("op = 'del'").select("src", "dst").distinct()
        alive = self.scratch.cut(edges.join(deleted, ["src", "dst"], "left_anti").unionByName(added).dropDuplicates(["src", "dst"]), "alive")
        known = state.select(F.col("v"))
        fresh = added.select(F.inline(F.array(F.struct(F.col("src").alias("v")), F.struct(F.col("dst").alias("v"))))).distinct().join(known, "v", "left_anti")
        state = self.scratch.cut(state.unionByName(dependency.start(fresh, self.ring, self.source)), "seeded")
        state = dependency.advance(state, alive, added, deleted, self.ring, self.source, self.scratch)
        self._write(batch_id, state, alive)
        self.version = batch_id

    def run(self, changes: DataFrame) -> None:
        """Consume all available change files, one micro-batch each."""
        query = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.scratch.root}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()


def change_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)
