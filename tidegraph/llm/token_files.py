"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of a written corpus: for each partition, in ascending doc_id order, ``*.bin`` (ids, 16 bits
if the vocabulary allows, else 32, little-endian) and ``*.idx`` (magic, id width, documents, then
documents + 1 offsets relative to the partition, doc_ids, and one byte each that says if the doc_id is not null);
``manifest.json`` lists the partitions with their base, the prefix sum of the ids before them.
Offset of a document in the corpus = base + relative offset, a 64-bit integer.

Defined cases: null text gives the end id alone; null doc_ids come first; rows that share a doc_id
are ordered by text and may be split by its first characters; a very long text is one row in a worker; extra columns are ignored; an empty table gives a manifest without partitions and an empty result.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import files
from tidegraph.llm.encoders import encoder
from tidegraph.session import Scratch

MAGIC = b"TIDETOK1"
HEAD = 32


def write(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 2) -> str:
    """Writes the corpus under the shared folder; returns its URI.

    One shuffle by doc_id range; encoding happens behind it, as rows stream into the partition's
    files. A task that is run again writes files of another name; the manifest names those of the committed task.
    """
    spark = docs.sparkSession
    root = scratch.path("tokens")
    width = 2 if encoder(path).size <= 1 << 16 else 4
    kind = "pid int, name string, n_docs long, n_tokens long"

    def put(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path, width)
        end = np.array([end_id], f"<u{width}").tobytes()
        name, out, sizes, ids = files.attempt_name("part"), None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            out = out or files.create(f"{root}/{name}.bin")
            values = enc.values([t or "" for t in b.column("text").to_pylist()])
            sizes.append(np.array([len(v) // width + 1 for v in values], "<i8"))
            ids.append(b.column("doc_id"))
            out.write(end.join(values) + end)
        if out is None:
            return
        out.close()
        sizes, ids = np.concatenate(sizes), pa.chunked_array(ids, pa.int64())
        with files.create(f"{root}/{name}.idx") as f:
            f.write(MAGIC + np.array([width, len(sizes)], "<i8").tobytes())
            f.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
            f.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            f.write(ids.is_valid().to_numpy().astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": [len(sizes)], "n_tokens": [int(sizes.sum())]}
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the head of a text splits rows that share a doc_id, and keeps the order
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    with scratch.small_batches():
        parts = scratch.cut(rows.mapInArrow(put, kind), "parts")
    parts = parts.orderBy("pid").collect()  # a row per partition
    base, listed = 0, []
    for p in parts:
        listed.append({"name": p["name"], "base": base, "docs": p["n_docs"], "tokens": p["n_tokens"]})
        base += p["n_tokens"]
    with files.create(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": width, "end_id": end_id, "tokens": base, "parts": listed}).encode())
    return root


class Part:
    """A partition's files; ids are a view of the memory-mapped file."""

    def __init__(self, root: str, entry: dict) -> None:
        import numpy as np

        index = files.read_bytes(f"{root}/{entry['name']}.idx")
        if index[:8] != MAGIC:
            raise ValueError(f"{entry['name']}: not an index file")
        width, n = np.frombuffer(index, "<i8", 2, 8).tolist()
        self.offsets = np.frombuffer(index, "<i8", n + 1, 24)
        self.doc_ids = np.frombuffer(index, "<i8", n, 24 + 8 * (n + 1))
        self.known = np.frombuffer(index, "u1", n, 24 + 8 * (2 * n + 1)).astype(bool)
        self._file = files.open_input(f"{root}/{entry['name']}.bin")
        self.ids = np.frombuffer(self._file.read_buffer(), f"<u{width}")
        self.base = entry["base"]
        if len(self.ids) != self.offsets[-1] or len(self.ids) != entry["tokens"]:
            raise ValueError(f"{entry['name']}: index and ids disagree")

    def document(self, i: int):
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def manifest(root: str) -> dict:
    return json.loads(files.read_bytes(f"{root}/manifest.json"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a task per partition file."""
    listed = manifest(root)["parts"]

    def get(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                part = Part(root, listed[k])
                crc = [zlib.crc32(part.document(i).astype("<u4").tobytes()) for i in range(len(part.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.doc_ids, pa.int64(), mask=~part.known), pa.array(part.offsets[:-1] + part.base), pa.array(np.diff(part.offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.one_per_task(spark, len(listed)).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")
