"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens; tier two is a cache in each
worker, filled by encoding what misses. Pre-tokens are never shuffled: the frequent ones are found with
bounded heavy-hitter summaries, one per partition over all of its texts, that merge in a tree.
The table has at most ``entries`` entries of PIECE_CHARS characters, about 2 MB whatever the input is, and
never changes a count.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
an empty table gives an empty result; special strings inside texts are encoded as the library does by default.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.encoders import encoder

ENTRIES = 8192
#: Counters a summary holds while it runs; the smaller half goes when they are full.
HELD = 1 << 17
#: Longer pre-tokens never enter the table.
PIECE_CHARS = 64
FAN_IN = 32


def _summary(held: Counter, entries: int):
    import numpy as np
    import pyarrow as pa

    top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:entries]
    counts = np.array([n for _, n in top], "<i8").tobytes()
    return pa.RecordBatch.from_pydict({"pieces": ["\0".join(p for p, _ in top)], "counts": pa.array([counts], pa.binary())})


def _unpack(pieces: str, counts: bytes) -> Counter:
    import numpy as np

    return Counter(dict(zip(pieces.split("\0"), np.frombuffer(counts, "<i8").tolist(), strict=True))) if counts else Counter()


def frequent(docs: DataFrame, path: str, entries: int = ENTRIES) -> list[tuple[str, int]]:
    """Frequent pre-tokens, at most ``entries``, heaviest first."""

    def count(batches):
        enc, held = encoder(path), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for p in (enc.pieces(t) if t else None) or ():
                    if len(p) <= PIECE_CHARS and "\0" not in p:
                        held[p] += 1
                if len(held) > HELD:
                    held = Counter(dict(held.most_common(HELD // 2)))
        yield _summary(held, entries)

    def join(batches):
        held = Counter()
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update(_unpack(p, n))
                held = Counter(dict(held.most_common(2 * entries)))
        yield _summary(held, entries)

    kind = "pieces string, counts binary"
    parts = docs.select("text").mapInArrow(count, kind)
    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(join, kind)
    held = Counter()
    for r in parts.collect():  # at most FAN_IN summaries of bounded size, made by one job in parallel
        held.update(_unpack(r.pieces, bytes(r.counts)))
        held = Counter(dict(held.most_common(2 * entries)))
    return sorted(held.items(), key=lambda x: (-x[1], x[0]))[:entries]


def token_counts(docs: DataFrame, path: str, limit: int = 512, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    spark = docs.sparkSession
    top = [p for p, _ in frequent(docs, path, entries)]
    table = dict(zip(top, encoder(path).values(top), strict=True)) if top else {}
    shared = spark.sparkContext.broadcast(table)

    def count(batches):
        import pyarrow as pa

        enc = encoder(path)
        enc.preload(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(enc.values(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
