"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) get the weights in turn. Targets share ``ratio`` times
all words by weight; a target stops at ``cap`` times its source's size and the excess is reshared
by weight among the others until none is above. A source's documents are taken whole
``floor(target / size)`` times; the rest of the target is filled with one more copy of documents in
seeded hash order, up to the one that straddles the quota, which is taken if at least half of it fits.

Defined cases: null text has size 0; a source of size 0 has target 0 and takes nothing; repeated
rows and rows that share a doc_id share a hash and are taken alike; an empty table gives an empty
result; a very long text is counted by one expression, without Python. Extra columns of the input are kept; the added ones carry a ``mix_`` prefix, and
underscores behind the name where the input has that name already (names()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.tables import fresh
from tidegraph.session import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, doc_id: str = "doc_id") -> Column:
    """Position of a document in the seeded order of its source."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name)), F.lit(":"), name)


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(mix_source, source_size) -> the same with weight and target.

    One aggregate row per round reaches the driver; each round caps at least one source or ends.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("mix_source"))) - 1
    table = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1))
    table = scratch.cut(table.withColumn("capped", F.lit(False)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        held, open_weight = table.agg(
            F.coalesce(F.sum(F.when(F.col("capped"), limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))
        ).first()
        share = F.lit(ratio * total - held) * F.col("weight") / F.lit(float(open_weight or 1))
        table = table.withColumn("target", F.when(F.col("capped"), limit).otherwise(share))
        above = (~F.col("capped")) & (F.col("target") > limit)
        if table.where(above).isEmpty():
            return scratch.cut(table.drop("capped"), "targets")
        table = scratch.cut(table.withColumn("capped", F.col("capped") | above).drop("target"), "capped")


def source_plan(docs: DataFrame, scratch: Scratch, seed: int = 17, weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(mix_source, source_size, weight, target, whole, cutoff): documents whose key is below ``cutoff`` get one copy more.

    Only sums of hash buckets are sorted for all documents (4096 per source); documents are
    ordered one by one in the bucket where the quota ends.
    """
    narrow = docs.select(F.col("source").alias("mix_source"), n_words().alias("size"), order_key(seed).alias("key"))
    narrow = scratch.cut(narrow.withColumn("bucket", F.substring("key", 1, 3)), "sizes")
    buckets = scratch.cut(narrow.groupBy("mix_source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    plan = targets(buckets.groupBy("mix_source").agg(F.sum("size").alias("source_size")), scratch, weights, ratio, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    same = lambda a, b: a["mix_source"].eqNullSafe(b["mix_source"])
    upto = Window.partitionBy("mix_source").orderBy("bucket")
    summed = buckets.withColumn("end", F.sum("size").over(upto))
    joined = summed.join(plan.select("mix_source", "need"), same(summed, plan)).drop(plan["mix_source"])
    first = joined.where(F.col("end") > F.col("need")).groupBy("mix_source", "need").agg(F.min(F.struct("bucket", (F.col("end") - F.col("size")).alias("before"))).alias("b"))
    first = scratch.cut(first.select(F.col("mix_source").alias("edge_source"), "need", F.col("b.bucket").alias("edge"), F.col("b.before").alias("before")), "edge")
    inside = narrow.join(F.broadcast(first) if first.count() <= BROADCAST_SOURCES else first, narrow["mix_source"].eqNullSafe(first["edge_source"]) & (F.col("bucket") == F.col("edge")))
    inside = inside.groupBy("mix_source", "key", "need", "before").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("mix_source").orderBy("key")) - F.col("size") + F.col("before")
    cut = inside.withColumn("run", run).where(F.col("run") * 2 + F.col("size") > F.col("need") * 2)
    cut = cut.groupBy(F.col("mix_source").alias("cut_source")).agg(F.min("key").alias("key_cut"))
    # where all of the bucket fits, the quota ends at its end
    out = plan.join(first, plan["mix_source"].eqNullSafe(first["edge_source"]), "left").join(cut, plan["mix_source"].eqNullSafe(cut["cut_source"]), "left")
    after = F.concat(F.col("edge"), F.lit("~"))
    out = scratch.cut(
        out.select("mix_source", "source_size", "weight", "target", "whole", F.when((F.col("source_size") > 0) & (plan["need"] > 0), F.coalesce("key_cut", after)).otherwise("").alias("cutoff")), "plan"
    )
    scratch.sweep(out)
    return out


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def names(columns: list[str]) -> dict[str, str]:
    """The names under which mix() adds its columns to a table of these columns."""
    return {x: fresh(columns, x) for x in ADDED}


def mix(docs: DataFrame, scratch: Scratch, seed: int = 17, weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (0..cap) for each document."""
    named = names(docs.columns)
    plan = source_plan(docs, scratch, seed, weights, ratio, cap)
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    sized = docs.select(row, F.col("source").alias("at"), n_words().alias("size"), order_key(seed).alias("key"))
    small = plan.count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(plan) if small else plan, sized["at"].eqNullSafe(plan["mix_source"]))
    copies = (F.col("whole") + F.when(F.col("key") < F.col("cutoff"), 1).otherwise(0)).cast("int")
    added = zip((F.col("size"), F.col("source_size"), F.col("target"), copies), ADDED, strict=True)
    return joined.select("row.*", *(c.alias(named[x]) for c, x in added))


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy, with the original columns. columns: those of the table that was mixed."""
    copies, mark = names(columns)["mix_copies"], fresh(mixed.columns, "mix_copy")
    return mixed.where(F.col(copies) > 0).withColumn(mark, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(columns)


def oracle_sql(seed: int = 17) -> str:
    return f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST) AS r FROM w),
l AS (SELECT *, (SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size * CAST(2 AS DOUBLE)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
f AS (SELECT rest, open, r FROM l WHERE rest * weight / CAST(open AS DOUBLE) <= source_size * CAST(2 AS DOUBLE) ORDER BY r LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN l.r < f.r THEN l.source_size * CAST(2 AS DOUBLE) ELSE f.rest * l.weight / CAST(f.open AS DOUBLE) END AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS need,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) - sum(d.size) OVER (PARTITION BY d.source, d.key) AS run, sum(d.size) OVER (PARTITION BY d.source, d.key) AS ksize
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN source_size > 0 AND run * 2 + ksize <= need * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k"""
