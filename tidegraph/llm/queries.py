"""The opN queries: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import chat, decontaminate, language, mixing, ngram_join, quality, token_counts, token_files, toxicity, warc
from tidegraph.session import Scratch

#: File of the public byte-level BPE, found through the installed package; a parameter of the operators.
BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), Scratch(spark, "op1"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(table(spark, d, "documents"), tokenizer_path())


def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, d, "documents"), tokenizer_path(), Scratch(spark, "op3")))


def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "pages"), table(spark, d, "documents"), Scratch(spark, "op4"))


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    whole = warc.write_monolithic(warc.plan(table(spark, d, "pages"), scratch), scratch)
    got = warc.read_indexed(spark, warc.normalise(spark, whole, scratch))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.near_components(table(spark, d, "documents"), Scratch(spark, "op6"))


def op7_chat_windows(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    formatted = Scratch(spark, "op7").cut(chat.windows(turns.unionByName(probe), tokenizer_path()), "windows")
    return chat.digests(formatted)


def op8_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), Scratch(spark, "op8"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(table(spark, d, "documents"), Scratch(spark, "op10"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_token_files, op4_language_id, op5_warc, op6_ngram_jaccard, op7_chat_windows, op8_decontaminate, op9_toxicity, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE_SQL, "op10_mixing": mixing.oracle_sql()}
