"""A corpus pipeline of five stages, each one of the operators of tidegraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it and hand what it
reads back to the next one. All but the last return the columns of documents. run() applies them to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, mixing, ngram_join, quality, token_files
from tidegraph.llm.queries import table, tokenizer_path
from tidegraph.session import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity band of their language."""
    return quality.keep(docs, Scratch(spark, "stage1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_each(docs, Scratch(spark, "stage2"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "stage3"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that sources meet their target weights."""
    return mixing.materialise(mixing.mix(docs, Scratch(spark, "stage4")), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token files, a row per document and copy."""
    return token_files.read(spark, token_files.write(docs, tokenizer_path(), Scratch(spark, "stage5")))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("mixing sources", mix_sources), ("token files", token_output)]

#: The perplexity bands and tokenizer of the stages have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; between stages rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage{k + 1}")
    return docs
