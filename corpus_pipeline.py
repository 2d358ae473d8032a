"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Every stage gets all documents that the one before it kept; its result is
written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, near_dedup, quality_rules, sentencepiece
from loomgraph.llm._common import read_table, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzily equal lines the first stays; a document of which every line with words went is a copy and goes.

    ``n_chars`` follows the text.
    """
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least id stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark passages hold 5 % or more go; passages in others stay."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, which decode to its text again."""
    return sentencepiece.encode(docs, sentencepiece.Model.load())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination), ("sentencepiece", tokens)]

#: Connected components and unigram segmentation are beyond SQL; the tests hold run() to what planted documents must give; there is no brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
