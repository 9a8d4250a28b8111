"""Corpus preparation: toxic documents go, then repeated lines, near copies and documents with benchmark passages; what is
left is encoded. Every stage writes Parquet that the next one reads as its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.decontaminate import drop_contaminated
from cohortlens.llm.line_dedup import dedup_lines
from cohortlens.llm.ngram_jaccard import one_of_each
from cohortlens.llm.sentencepieces import with_pieces
from cohortlens.llm.shared import stored
from cohortlens.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. It is fitted on the labelled ones among those at hand."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 of their five-word shingles, the one with the smallest id stays."""
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids."""
    return with_pieces(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

# A fitted model and a piece vocabulary are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
