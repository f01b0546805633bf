"""From raw documents to token ids: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes the rows that its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last one returns each document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import bpe, decontaminate, near_dedup, quality, secrets
from kilnwork.llm.registry import QUALITY_GRADE, QUALITY_LEAST, tokenizer_path
from kilnwork.llm.shared import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, model, QUALITY_GRADE, QUALITY_LEAST)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, at five words and 80 percent."""
    return near_dedup.deduplicated(docs, near_dedup.Settings())


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number and the digest of their decoding."""
    return bpe.encode_documents(docs, tokenizer_path(spark), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
