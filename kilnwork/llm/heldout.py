"""Prints how op2_toxicity and op7_quality do on labelled documents that they weren't fitted on: python -m kilnwork.llm.heldout FOLDER."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import quality, registry


def toxicity_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Held-out documents by label and prediction."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    found = registry.op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id")
    return {f"toxic {r['toxic']}, predicted {r['predicted']}": r["count"] for r in found.groupBy("toxic", "predicted").count().orderBy("toxic", "predicted").collect()}


def quality_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Held-out documents by label and decision, of a model fitted on the other labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, labels.where(~held))
    found = quality.score(docs, model, registry.QUALITY_GRADE, registry.QUALITY_LEAST).where(held).join(labels, "doc_id")
    return {f"quality {r['quality']}, keep {r['keep']}": r["count"] for r in found.groupBy("quality", "keep").count().orderBy("quality", "keep").collect()}


if __name__ == "__main__":
    from kilnwork.session import local_session

    session = local_session("held out")
    for where in sys.argv[1:]:
        print(where, toxicity_counts(session, where), quality_counts(session, where))
