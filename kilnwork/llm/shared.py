"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine, as in tests, a temporary one where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kilnwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: later failures don't reach behind it."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kilnwork/{spark.sparkContext.applicationId}"


def drop_all_stored(spark: SparkSession) -> None:
    """Remove every table that this application stored. Results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of text in one Arrow batch: with texts of a few KB a batch stays at a few MB, on both sides of the pipe.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, if they are larger, so that whole texts don't pile up in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: Bytes of text that a training sample has at most.
SAMPLE_BYTES = 64 << 20


def sample_texts(docs: DataFrame, some: DataFrame, label: str, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, label) of the rows of ``docs`` (doc_id, text) that ``some`` (doc_id, label; a bounded number of rows) names, in
    the order of the ids' hashes as far as their texts have most_bytes together."""
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    kept = sizes.withColumn("running", running).where(F.col("running") <= most_bytes).select("doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(some.join(kept, "doc_id")), "doc_id").orderBy("doc_id", label, F.xxhash64("text")).select("text", label)
