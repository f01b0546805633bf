"""Session factory and the two facts that operators ask of a session: where shared files go, and how finely to deal out."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of estimated input that one task should hold.
TASK_BYTES = 32 << 20


def local_session(app: str = "kilnwork", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, in spark.checkpoint.dir; on one machine a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kilnwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/kilnwork/{spark.sparkContext.applicationId}"


def partitions_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of whole rows of ``df``: the session's setting, or more if the planner's size estimate asks for it."""
    spark = df.sparkSession
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(estimate / task_bytes), 1_000_000) if estimate < 1 << 60 else 1)
