"""Session settings, table reads and the size check that guards broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a fixed UTC clock; extra ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, as it is split.

    ``spark.millrace.scanPartitions.<table>`` deals that table to so many partitions after its scan,
    for files that have fewer row groups than the machine has cores; nothing is moved unless it is set.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    partitions = spark.conf.get(f"spark.millrace.scanPartitions.{name}", None)
    return df.repartition(int(partitions)) if partitions else df


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` is used when the session has one.
    ``fallback`` is for local tests only; without either the caller gets an error
    instead of a machine-local folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not configured and context.master.startswith("local"):
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(configured)
    return configured


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only while the size estimate stays below ``limit``.

    Above it the frame is returned as is and Catalyst joins by shuffle.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df
