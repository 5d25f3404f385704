"""Intermediate results in the shared folder of the cluster."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ensure_checkpoint_dir


def folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends here, a lost
    executor costs no more than its running tasks, and later joins know the real size."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python worker of a pipeline stage gets at once, texts among them.
BATCH_ROWS = 1000


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session that hands its Python workers ``BATCH_ROWS`` rows at most. The setting
    stays, as the stage's result is computed later; a smaller one is left as it is."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run
