"""Ad-hoc SQL over distributions: any number of named frames, one Spark SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, views: dict[str, DataFrame], sql: str, display_limit: int | None = None) -> DataFrame:
    """Result of a statement over temporary views; ``display_limit`` caps a preview."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    return out if display_limit is None else out.limit(display_limit)
