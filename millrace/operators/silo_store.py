"""A stored statistics silo: data and silos bucketed alike, so that a filter by statistics moves no text.

The data set and its silos are written once, bucketed and sorted by the record id into the same
number of buckets. A query then reads the filtered columns of the silo, with the filters at its
scan, and merges bucket with bucket: no exchange on either side, whatever the size of the data.

A bucket is one task, so an id that many records share must not lie in one. Ids with more records
than a fair bucket (there are fewer of them than buckets) are written to a table of their own, which
is read in plain splits and meets its silo rows by broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.stats_query import join_stats
from millrace.session import plan_bytes
from millrace.sources.sinks import write_bucketed

BUCKET_BYTES = 128 * 1024 * 1024
SILOS = ("low", "chat")


@dataclass(frozen=True)
class Store:
    """Names of the tables of one data set; ``key`` is the id column of the data, silos have ``id``."""

    name: str
    key: str = "_id_hash"

    def table(self, part: str, hot: bool = False) -> str:
        return f"{self.name}_{part}{'_hot' if hot else ''}"

    def exists(self, spark: SparkSession) -> bool:
        """The list of hot ids is written last, so a store that has it is whole."""
        return spark.catalog.tableExists(self.table("ids", True))


def bucket_count(data: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES``, one per core at least."""
    return max(data.sparkSession.sparkContext.defaultParallelism, math.ceil(plan_bytes(data) / BUCKET_BYTES))


def write_store(store: Store, folder: str, data: DataFrame, low: DataFrame, chat: DataFrame | None = None, buckets: int | None = None) -> None:
    """Write ``data`` and the silos below ``folder``. A silo has one row per id.

    Records with a null id are kept in the store but match no silo row, as in the join itself.
    """
    spark = data.sparkSession
    buckets = buckets or bucket_count(data)

    def place(part: str, hot: bool = False) -> str:
        return f"{folder.rstrip('/')}/{store.table(part, hot)}"

    counts = data.groupBy(store.key).agg(F.count("*").alias("records"))
    counts.write.parquet(place("counts"))
    counts = spark.read.schema(counts.schema).parquet(place("counts"))
    total = counts.agg(F.sum("records")).first()[0] or 0
    hot = counts.filter((F.col("records") > total / buckets) & F.col(store.key).isNotNull()).select(store.key)
    # More than a fair share each, so fewer ids than buckets: small enough to send to every task.
    known = F.broadcast(hot)
    write_bucketed(data.join(known, store.key, "left_anti"), store.table("data"), store.key, buckets, path=place("data"))
    data.join(known, store.key, "left_semi").write.option("path", place("data", True)).saveAsTable(store.table("data", True))
    for part, silo in zip(SILOS, (low, chat)):
        if silo is None:
            continue
        write_bucketed(silo, store.table(part), "id", buckets, path=place(part))
        of_hot = spark.table(store.table(part)).join(known, F.col("id") == F.col(store.key), "left_semi")
        of_hot.write.option("path", place(part, True)).saveAsTable(store.table(part, True))
    hot.write.option("path", place("ids", True)).saveAsTable(store.table("ids", True))


def join_store(
    spark: SparkSession, store: Store, filters: list[tuple] = (), custom: str | None = None,
    folder: str | None = None, keep: list[str] = (), chat: bool = False,
) -> DataFrame:
    """Data rows whose stored statistics pass; the arguments are those of ``stats_query.join_stats``.
    ``chat`` joins the conversation silo too."""

    def part(hot: bool) -> DataFrame:
        silos = [spark.table(store.table(name, hot)) for name in (SILOS if chat else SILOS[:1])]
        if hot:
            silos = [F.broadcast(s) for s in silos]
        return join_stats(spark.table(store.table("data", hot)), *silos, filters=filters, custom=custom, folder=folder, keep=keep, key=store.key)

    return part(False).unionByName(part(True))
