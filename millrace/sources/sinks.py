"""Layer columns and writers.

Writers go through Spark's committers: files appear when the job commits, so a lost
executor is retried without duplicates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as t

from millrace.constants import SUBPATH_LANG_CODES, UNKNOWN_LANG
from millrace.operators.sampling import hash_sample
from millrace.session import ensure_checkpoint_dir

QUERY_CHUNK_BYTES = 120 * 1024 * 1024
ROLLING_FILE_BYTES = 124 * 1024 * 1024


# ---- layer columns ----------------------------------------------------------------------
def stem(name: Column) -> Column:
    return F.substring_index(F.element_at(F.split(name, "/"), -1), ".", 1)


def processed_columns(df: DataFrame, distribution: Column | str = "", raw_prefix: str = "/data/raw", processed_prefix: str = "/data/processed") -> DataFrame:
    """Core fields of the processed layer; the language is a folder, not part of ``_subpath``."""
    inner = F.lit(distribution) if isinstance(distribution, str) else distribution
    return df.withColumns(
        {
            "_dataset_name": F.concat(F.lit("processed__"), F.trim(F.coalesce("_dataset_name", F.lit("")))),
            "_dataset_path": F.trim(F.replace(F.coalesce("_dataset_path", F.lit("")), F.lit(raw_prefix), F.lit(processed_prefix))),
            "_subpath": F.trim(F.trim(inner, F.lit("/"))),
            "_filename": F.concat(F.replace(stem(F.col("_filename")), F.lit("_processed"), F.lit("")), F.lit("_processed")),
            "_lang": F.coalesce(F.nullif(F.trim("_lang"), F.lit("")), F.lit(UNKNOWN_LANG)),
            "_id_hash": F.trim(F.coalesce("_id_hash", F.lit(""))),
        }
    )


def without_language(subpath: Column) -> Column:
    """A leading and a trailing language segment are dropped."""
    parts = F.split(subpath, "/")
    head = F.when(F.get(parts, F.lit(0)).isin(list(SUBPATH_LANG_CODES)), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    last = F.try_element_at(head, F.lit(-1)).isin(list(SUBPATH_LANG_CODES))
    kept = F.when(last, F.slice(head, F.lit(1), F.greatest(F.size(head) - 1, F.lit(0)))).otherwise(head)
    return F.array_join(kept, "/")


def mapped_columns(df: DataFrame) -> DataFrame:
    name = F.coalesce("_dataset_name", F.lit(""))
    marked = F.when(F.startswith(name, F.lit("mapped__")), name).otherwise(F.concat(F.lit("mapped__"), name))
    out = df.drop("file_path", "data", "metadata")
    return out.withColumns(
        {
            "_dataset_name": marked,
            "_subpath": without_language(F.coalesce("_subpath", F.lit(""))),
            "_filename": F.concat(stem(F.col("_filename")), F.lit("_mapped")),
            "_lang": F.coalesce("_lang", F.lit(UNKNOWN_LANG)),
        }
    )


def download_columns(df: DataFrame, base: str) -> DataFrame:
    """Names of hub datasets ``provider/dataset/config`` as layer fields."""
    parts = F.split("_dataset_name", "/")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    lang = F.coalesce("_lang", F.lit(UNKNOWN_LANG))
    return df.drop("_split").withColumns(
        {
            "_dataset_path": F.concat(F.lit(base.rstrip("/") + "/"), parts[0]),
            "_subpath": F.concat_ws("/", F.nullif(F.array_join(rest, "/"), F.lit("")), lang),
            "_dataset_name": F.replace("_dataset_name", F.lit("/"), F.lit("_")),
            "_lang": lang,
        }
    )


def derived_distribution(df: DataFrame, folder: str) -> DataFrame:
    """Catalog rows for saved query results; input is a distribution row with ``dataset_uri``,
    ``target_uri`` and ``executed``. ``new_dataset`` marks results outside the parent dataset."""
    outside = (F.col("dataset_uri") == F.col("uri")) | ~F.startswith(F.col("target_uri"), F.col("dataset_uri"))
    return df.select(
        F.concat(F.lit(f"query__{folder}__"), "name").alias("name"),
        F.col("target_uri").alias("uri"), F.col("id").alias("derived_from"), F.col("executed").alias("query"),
        "lang", "split", "license", F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit("query")).alias("tags"),
        F.lit(3).alias("step"), outside.alias("new_dataset"),
    )


# ---- JSON-safe values --------------------------------------------------------------------
def _safe(value: Column, kind: t.DataType) -> Column:
    if isinstance(kind, (t.DoubleType, t.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, t.DecimalType):
        return value.cast("double")
    if isinstance(kind, t.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (t.TimestampType, t.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, t.BinaryType):
        return value.cast("string")
    if isinstance(kind, t.ArrayType):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, t.MapType):
        keyed = F.transform_keys(value, lambda k, _: k.cast("string"))
        return F.transform_values(keyed, lambda _, v: _safe(v, kind.valueType))
    if isinstance(kind, t.StructType):
        return F.when(value.isNotNull(), F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to null, decimals to doubles, dates to ISO text, binary to text, map keys to text, at any depth."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# ---- writers -----------------------------------------------------------------------------
def write_records(df: DataFrame, path: str, extension: str = ".jsonl.gz", partition_by: list[str] = (), mode: str = "errorifexists", max_rows: int = 0) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if extension == ".jsonl.gz":
        writer.option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    elif extension == ".parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"unsupported output format {extension!r}")


def _with_folder(df: DataFrame, column: str) -> DataFrame:
    """A copy of a core field for the folder name, so that it also stays inside the record."""
    return df.withColumn(column.lstrip("_"), F.col(column))


def write_processed(df: DataFrame, target: str, distribution: str = "", extension: str = ".jsonl.gz") -> None:
    """``target/distribution/lang=xx``; one job, one folder per language."""
    out = _with_folder(processed_columns(df, distribution), "_lang")
    write_records(out, "/".join(x for x in (target.rstrip("/"), distribution.strip("/")) if x), extension, ["lang"])


def write_mapped(df: DataFrame, target: str, extension: str = ".jsonl.gz") -> None:
    """``target/subpath=…``; records keep their ``_subpath``."""
    write_records(_with_folder(mapped_columns(df), "_subpath"), target, extension, ["subpath"])


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and JSON bytes, from one aggregate."""
    row = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return row.n, row.b


def chunk_count(size: int, chunk: int = QUERY_CHUNK_BYTES) -> int:
    """Rounded up past half a chunk, otherwise down, at least one."""
    whole, part = divmod(size / chunk, 1)
    return max(1, math.ceil(size / chunk) if part > 0.5 else int(whole))


def write_query_result(df: DataFrame, path: str, chunk: int = QUERY_CHUNK_BYTES) -> int:
    """Save a query result in chunks whose name each record carries; returns the chunks
    written, 0 for an empty result, which is registered without files. An existing
    destination is an error. The query runs once; what it returns is kept in the shared
    checkpoint folder while it is measured and written."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    rows, size = measure(df)
    if rows == 0:
        return 0
    chunks = chunk_count(size, chunk)
    named = df.repartition(chunks).withColumn(
        "_filename", F.format_string("query_results_%05d.jsonl.gz", F.spark_partition_id() + 1)
    )
    write_records(named, path)
    return chunks


def write_rolling(df: DataFrame, path: str, extension: str = ".parquet", file_bytes: int = ROLLING_FILE_BYTES) -> None:
    """Files of about ``file_bytes``, by a row limit from the average row. The frame is computed
    once and kept in the shared checkpoint folder while it is measured and written."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    rows, size = measure(df)
    limit = max(1, int(file_bytes * rows / size)) if size else 0
    write_records(df, path, extension, max_rows=limit)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "errorifexists", path: str | None = None) -> None:
    """A table bucketed and sorted by key: two such tables join on it without a shuffle. With a
    ``path`` the files lie there, else in the warehouse."""
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_export(entries: DataFrame, path: str, fmt: str = "json") -> None:
    """A contract as JSON or CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unsupported export format {fmt!r}")
    writer = entries.write.mode("errorifexists")
    writer.json(path) if fmt == "json" else writer.option("header", "true").csv(path)


def materialize_sample(df: DataFrame, path: str, key: str, rate: float, seed: int | str = 0, extension: str = ".parquet") -> bool:
    """Write a down-sampled copy in rolling files; False when the folder holds one already."""
    spark = df.sparkSession
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(location) and len(files.listStatus(location)) > 0:
        return False
    write_rolling(hash_sample(df, key, rate, seed), path, extension)
    return True


def write_with_quarantine(applied: DataFrame, path: str, extension: str = ".jsonl.gz") -> dict[str, int]:
    """One job for a mapping result with its ``errors``: good rows below ``outcome=mapped``,
    the others with their errors below ``outcome=quarantined``. The counters are observed
    while writing, so nothing is computed twice."""
    good = F.size("errors") == 0
    counters = Observation("mapping")
    watched = applied.observe(
        counters, F.count(F.lit(1)).alias("read"), F.count(F.when(good, 1)).alias("mapped"), F.count(F.when(~good, 1)).alias("skipped")
    )
    write_records(watched.withColumn("outcome", F.when(good, "mapped").otherwise("quarantined")), path, extension, ["outcome"])
    return dict(counters.get)
