"""Reading raw and standard records by format."""

from __future__ import annotations

import base64
import csv
import io
import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.operators.standardize import truncate_and_flatten
from millrace.session import broadcast_if_small, ensure_checkpoint_dir
from millrace.sources.listing import extension, list_files
from millrace.sources.stitch import array_items, delimited_records, text_lines
from millrace.sources.webpages import warc_responses

CORRUPT = "_corrupt_record"
QUARANTINE = "file string, value string"
PAGES_PER_BLOCK = 200
# Checked in this order, as parts of a file pattern.
FORMAT_OF = [
    ("jsonl", "json"), ("json", "json"), ("parquet", "parquet"), ("arrow", "arrow"), ("ipc", "arrow"),
    ("csv", "csv"), ("tsv", "tsv"), ("warc", "warc"),
]


def format_of(pattern: str) -> str:
    for part, name in FORMAT_OF:
        if part in pattern.lower():
            return name
    raise ValueError(f"no reader for {pattern!r}")


def detect_globs(spark: SparkSession, path: str) -> list[str]:
    """One pattern per extension below ``path`` that a reader exists for, in order. Only the
    distinct extensions reach the driver."""
    files = list_files(spark, path).select(extension(F.col("path")).alias("ext")).distinct()
    known = F.rlike("ext", F.lit("(?i)" + "|".join(part for part, _ in FORMAT_OF)))
    found = sorted(f"*{r.ext}" for r in files.filter(known).collect())
    if not found:
        raise ValueError(f"no readable file below {path}")
    return found


def detect_glob(spark: SparkSession, path: str) -> str:
    """Pattern of the first extension that a reader exists for."""
    return detect_globs(spark, path)[0]


def scan(
    spark: SparkSession, path: str, glob: str | None = None, schema: t.StructType | None = None,
    partitions: int | None = None, path_col: str | None = None,
) -> DataFrame:
    """Records below ``path``; :func:`scan_checked` also hands out what could not be read.

    ``partitions`` spreads compressed files, which do not split; ``path_col`` names a column for the
    file each record comes from. Without a pattern the files of every known format are read, and
    columns that one of them lacks are null."""
    return scan_checked(spark, path, glob, schema, partitions, path_col)[0]


def scan_checked(
    spark: SparkSession, path: str, glob: str | None = None, schema: t.StructType | None = None,
    partitions: int | None = None, path_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records below ``path`` and the quarantine ``(file, value)`` of unreadable ones. Binary formats
    are checked by their readers, which fail; they add nothing to the quarantine."""
    if glob is None:
        parts = [scan_checked(spark, path, g, schema, None, path_col) for g in detect_globs(spark, path)]
        good, bad = union_by_name(*[p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])
        return (good.repartition(partitions) if partitions else good), bad
    kind = format_of(glob)
    tables = folders_named(spark, path, glob)
    parts = [read_format(spark, kind, folder, None, schema, path_col) for folder in tables]
    if not tables or not list_files(spark, path, glob).isEmpty():
        parts.append(read_format(spark, kind, path, glob, schema, path_col))
    df, bad = union_by_name(*[p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])
    return (df.repartition(partitions) if partitions else df), bad


def folders_named(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Folders directly below ``path`` that the pattern names and whose files do not match it
    themselves, as those of a table written by Spark: they are read whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    folders = sorted(f.getPath().toString() for f in found if f.isDirectory())
    return [f for f in folders if list_files(spark, f, glob).isEmpty()]


def read_format(
    spark: SparkSession, kind: str, path: str, glob: str | None, schema: t.StructType | None, path_col: str | None,
) -> tuple[DataFrame, DataFrame]:
    """Records and quarantine of the files of one format; without a pattern of all files below ``path``."""
    bad = spark.createDataFrame([], QUARANTINE)
    if kind == "json":
        df, bad = read_json(spark, path, glob, schema, path_col=path_col)
    elif kind == "parquet":
        df = _located(_reader(spark, glob).option("mergeSchema", "true").parquet(path), path_col)
    elif kind == "arrow":
        df = read_arrow(spark, path, glob)
    elif kind == "warc":
        df = read_warc(spark, path, glob)
    else:
        df, bad = read_delimited(spark, path, glob, "\t" if kind == "tsv" else ",", schema, path_col=path_col)
    return df, bad


def _located(df: DataFrame, path_col: str | None) -> DataFrame:
    return df.withColumn(path_col, F.col("_metadata.file_path")) if path_col else df


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def read_json(
    spark: SparkSession, path: str, glob: str | None = None, schema: t.StructType | None = None,
    multi_line: bool | None = None, path_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Good records and the quarantine ``(file, value)`` of unreadable lines.

    A line holds one object or an array of objects. Every file is looked at on its own: one that
    begins with an array which its first line does not end is laid out over several lines and is
    cut into its items by splits (:mod:`millrace.sources.stitch`), all others are read line by line.
    Items of an array that are no objects go to the quarantine one by one. ``multi_line=True`` takes
    every file as one value.
    """
    ensure_checkpoint_dir(spark)
    located = F.col("_metadata.file_path").alias("file")
    lines = _reader(spark, glob).text(path, wholetext=bool(multi_line)).select(located, "value").filter(F.trim("value") != "")
    listed = None
    if multi_line is None:
        laid_out = laid_out_files(spark, path, glob).checkpoint()
        if not laid_out.isEmpty():
            listed = text_lines(spark, path, glob).join(broadcast_if_small(laid_out), "file", "left_semi")
            lines = lines.join(broadcast_if_small(laid_out), "file", "left_anti")
    # Array items are taken as JSON text first, so that one bad item spoils no other.
    text = F.ltrim(F.regexp_replace("value", r"\A\s+", ""))
    parts = F.from_json(F.when(F.startswith(text, F.lit("[")), text), t.ArrayType(t.StringType()), {"mode": "PERMISSIVE"})
    items = F.when(F.startswith(text, F.lit("[")), F.coalesce(parts, F.array("value"))).otherwise(F.array("value"))
    items = lines.select("file", F.explode(items).alias("value"))
    if listed is not None:
        items = items.unionByName(array_items(listed).select("file", "value"))
    found = schema or json_schema(items)
    record = t.StructType([*(f for f in found.fields if f.name != CORRUPT), t.StructField(CORRUPT, t.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = items.withColumn("r", F.from_json("value", record, options))
    sound = F.startswith(F.regexp_replace("value", r"\A\s+", ""), F.lit("{")) & F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    sound = F.coalesce(sound, F.lit(False))
    bad = parsed.filter(~sound).select("file", "value")
    kept = [F.col("file").alias(path_col)] if path_col else []
    return parsed.filter(sound).select("file", "r.*").drop(CORRUPT).select(*[f"`{f.name}`" for f in record.fields[:-1]], *kept), bad


def json_schema(items: DataFrame, column: str = "value") -> t.StructType:
    """The schema that fits all JSON objects of a column, merged in one aggregate.

    Values of unlike types and objects without any field become strings, whole numbers longs, others
    doubles. Text that is no object does not count; without any there are no fields."""
    merged = items.agg(F.schema_of_variant_agg(F.when(F.startswith(F.ltrim(column), F.lit("{")), F.try_parse_json(column)))).first()[0]
    return spark_type(merged) if merged and merged.startswith("OBJECT<") else t.StructType()


def spark_type(variant: str) -> t.DataType:
    """The Spark type for a variant's schema text, such as ``OBJECT<a: ARRAY<BIGINT>>``."""
    if variant.startswith("ARRAY<"):
        return t.ArrayType(spark_type(variant[6:-1]))
    if variant.startswith("OBJECT<") and variant != "OBJECT<>":
        fields, depth, at, quoted = [], 0, 7, False
        for i in range(7, len(variant)):
            c = variant[i]
            quoted ^= c == "`"
            depth += 0 if quoted else (c in "<(") - (c in ">)")
            if not quoted and (c == "," and depth == 0 or i == len(variant) - 1):
                name, kind = field_of(variant[at:i].strip())
                fields.append(t.StructField(name, spark_type(kind)))
                at = i + 1
        return t.StructType(fields)
    return {"BIGINT": t.LongType(), "DOUBLE": t.DoubleType(), "FLOAT": t.DoubleType(), "BOOLEAN": t.BooleanType()}.get(variant, t.DoubleType() if variant.startswith("DECIMAL") else t.StringType())


def field_of(text: str) -> tuple[str, str]:
    """Name and type text of a field; a name with special characters stands in back-quotes."""
    if text.startswith("`"):
        end = re.match(r"`(?:[^`]|``)*`", text).end()
        return text[1 : end - 1].replace("``", "`"), text[end + 1 :].strip()
    name, kind = text.split(":", 1)
    return name, kind.strip()


def laid_out_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Files that begin with an array which does not end on the first line with text."""
    lines = _reader(spark, glob).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")
    )
    # Within a block rows come in the order of the file.
    numbered = lines.withColumn("nth", F.monotonically_increasing_id()).filter("line <> ''")
    edge = F.struct("block", "nth", F.substring("line", 1, 1).alias("opens"), F.substring("line", -1, 1).alias("ends"))
    first = numbered.groupBy("file").agg(F.min(edge).alias("first"))
    return first.filter("first.opens = '[' AND first.ends <> ']' OR first.opens = '[' AND first.ends = '['").select("file")


def read_delimited(
    spark: SparkSession, path: str, glob: str | None, separator: str = ",", schema: t.StructType | None = None,
    text_col: str = "text", path_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited files with a header, and the quarantine ``(file, value)``.

    Files are cut into records by splits, so a large one is many tasks although quoted fields may hold
    line breaks. Files that are not valid UTF-8 are read as Latin-1. Every file has its own header;
    files with different ones are united by name. Rows with a wrong number of fields or with a blank
    ``text_col`` go to the quarantine. Values are strings unless a schema, by position, says otherwise.
    """
    ensure_checkpoint_dir(spark)
    lines = delimited_records(text_lines(spark, path, glob), separator)
    value = F.regexp_replace("value", r"\r\z", "")
    rows = lines.select("file", "item", F.when(F.col("item") == 1, F.regexp_replace(value, "\\A\ufeff", "")).otherwise(value).alias("value"))
    headers = rows.filter("item = 1").select("file", F.col("value").alias("header")).checkpoint()
    kept = [F.col("file").alias(path_col)] if path_col else []
    good, bad = [], []
    # As many as there are different headers.
    for header in sorted(r.header for r in headers.select("header").distinct().collect()):
        own = headers.filter(F.col("header") == header).select("file")
        body = rows.filter("item > 1 AND value <> ''").join(broadcast_if_small(own), "file", "left_semi")
        fields = list(schema.fields) if schema else [t.StructField(n, t.StringType()) for n in header_names(header, separator)]
        kind = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in [*fields, t.StructField(CORRUPT, t.StringType())])
        options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
        parsed = body.select("file", "value", F.from_csv("value", kind, options).alias("r"))
        sound = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
        if any(f.name == text_col for f in fields):
            sound = sound & (F.trim(F.col("r")[text_col].cast("string")) != "")
        sound = F.coalesce(sound, F.lit(False))
        good.append(parsed.filter(sound).select(*[F.col("r")[f.name].alias(f.name) for f in fields], *kept))
        bad.append(parsed.filter(~sound).select("file", "value"))
    if not good:
        return spark.createDataFrame([], schema or t.StructType()), spark.createDataFrame([], QUARANTINE)
    return union_by_name(*good), reduce(DataFrame.unionByName, bad)


def header_names(header: str, separator: str) -> list[str]:
    """Field names; a blank one is named by its place, a repeated one gets its place appended."""
    names = next(csv.reader([header], delimiter=separator), [])
    return [f"_c{i}" if not n else f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def _open_arrow(content: bytes):
    try:
        return pa.ipc.open_file(io.BytesIO(content))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(io.BytesIO(content))


def _batches(source) -> Iterator[pa.RecordBatch]:
    if isinstance(source, pa.ipc.RecordBatchFileReader):
        return (source.get_batch(i) for i in range(source.num_record_batches))
    return iter(source)


def read_arrow(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Arrow IPC files, one task per file. The schema is the union of all files' schemas, of which
    only the distinct ones visit the driver; a column that a file lacks is null in its rows."""
    files = _reader(spark, glob).format("binaryFile").load(path).select("content")

    def schema_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                yield pd.DataFrame({"schema": [base64.b64encode(_open_arrow(content).schema.remove_metadata().serialize().to_pybytes()).decode()]})

    encoded = sorted(r.schema for r in files.mapInPandas(schema_of, "schema string").distinct().collect())
    schema = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(base64.b64decode(x))) for x in encoded], promote_options="permissive")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part in _batches(_open_arrow(content.as_py())):
                    columns = [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.mapInArrow(rows, from_arrow_schema(schema))


def read_warc(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """``(url, html)`` of the response records of WARC files, one task per file.

    Compressed records are opened one after the other, so a task holds the compressed
    file and a block of pages.
    """
    files = _reader(spark, glob).format("binaryFile").load(path).select("content")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                for block in batched(warc_responses(content), PAGES_PER_BLOCK):
                    yield pd.DataFrame(list(block), columns=["url", "html"])

    return files.mapInPandas(split, "url string, html string")


def read_staged(
    spark: SparkSession, root: str, repo: str, split: str = "train", glob: str | None = None,
    distribution_key: str | None = None, limit: int | None = None, seed: int = 42,
) -> DataFrame:
    """A hub dataset staged as ``root/repo/config/split/files``: all configurations of one
    split, the configuration in ``_dataset_name`` when there are several. A limit takes the
    records whose seeded hash is smallest; without one the order is left alone."""
    path = f"{root.rstrip('/')}/{repo}/*/{split}"
    located = scan(spark, path, glob, path_col="_path")
    config = F.regexp_replace(F.element_at(F.split("_path", "/"), -3), "^[^=]*=", "")
    several = list_files(spark, f"{root.rstrip('/')}/{repo}").select(F.element_at(F.split("path", "/"), -3)).distinct().count() > 1
    name = F.concat_ws("/", F.lit(repo), config) if several else F.lit(repo)
    df = located.withColumns({"_dataset_name": name, "_split": F.lit(split)}).drop("_path")
    if distribution_key and distribution_key in df.columns:
        df = df.withColumn("_distribution", F.col(distribution_key).cast("string"))
    if limit is None:
        return df
    key = F.xxhash64(F.lit(seed), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.orderBy(key).limit(limit)


def window_of_rows(df: DataFrame, order: list, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows after ``skip`` in a stated order."""
    out = df.orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def sample_records(df: DataFrame, k: int = 50, order: list | None = None) -> DataFrame:
    """The first ``k`` records with long strings cut and nested objects spliced."""
    return truncate_and_flatten((df.orderBy(*order) if order else df).limit(k))
