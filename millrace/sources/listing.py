"""File listings as DataFrames ``(path, length)`` and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: extensions that keep their inner extension ---------------------------
COMPRESSED = {
    "bz2": ["csv", "json", "jsonl", "tar", "tsv"],
    "gz": ["csv", "json", "jsonl", "ndjson", "tar", "tsv"],
    "xz": ["csv", "json", "jsonl", "tar", "tsv"],
    "zst": ["csv", "json", "jsonl", "tar", "tsv"],
}
IGNORED_FOLDERS = r"(?i)\.cache|logs|__pycache__"


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def relative(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def extension(path: Column) -> Column:
    """Last extension with its dot, doubled for compressed data files, '' without one."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(name, r"\.")
    last = F.element_at(parts, -1)
    inner = F.lower(F.try_element_at(parts, F.lit(-2)))
    doubled = F.lit(False)
    for outer in sorted(COMPRESSED):
        doubled = doubled | ((F.lower(last) == outer) & inner.isin(COMPRESSED[outer]))
    return (
        F.when((F.size(parts) >= 3) & doubled, F.concat(F.lit("."), inner, F.lit("."), F.lower(last)))
        .when((F.size(parts) >= 2) & (last != ""), F.concat(F.lit("."), last))
        .otherwise("")
    )


def leaf_partitions(files: DataFrame, root: str) -> DataFrame:
    """Folders that hold files, the root and working folders left out, in order."""
    folders = files.select(folder(F.col("path")).alias("folder")).distinct()
    return folders.filter((F.col("folder") != root.rstrip("/")) & ~F.rlike("folder", F.lit(IGNORED_FOLDERS))).orderBy("folder")


def minimal_globs(files: DataFrame, root: str) -> DataFrame:
    """One pattern per folder and extension."""
    inside = relative(F.col("path"), root)
    at = F.when(F.contains(inside, F.lit("/")), F.concat(folder(inside), F.lit("/"))).otherwise("")
    return files.select(F.concat(at, F.lit("*"), extension(F.col("path"))).alias("glob")).distinct().orderBy("glob")


def filtered_globs(files: DataFrame, root: str) -> DataFrame:
    """All patterns of a dataset folder without hidden, underscored, cache and lock ones.

    Besides one pattern per folder and extension this lists every folder as ``folder/*``;
    a file without extension at the root stands for itself.
    """
    inside = relative(F.col("path"), root)
    nested = F.contains(inside, F.lit("/"))
    # Folders and extensions repeat, files do not: reduce to distinct ones before cutting paths.
    kinds = files.select(
        F.when(nested, folder(inside)).alias("_folder"), extension(F.col("path")).alias("_ext"),
        F.when(~nested & (extension(F.col("path")) == ""), inside).alias("_plain"),
    ).distinct()
    name = F.coalesce("_plain", F.concat(F.lit("*"), F.col("_ext")))
    own = F.when(F.col("_folder").isNull(), name).when(F.col("_ext") != "", F.concat_ws("/", "_folder", name))
    parents = F.split("_folder", "/")
    upward = F.transform(
        F.sequence(F.lit(1), F.size(parents)), lambda n: F.concat(F.array_join(F.slice(parents, F.lit(1), n), "/"), F.lit("/*"))
    )
    every = F.array_compact(F.concat(F.array(own), F.coalesce(upward, F.array().cast("array<string>"))))
    globs = kinds.select(F.explode(every).alias("glob")).distinct()
    part_hidden = F.exists(
        F.split("glob", "/"),
        lambda p: (F.startswith(p, F.lit(".")) & ~F.endswith(p, F.lit(".md")) & ~F.contains(p, F.lit("*"))) | F.startswith(p, F.lit(".*")),
    )
    part_underscored = F.exists(
        F.split("glob", "/"), lambda p: (F.startswith(p, F.lit("_")) & ~F.contains(p, F.lit("*"))) | F.startswith(p, F.lit("_*"))
    )
    cached = F.rlike("glob", F.lit(r"(?i)\.cache|\.lock$|\.metadata$"))
    return globs.filter((F.col("glob") != "*") & ~part_hidden & ~part_underscored & ~cached).orderBy("glob")


def verify_output(files: DataFrame, lang: Column) -> DataFrame:
    """Files and bytes per language and in total; the total row has no language."""
    sized = files.select(lang.alias("lang"), "length")
    return sized.rollup("lang").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def check_written(files: DataFrame) -> None:
    """Raise when a job wrote no file."""
    if files.isEmpty():
        raise ValueError("no output files were written")
