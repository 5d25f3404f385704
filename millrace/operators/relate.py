"""Joins between catalog frames and paths that need more than a plain key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containment_join(left: DataFrame, left_text: str, right: DataFrame, right_text: str) -> DataFrame:
    """Left join on ``right_text`` being a substring of ``left_text``.

    Left values are cut into their substrings of exactly the lengths that occur on the right, and
    the join is on whole values. Nothing is left to verify and a prefix that all right values share
    is no key. The work is the length of the left values times the number of distinct lengths.
    Empty and null right values match nothing.
    """
    rights = right.filter(F.length(right_text) > 0)
    # Never more numbers than the longest right value has characters.
    lengths = rights.agg(F.array_sort(F.collect_set(F.length(right_text)))).first()[0]
    size = F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_size")
    values = left.select(left_text).distinct().select(left_text, size).filter(F.col("_size") <= F.length(left_text))
    starts = F.explode(F.sequence(F.lit(1), F.length(left_text) - F.col("_size") + 1)).alias("_at")
    pieces = values.select(left_text, "_size", starts).select(left_text, F.substr(left_text, "_at", "_size").alias(right_text))
    found = pieces.join(rights.select(right_text).distinct(), right_text, "left_semi").distinct()
    return left.join(found.join(rights, right_text), left_text, "left")


def ancestors(path_col: str, depths: list[int] | None = None):
    """Parent directories of a path, nearest first, down to the scheme; ``depths`` are the numbers of
    steps of those that are wanted."""
    steps = F.split(F.col(path_col), "/")
    sizes = F.sequence(F.size(steps) - 1, F.lit(1), F.lit(-1))
    if depths is not None:
        sizes = F.filter(sizes, lambda n: n.isin(depths))
    return F.transform(sizes, lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def nearest_ancestor(paths: DataFrame, path_col: str, catalog: DataFrame, uri_col: str = "uri") -> DataFrame:
    """Each path with the closest catalog address that is one of its parent directories."""
    up = paths.select(path_col).distinct().select(path_col, F.explode(ancestors(path_col)).alias("_parent"))
    known = catalog.select(F.col(uri_col).alias("_parent")).distinct()
    nearest = up.join(known, "_parent").groupBy(path_col).agg(F.max_by("_parent", F.length("_parent")).alias("parent_uri"))
    return paths.join(nearest, path_col, "left")


def has_descendant(paths: DataFrame, path_col: str, catalog: DataFrame, uri_col: str = "uri") -> DataFrame:
    """Each path with whether a catalog address lies below it."""
    parents = catalog.select(F.explode(ancestors(uri_col)).alias(path_col)).distinct().withColumn("has_child", F.lit(True))
    return paths.join(parents, path_col, "left").withColumn("has_child", F.coalesce("has_child", F.lit(False)))
