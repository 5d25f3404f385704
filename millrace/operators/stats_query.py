"""Filter and join data by the statistics silo.

A silo table has one row per record id. The joins keep only the data columns, so the
silo is pruned to the filtered columns and its filters are pushed to its scan. Data
and silo written with ``sources.sinks.write_bucketed`` on the id join without moving
the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.standardize import rewrite_subpath

COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "range": lambda c, v: c.between(v[0], v[1]),
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
}


def qualified(column: str) -> str:
    """A column without a table prefix belongs to the low-level statistics."""
    return column if "." in column else f"s.{column}"


def condition(column: str, op: str, value) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; one of {sorted(COMPARISONS)}")
    return COMPARISONS[op](F.col(qualified(column)), value)


def all_of(filters: list[tuple], custom: str | None = None) -> Column | None:
    """Conjunction of ``(column, op, value)`` filters and an optional SQL fragment."""
    parts = [condition(*f) for f in filters]
    if custom and custom.strip():
        parts.append(F.expr(f"({custom.strip()})"))
    return reduce(lambda a, b: a & b, parts) if parts else None


def join_stats(
    data: DataFrame,
    low: DataFrame,
    chat: DataFrame | None = None,
    filters: list[tuple] = (),
    custom: str | None = None,
    folder: str | None = None,
    keep: list[str] = (),
    key: str = "_id_hash",
) -> DataFrame:
    """Data rows whose statistics pass; aliases are ``d`` data, ``s`` low, ``c`` chat.

    Ids that occur more than once in a silo multiply rows, as inner joins do; pass the
    silo through :func:`one_row_per_id` when it may hold duplicates.
    """
    joined = data.alias("d").join(low.alias("s"), F.col(f"d.{key}") == F.col("s.id"), "inner")
    if chat is not None:
        joined = joined.join(chat.alias("c"), F.col(f"d.{key}") == F.col("c.id"), "inner")
    test = all_of(filters, custom)
    if test is not None:
        joined = joined.filter(test)
    out = joined.select("d.*", *[F.col(qualified(k)).alias(k.split(".")[-1]) for k in keep])
    return rewrite_subpath(out, folder) if folder and folder.strip() else out


def one_row_per_id(silo: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id. The statistics of equal ids are equal, so any row will do; the
    partial aggregate collapses copies before the shuffle, however many there are."""
    others = [c for c in silo.columns if c != id_col]
    return silo.groupBy(id_col).agg(*[F.min(c).alias(c) for c in others])


def enrich(data: DataFrame, extra: DataFrame, key: str = "_id_hash", extra_key: str = "id", how: str = "left") -> DataFrame:
    """Add the columns of a user table that is keyed by record id."""
    return data.join(extra.withColumnRenamed(extra_key, key), key, how)
