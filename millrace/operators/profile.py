"""Column profiles, histograms and totals.

Exact percentiles do not hold a column's values in one task: the wanted ranks of all
columns are narrowed together by counting passes, and a pass moves one row per piece
of an interval, whatever the number of values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counting passes cut an interval of values into so many pieces.
PIECES = 256
FRACTIONS = (0.05, 0.5, 0.95)


def to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` rows of the values; nulls and NaN are no values."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").filter("value is not null and not isnan(value)")


@dataclass
class Wanted:
    """A rank of a column, counted from 0 within the values between ``lo`` and ``hi``."""

    column: str
    rank: int
    lo: float
    hi: float


def piece(value: Column, lo: Column, hi: Column) -> Column:
    """Number of the piece of ``lo`` to ``hi`` a value falls into, never falling as values rise.
    Both ends have a piece of their own, so every pass narrows an interval."""
    share = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.greatest(F.lit(1.0), F.least(F.lit(PIECES - 2.0), F.floor(F.nanvl(share, F.lit(0.5)) * PIECES).cast("double")))
    return F.when(value <= lo, 0).when(value >= hi, PIECES - 1).otherwise(inner.cast("int"))


def select_ranks(values: DataFrame, wanted: list[Wanted]) -> None:
    """Narrow every wanted rank until its interval holds one distinct value.

    All intervals are counted in one pass over ``values``. What comes to the driver is bounded by
    the number of ranks times the number of pieces.
    """
    spark = values.sparkSession
    while todo := sorted({(w.column, w.lo, w.hi) for w in wanted if w.lo < w.hi}):
        number = {interval: i for i, interval in enumerate(todo)}
        intervals = spark.createDataFrame([(i, *x) for x, i in number.items()], "interval int, column string, lo double, hi double")
        inside = values.join(F.broadcast(intervals), "column").filter(F.col("value").between(F.col("lo"), F.col("hi")))
        counted = inside.groupBy("interval", piece(F.col("value"), F.col("lo"), F.col("hi")).alias("piece")).agg(
            F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        pieces: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: r.piece):
            pieces.setdefault(row.interval, []).append(row)
        for w in wanted:
            for row in pieces.get(number.get((w.column, w.lo, w.hi), -1), []):
                if w.rank < row.n:
                    w.lo, w.hi = row.lo, row.hi
                    break
                w.rank -= row.n


def percentiles(values: DataFrame, summary: list, fractions=FRACTIONS) -> dict[str, list[float]]:
    """Per column the values at the fractions, between two ranks by linear interpolation.
    ``summary`` has the rows ``column, count, min, max``."""
    ends = {}
    for s in summary:
        for f in fractions:
            position = f * (s["count"] - 1)
            ends[s.column, f] = [Wanted(s.column, r, s["min"], s["max"]) for r in (math.floor(position), math.ceil(position))], position % 1
    select_ranks(values, [w for pair, _ in ends.values() for w in pair])
    return {s.column: [a.lo + (b.lo - a.lo) * part if a.lo != b.lo else a.lo for (a, b), part in (ends[s.column, f] for f in fractions)] for s in summary}


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, median, p05, p95, sample deviation, count, skew and excess kurtosis per column.

    The table is read once for the moments and once per counting pass; store it before if it is
    costly to compute. Columns without values have no row.
    """
    values = to_long(df, columns)
    summary = values.groupBy("column").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.count("value").alias("count"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    ).collect()  # one row per column
    found = percentiles(values, summary)
    rows = [(s.column, s.min, s.max, s.mean, found[s.column][1], found[s.column][0], found[s.column][2], s.std, s["count"], s.skewness, s.kurtosis) for s in summary]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, max double, mean double, median double, p05 double, p95 double, std double, count long, skewness double, kurtosis double"
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins per column; the maximum falls into the last bin."""
    values = to_long(df, columns)
    bounds = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = values.join(F.broadcast(bounds), "column")
    spread = F.col("hi") > F.col("lo")
    bucket = F.when(spread, F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins).cast("long"))).otherwise(1)
    width = (F.col("hi") - F.col("lo")) / bins
    return placed.groupBy("column", "lo", "hi", bucket.cast("long").alias("bin")).agg(F.count("*").alias("rows")).select(
        "column", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"), "rows"
    )


def whole_sum(column: str, factor: Column | None = None) -> Column:
    """Sum in decimals, so the total does not depend on the order of the rows."""
    value = F.col(column).cast("decimal(20,6)")
    return F.coalesce(F.sum(value if factor is None else value * factor), F.lit(0))


def totals(stats: DataFrame, by: list[str]) -> DataFrame:
    """Records, tokens and words per group, truncated to whole numbers."""
    return stats.groupBy(*by).agg(
        F.count("*").alias("samples"),
        whole_sum("_token_count").cast("long").alias("tokens"),
        whole_sum("_word_count").cast("long").alias("words"),
    )


def with_missing(groups: DataFrame, group_totals: DataFrame, by: list[str]) -> DataFrame:
    """Groups without statistics count as zero."""
    return groups.join(group_totals, by, "left").na.fill(0, ["samples", "tokens", "words"])


def scaled_totals(entries: DataFrame, by: list[str], truncate: bool = True, replica: str = "replica") -> DataFrame:
    """Totals of a mix: each entry is multiplied by its replica, truncated, then summed."""
    def scaled(name: str) -> Column:
        if truncate:
            return F.sum((F.col(name).cast("double") * F.col(replica).cast("double")).cast("long")).alias(name)
        exact = F.col(name).cast("decimal(24,0)") * F.col(replica).cast("decimal(10,4)")
        return F.sum(exact.cast("decimal(30,4)")).alias(name)

    return entries.groupBy(*by).agg(*[scaled(n) for n in ("samples", "tokens", "words")])


def null_density(df: DataFrame) -> DataFrame:
    """Number and share of null records per field, in one pass."""
    pairs = ", ".join(f"'{c}', cast(`{c}` is null as int)" for c in df.columns)
    flags = df.selectExpr(f"stack({len(df.columns)}, {pairs}) as (field, is_null)")
    return flags.groupBy("field").agg(
        F.sum("is_null").alias("nulls"), F.count("*").alias("records"), F.avg("is_null").alias("null_ratio")
    )


def language_counts(records: DataFrame, file_col: str = "_filename", lang_col: str = "_lang", ok: Column | None = None) -> DataFrame:
    """Records written, files and errors per language."""
    good = F.lit(True) if ok is None else ok
    return records.groupBy(F.coalesce(lang_col, F.lit("un")).alias("lang")).agg(
        F.count(F.when(good, 1)).alias("written"),
        F.count_distinct(F.when(good, F.col(file_col))).alias("files"),
        F.count(F.when(~good, 1)).alias("errors"),
    )
