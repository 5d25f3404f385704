"""Repeatable sampling by content hash: the same record is kept on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPAN = 2**32


def hash_number(key: Column | str, seed: int | str = 0) -> Column:
    """First eight hex digits of SHA-256 over key and seed, as a number below 2**32."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat_ws("|", column.cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sampled(key: Column | str, rate: Column | float, seed: int | str = 0) -> Column:
    share = F.lit(rate) if isinstance(rate, (int, float)) else rate
    return hash_number(key, seed) < share.cast("double") * HASH_SPAN


def hash_sample(df: DataFrame, key: str, rate: float, seed: int | str = 0) -> DataFrame:
    return df.filter(sampled(key, rate, seed))
