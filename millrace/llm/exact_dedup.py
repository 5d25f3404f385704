"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Every stage groups by digest *and*
text, so the full content is compared each time and a digest alone never decides:

1. each task combines its own rows to one per text (the map side of the first aggregate);
2. what is left goes to salted groups: the salt is the task's number, so a text that fills a third
   of the table arrives in ``salts`` places, with one row per task at most;
3. the winners of the salts, at most ``salts`` per text, are combined by digest.

A digest that turned out to have one single text needs no text any more: its rows are flagged by a
join on the digest, which moves ids and digests only. Digests with several texts are flagged by a
join on digest and text. For SHA-256 there are none; the path is there for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.stage import stored
from millrace.session import broadcast_if_small

RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@dataclass(frozen=True)
class Settings:
    salts: int = 32
    #: Hexadecimal characters of the SHA-256 that make the digest.
    digest_chars: int = 64


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; ``lower`` does that for texts of ASCII only."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def normalised(df: DataFrame, id_col: str, text_col: str, number: Column, settings: Settings) -> DataFrame:
    """``doc_id, number, text, text_sha256, digest``; a null text is an empty one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), number.alias("number"), ascii_lower(text).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    return rows.withColumn("digest", F.substring("text_sha256", 1, settings.digest_chars))


def combined(rows: DataFrame, settings: Settings) -> DataFrame:
    """``digest, text, keep_id, group_size``: one row per text, in partitions by digest."""
    salted = rows.withColumn("salt", F.spark_partition_id() % settings.salts)
    winners = salted.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_digest = winners.drop("salt").repartition("digest")
    return by_digest.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def flagged(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the figures of their class; one row with the class's ``keep_id`` is kept."""
    first = F.coalesce(F.max_by("number", "doc_id"), F.max("number")).alias("keep_number")
    # Stored, so that the join below has a plain exchange on both sides and a hot key can be split.
    known = stored(classes.join(rows.groupBy(*key).agg(first), key), "classes")
    return rows.join(known, key).withColumn("kept", F.col("number") == F.col("keep_number")).select("number", *RESULT)


def decide(rows: DataFrame, settings: Settings) -> DataFrame:
    narrow = stored(rows.drop("text"), "digests")
    # The groups of a digest lie in one partition already: no further exchange.
    count = combined(rows, settings).groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    digests = stored(count, "texts")
    single, several = digests.filter("texts = 1").drop("texts"), digests.filter("texts > 1").select("digest")
    out = flagged(narrow, single, ["digest"])
    if not several.isEmpty():
        clash = stored(rows.join(broadcast_if_small(several), "digest", "left_semi"), "clashes")
        out = out.unionByName(flagged(clash, combined(clash, settings), ["digest", "text"]))
    return out


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``keep_id`` (that of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` (of the normalised text) of every row.

    Of equal texts the row with the largest id stays, null ids come last; of several rows with that
    id and text exactly one stays. Null texts count as empty and are copies of empty ones. Texts are
    compared whole whatever their length. An empty table gives an empty result; other columns of
    ``df`` take no part, whatever their names.
    """
    rows = normalised(df, id_col, text_col, F.monotonically_increasing_id(), settings)
    return decide(rows, settings).select(*RESULT)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns as they were.

    The table is written once with a row number, so that a row is found again when ids repeat.
    """
    number = "_number"
    while number in df.columns:
        number += "_"
    base = stored(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    kept = decide(normalised(base, id_col, text_col, F.col(f"`{number}`"), settings), settings).filter("kept")
    return base.join(kept.select(F.col("number").alias(number)), number, "left_semi").select(*[f"`{c}`" for c in df.columns])
