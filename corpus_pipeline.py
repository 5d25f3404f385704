"""The corpus pipeline: filter, near-dedup, substring dedup, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes every stage to the
shared folder and rereads it as the next one's input, so a lost executor costs running tasks only.
All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import dart_minhash, piece_dropout, pivotal_mix, quality_bands, substring_dedup
from millrace.llm.stage import small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    return quality_bands.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return dart_minhash.one_per_class(docs)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too; ``n_chars`` follows the text."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return pivotal_mix.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``pieces`` and ``lossless`` of each document."""
    return piece_dropout.encoded_and_decoded(docs)


STAGES = [
    ("quality_rules", small_batches(quality_rules)),
    ("near_dedup", small_batches(near_dedup)),
    ("substring_dedup", small_batches(substring_cut)),
    ("mix_sources", small_batches(mix_sources)),
    ("encode_pieces", small_batches(encode_pieces)),
]

# SQL cannot express compression, darts, random rounding or piece merges; the tests hold the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
