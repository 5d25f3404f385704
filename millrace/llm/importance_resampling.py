"""Importance resampling towards a target distribution, on hashed word n-grams.

The features of a text are its runs of one and two words; each falls into one of ``buckets`` by its
CRC-32. Counting the buckets over all of the corpus and all of the target gives every bucket a gain,
the log ratio of the two smoothed shares. A text weighs the mean gain of its features, a hashed
Gumbel draw is added, and the highest sums are taken, which samples without replacement in
proportion to the importance weights.

Inside a task Arrow does the text work, a slice of texts at a time: ``ascii_lower``,
``split_pattern_regex`` and ``list_flatten`` give the words, ``dictionary_encode`` numbers them. A
pair is two neighbouring indices, the index array and the same array shifted by one. Only distinct
words and distinct pairs are hashed; ``take`` spreads buckets and gains back over the occurrences,
and prefix sums reduce them to one figure per text.

Texts are scanned twice, for the counts and for the weights, and never shuffled: what moves is one
row per bucket and task, then ids and scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan
from millrace.llm.stage import stored
from millrace.session import broadcast_if_small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20
CRC_POLYNOMIAL = 0xEDB88320
#: Words of up to so many bytes are appended to a CRC by table.
TABLE_BYTES = 64
WEIGHED = T.StructType([T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")])


@dataclass(frozen=True)
class Settings:
    buckets: int = 10000
    #: Per cent of the texts with at least ``min_words`` words that are drawn.
    percent: int = 25
    min_words: int = 20
    seed: int = 7


@dataclass
class Features:
    """Buckets of the words and of the neighbouring pairs of some texts. ``first[d]:first[d + 1]``
    are the words of text d, ``pair_at`` is the first word of each pair."""

    word_bucket: pa.Array
    pair_bucket: pa.Array
    first: np.ndarray
    pair_at: np.ndarray

    def sums(self, gains: pa.Array) -> np.ndarray:
        """Sum of the gains of each text's features."""
        words = np.asarray(gains.take(self.word_bucket))
        pairs = np.asarray(gains.take(self.pair_bucket))
        return segment_sums(words, self.first) + segment_sums(pairs, np.searchsorted(self.pair_at, self.first))


@lru_cache(maxsize=1)
def crc_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``b`` at place ``k`` of a CRC turns into when ``n`` bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    tables = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
    for _ in range(TABLE_BYTES):
        tables.append(step[tables[-1] & np.uint32(255)] ^ (tables[-1] >> np.uint32(8)))
    return np.stack(tables)


def pair_crc(words: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """CRC-32 of ``left right`` per pair of indices into ``words``.

    The CRC is linear: that of "left " carried over the bytes of the right word, xor that word's own.
    """
    opened = np.array([zlib.crc32(w + b" ") for w in words], dtype=np.uint32)[left]
    own = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)[right]
    size = np.array([len(w) for w in words], dtype=np.int64)[right]
    tables, short = crc_tables(), np.minimum(size, TABLE_BYTES)
    out = own
    for k in range(4):
        out = out ^ tables[short, k, (opened >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size > TABLE_BYTES).tolist():
        out[i] = zlib.crc32(words[right[i]], int(opened[i]))
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the bounds of each text in them."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat, sizes = pc.list_flatten(lists), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    # A separator at either end leaves an empty string.
    real = np.asarray(pc.greater(pc.binary_length(flat), 0).cast(pa.int8())).astype(bool)
    words_before = np.concatenate(([0], np.cumsum(real)))
    bounds = words_before[np.concatenate(([0], np.cumsum(sizes)))]
    return flat.filter(pa.array(real)), bounds


def features(texts: pa.Array, buckets: int) -> Features:
    words, first = split_words(texts)
    coded = words.dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int64)
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    word_bucket = pa.array([zlib.crc32(w) % buckets for w in distinct], pa.int64())
    # A pair starts at every word that is not the last of its text.
    starts = np.ones(len(index), dtype=bool)
    starts[first[1:][first[1:] > first[:-1]] - 1] = False
    pair_at = np.flatnonzero(starts)
    pairs = pa.array(index[pair_at] * max(len(distinct), 1) + index[pair_at + 1] if len(pair_at) else np.empty(0, np.int64)).dictionary_encode()
    left, right = np.divmod(np.asarray(pairs.dictionary).astype(np.int64), max(len(distinct), 1))
    pair_bucket = pa.array(pair_crc(distinct, left, right).astype(np.int64) % buckets if len(left) else np.empty(0, np.int64))
    return Features(word_bucket.take(coded.indices), pair_bucket.take(pairs.indices), first, pair_at)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes, one text at least; nulls are empty texts."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds = wordscan.text_buffers(texts)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield texts.slice(row, to - row)
        row = to


def bucket_counts(df: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``bucket``, ``n``: how many features of all texts fall into each bucket that has any."""
    buckets = settings.buckets

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                found = features(texts, buckets)
                for column in (found.word_bucket, found.pair_bucket):
                    total += np.bincount(np.asarray(column), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket on the driver; there are never more than ``buckets``."""
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(share in target / share in source))`` per bucket, one added to every count."""
    all_source, all_target, n = float(source.sum()), float(target.sum()), len(source)
    out = [math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())]
    return np.array(out, dtype=np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """Struct of ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features."""
    buckets, table = len(gain), gain.tolist()

    @F.arrow_udf(WEIGHED)
    def weigh(column: pa.Array) -> pa.Array:
        values, parts = pa.array(table, pa.int64()), []
        for texts in text_slices(column):
            found = features(texts, buckets)
            words = np.diff(found.first)
            count = words + np.maximum(words - 1, 0)
            weight = found.sums(values) // np.maximum(count, 1)
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in (words, count, weight)], names=WEIGHED.names))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64()) for n in WEIGHED.names]))

    return weigh.asNondeterministic()(text)


def noise(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, fixed by the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, stored in the shared folder."""
    gain = gains(dense(bucket_counts(df, text_col, settings), settings.buckets), dense(bucket_counts(target, text_col, settings), settings.buckets))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), weighed(F.col(f"`{text_col}`").cast("string"), gain).alias("w"))
    rows = rows.select("doc_id", "w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed))
    return stored(rows, "scores")


def ranked(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 for the drawn ones, null for the others.

    The eligible rows are dealt into ranges of falling score. A row's rank is its place in its range
    plus the rows of the ranges before it: no task ever sees more than a range, and equal rows are
    dealt by a third key, so that no key fills one.
    """
    can = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("draw")]
    eligible = rows.filter(can).withColumn("draw", F.xxhash64(F.monotonically_increasing_id()))
    # Stored, so that the ranges stay what they are when a task is run again.
    ranges = stored(eligible.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    placed = ranges.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    rank = F.col("before") + F.col("place")
    drawn = placed.join(broadcast_if_small(before), "range").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    return drawn.select(*rows.columns, "rank").unionByName(rows.filter(~F.coalesce(can, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def draw(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``df``.

    ``rank`` counts the drawn rows from 1 by falling score, equal scores by rising id; it is null for
    rows that are not drawn. ``percent`` per cent, rounded down, of the rows with ``min_words`` words
    are drawn. Null and empty texts have no features and weight 0. A row without an id has no score
    and takes no part in the draw. Rows of one id and score are ranked in any order; each counts.
    An empty target or an empty table is fine: smoothing keeps every share above zero. Columns of
    other names take no part. Texts are read whole, whatever their length.
    """
    return ranked(scored(df, target, id_col, text_col, settings), settings.percent, settings.min_words)


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The drawn rows of ``df`` with all their columns; rows that share a drawn id come with it."""
    drawn = draw(df, target, id_col, text_col, settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias(id_col))
    return df.join(drawn.distinct(), id_col, "left_semi").select(*[f"`{c}`" for c in df.columns])
