"""Quality rules: compression bands.

Every text is compressed with zstandard as a whole and in fixed chunks. A ratio of compressed to
plain bytes below the band is repetitive text, one above it is incompressible. The limits depend on the
length, because a short text has little to refer back to and a frame costs some bytes. Upper limits
lie just above prose in English and other Latin scripts. Base64 and random alphanumeric keys are
above them from 512 bytes on, random lower-case letters from 16 KiB, hex from 64 KiB; shorter ones, and
what compresses better, cannot be told from prose by the ratio. Word, symbol, line and repetition counts come from the same pass.

The operator is one projection: no shuffle, no state beyond one slice of a batch or one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan as W

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
JUDGED_BYTES = 1 << 18  # bytes of texts that are judged at once
LETTERS = np.array([not W.WHITE[b] and b & 0xC0 != 0x80 for b in range(256)])  # first bytes of characters in words


@dataclass(frozen=True)
class Bands:
    """Limits of the method: ``whole`` is ``(below bytes, low, high)`` by rising length, ``chunk``
    the band of one chunk; more than ``chunk_share`` of the chunked bytes outside rejects."""

    whole: tuple[tuple[float, float, float], ...] = (
        (384, 0.30, 0.92), (512, 0.30, 0.84), (640, 0.30, 0.79), (1 << 10, 0.30, 0.76), (1 << 11, 0.25, 0.72), (1 << 12, 0.25, 0.70),
        (1 << 13, 0.25, 0.66), (1 << 14, 0.20, 0.60), (1 << 16, 0.20, 0.56), (float("inf"), 0.15, 0.50),
    )
    chunk: tuple[float, float] = (0.20, 0.70)
    chunk_bytes: int = 4096
    least_chunk_bytes: int = 1024
    chunk_share: float = 0.30
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def band(self, size: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in self.whole if size < below)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("whole_ratio", "chunk_low", "chunk_high", "chunk_outside")]
    + [T.StructField("reason", T.StringType())]
)


def repeated_words(words: W.Words) -> np.ndarray:
    """Per text, the words in 3-word windows that occur twice or more in that text."""
    n, texts = len(words.starts), len(words.bounds) - 1
    covered = np.zeros(n + 2, dtype=bool)
    if n >= 3:
        h, text = words.hashes(), words.text_of_word()
        at = np.flatnonzero(text[2:] == text[:-2])
        key = W.mix(W.mix(W.mix(h[at]) + h[at + 1]) + h[at + 2]) ^ W.mix(text[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    sums = np.concatenate(([0], np.cumsum(covered[:n])))
    return sums[words.first[1:]] - sums[words.first[:-1]] if texts else np.empty(0, np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ratios(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """Whole ratio, lowest and highest chunk ratio, share of chunked bytes outside the chunk band."""
    whole = len(press.compress(text)) / len(text)
    low, high, outside, total = whole, whole, 0, 0
    if len(text) > bands.chunk_bytes:
        low, high = float("inf"), 0.0
        for at in range(0, len(text), bands.chunk_bytes):
            piece = text[at : at + bands.chunk_bytes]
            if len(piece) < bands.least_chunk_bytes:
                continue
            r = len(press.compress(piece)) / len(piece)
            low, high, total = min(low, r), max(high, r), total + len(piece)
            if not bands.chunk[0] <= r <= bands.chunk[1]:
                outside += len(piece)
    return whole, low, high, outside / total if total else 0.0


def verdict(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[str | None, tuple]:
    """Why the bands reject a text, or None, and its figures. An empty text has no ratio and passes."""
    if not text:
        return None, (None, None, None, None)
    figures = ratios(text, bands, press)
    low, high = bands.band(len(text))
    if figures[0] < low:
        return "repetitive", figures
    if figures[0] > high:
        return "incompressible", figures
    return ("uneven_chunks" if figures[3] > bands.chunk_share else None), figures


def quality(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of counts, ratios and the decision for a text column (see ``RESULT``).

    Null and empty texts have no words, fail the base rule and have null ratios. Very long texts
    are read whole. Equal rows get equal results; an empty table gives an empty table.
    """

    @F.arrow_udf(RESULT)
    def judged(column: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=bands.level)
        parts = []
        for _, data, bounds in W.slices(column, JUDGED_BYTES):
            words = W.find_words(data, bounds)
            counts, repeats = words.counts, repeated_words(words)
            raw = data.tobytes()
            texts = [raw[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            failed = (counts < bands.min_words) | (100 * repeats > bands.max_repeat_percent * counts)
            judged = [verdict(t, bands, press) for t in texts]
            kept = [not f and why is None for f, (why, _) in zip(failed.tolist(), judged)]
            why = ["base" if f else why for f, (why, _) in zip(failed.tolist(), judged)]
            columns = [
                pa.array(counts, pa.int64()), pa.array(per_text(LETTERS[data], bounds), pa.int64()),
                pa.array(per_text(SYMBOLS[data], bounds), pa.int64()), pa.array([duplicate_lines(t) for t in texts], pa.int64()),
                pa.array(repeats, pa.int64()), pa.array(failed), pa.array(kept, pa.bool_()),
                *[pa.array([figures[i] for _, figures in judged], pa.float64()) for i in range(4)], pa.array(why, pa.string()),
            ]
            parts.append(pa.StructArray.from_arrays(columns, names=RESULT.names))
        if not parts:
            return pa.array([], pa.struct([(f.name, pa.null()) for f in RESULT.fields]))
        return pa.concat_arrays(parts)

    # Not deterministic in Catalyst's sense, so that a filter on it does not run it twice.
    return judged.asNondeterministic()(text)


def with_quality(df: DataFrame, text_col: str = "text", out: str = "quality", bands: Bands = Bands()) -> DataFrame:
    """All rows and columns of ``df`` and the struct ``out``; a column of that name is replaced."""
    return df.withColumn(out, quality(F.col(f"`{text_col}`"), bands))


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows that pass; columns as before, whatever their names."""
    flag = "_quality"
    while flag in df.columns:
        flag += "_"
    return with_quality(df, text_col, flag, bands).filter(F.col(flag)["kept"]).drop(flag)
