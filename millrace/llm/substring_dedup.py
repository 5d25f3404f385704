"""Substring dedup: seed and extend.

A window is a run of ``length`` consecutive words of one text. Words covered by a window whose
word sequence starts anywhere else too are removed.

Seeds. Runs of ``seed`` words are hashed and winnowed: of the runs inside one window, the first
with the smallest hash is the window's anchor. Equal windows have equal anchors at equal offsets,
so every repeat of ``length`` words or more shares an anchor, while only about one word in
``(length - seed) / 2`` is one. An anchor row holds the stretch of windows that chose the anchor
and a hash of all words of that stretch.

Joins. Anchors are counted by hash and joined back to those that occur more than once; the rest of
the text never leaves its place. Stretches that are equal as a whole, the inside of a long repeat,
are done at once, whatever their number.

Extension. What is left are stretches at the edge of a repeat: one per distinct stretch is
extended both ways to the windows it covers, and windows are compared by hash within an anchor.
Neighbouring repeated windows merge to maximal repeats.

No step lists the pairs of a group or holds one in a task: counts combine before they are
shuffled, and what joins back to them is one row per anchor or window. Texts are shuffled by their
own key, at most twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan as W
from millrace.llm.stage import stored

LENGTH = 35
SEED = 10

ANCHORS = T.ArrayType(
    T.StructType(
        [T.StructField("a", T.LongType(), False), T.StructField("c", T.LongType(), False)]
        + [T.StructField("lo", T.IntegerType(), False), T.StructField("hi", T.IntegerType(), False)]
    )
)
WINDOWS = T.ArrayType(T.StructType([T.StructField("a", T.LongType(), False), T.StructField("w", T.LongType(), False), T.StructField("i", T.IntegerType(), False)]))
OUTCOME = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hashes of word sequences; the two values of ``which`` are independent."""
    sums, downs = W.prefix_hash(W.mix(h + np.uint64(which + 1)), W.SEQUENCE_BASES[which])
    return W.mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first minimum of every run of ``width`` values, by doubling the run."""
    n = len(values)
    best, span = np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def stretches(words: W.Words, length: int, seed: int):
    """Per stretch of windows with one anchor: text, anchor hash, content hash, first and last window.

    Windows are numbered by their first word within the text."""
    n = len(words.starts)
    empty = np.empty(0, dtype=np.int64)
    if n < length:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    h, text = words.hashes(), words.text_of_word()
    at = np.arange(n - seed + 1)
    grams = sequence_hashes(h, at, at + seed, 0)
    anchor = first_smallest(grams, length - seed + 1)
    valid = np.flatnonzero(text[length - 1 :] == text[: n - length + 1])
    anchor, owner = anchor[valid], text[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(valid)) - 1 if len(begin) else begin
    lo, hi = valid[begin], valid[end]
    # The place of the anchor in the stretch follows from the words of the stretch.
    content = sequence_hashes(h, lo, hi + length, 1)
    first = words.first[owner[begin]]
    return owner[begin], grams[anchor[begin]], content, lo - first, hi - first


def lists(owner: np.ndarray, rows: int, columns: list[pa.Array], names: list[str]) -> pa.Array:
    """List column with ``rows`` lists from flat columns whose rows are sorted by owner."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=names))


def anchors(text: Column, length: int = LENGTH, seed: int = SEED) -> Column:
    @F.arrow_udf(ANCHORS)
    def found(column: pa.Array) -> pa.Array:
        parts = []
        for row, data, bounds in W.slices(column):
            owner, *rest = stretches(W.find_words(data, bounds), length, seed)
            parts.append((owner + row, *rest))
        owner, a, c, lo, hi = (np.concatenate(x) for x in zip(*parts)) if parts else stretches(W.find_words(*W.text_buffers(column)), length, seed)
        return lists(owner, len(column), [W.as_long(a), W.as_long(c), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["a", "c", "lo", "hi"])

    return found(text)


def windows(text: Column, edges: Column, length: int = LENGTH) -> Column:
    """The windows of the stretches in ``edges`` (``array<struct<a, lo, hi>>``) with their hashes."""

    @F.arrow_udf(WINDOWS)
    def extended(column: pa.Array, wanted: pa.Array) -> pa.Array:
        flat = wanted.flatten()
        bounds_of = np.concatenate(([0], np.cumsum(np.asarray(wanted.value_lengths()))))
        a, lo, hi = (np.asarray(flat.field(k)) for k in ("a", "lo", "hi"))
        outs = []
        for row, data, bounds in W.slices(column):
            words = W.find_words(data, bounds)
            s, e = bounds_of[row], bounds_of[row + len(bounds) - 1]
            if s == e:
                continue
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds_of[row : row + len(bounds)]))
            count = hi[s:e] - lo[s:e] + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i = np.repeat(lo[s:e], count) + step
            start = i + np.repeat(words.first[owner], count)
            w = sequence_hashes(words.hashes(), start, start + length, 1)
            outs.append((np.repeat(owner + row, count), np.repeat(a[s:e], count), w, i))
        if outs:
            owner, aa, w, i = (np.concatenate(x) for x in zip(*outs))
        else:
            owner, aa, w, i = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return lists(owner, len(column), [pa.array(aa, pa.int64()), W.as_long(w), pa.array(i, pa.int32())], ["a", "w", "i"])

    return extended(text, edges)


def covered(words: W.Words, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window of the given ranges of windows."""
    n = len(words.starts)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, words.first[owner] + lo, 1)
    np.add.at(change, words.first[owner] + hi + length, -1)
    return np.cumsum(change[:n]) > 0


def batch_cover(column: pa.Array, ranges: pa.Array, length: int):
    """``(row, words, removed flags)`` of slices of a batch."""
    counts = np.asarray(ranges.value_lengths().fill_null(0))
    flat = ranges.flatten()
    lo, hi = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
    bounds_of = np.concatenate(([0], np.cumsum(counts)))
    for row, data, bounds in W.slices(column):
        words = W.find_words(data, bounds)
        to = row + len(bounds) - 1
        owner = np.repeat(np.arange(len(bounds) - 1), counts[row:to])
        s, e = bounds_of[row], bounds_of[to]
        yield row, words, covered(words, owner, lo[s:e], hi[s:e], length)


def digest(text: Column, ranges: Column, length: int = LENGTH) -> Column:
    """Word counts and the hash of the kept words joined by one space."""

    @F.arrow_udf(OUTCOME)
    def summed(column: pa.Array, removed: pa.Array) -> pa.Array:
        n_words, n_removed, shas = [], [], []
        for _, words, gone in batch_cover(column, removed, length):
            raw = words.data.tobytes()
            sums = np.concatenate(([0], np.cumsum(gone)))
            dropped = sums[words.first[1:]] - sums[words.first[:-1]]
            n_words += words.counts.tolist()
            n_removed += dropped.tolist()
            for d in range(len(words.bounds) - 1):
                if dropped[d]:
                    own = slice(words.first[d], words.first[d + 1])
                    stay = ~gone[own]
                    kept = [raw[s:e] for s, e in zip(words.starts[own][stay].tolist(), words.ends[own][stay].tolist())]
                else:
                    kept = raw[words.bounds[d] : words.bounds[d + 1]].split()
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
        return pa.StructArray.from_arrays(columns, names=OUTCOME.names)

    return summed.asNondeterministic()(text, ranges)


def cut(text: Column, ranges: Column, length: int = LENGTH) -> Column:
    """The text without its repeated words and the white space that follows each of them; a text
    without repeats, or null, is returned unchanged."""

    @F.arrow_udf(T.StringType())
    def remainder(column: pa.Array, removed: pa.Array) -> pa.Array:
        out = [None] * len(column)
        for row, words, gone in batch_cover(column, removed, length):
            raw = words.data.tobytes()
            for d in range(len(words.bounds) - 1):
                own = slice(words.first[d], words.first[d + 1])
                flags, begin, end = gone[own], int(words.bounds[d]), int(words.bounds[d + 1])
                if not flags.any():
                    out[row + d] = raw[begin:end].decode()
                    continue
                starts = words.starts[own]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
                pieces, at = [], begin
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    pieces.append(raw[at : starts[s]])
                    at = int(starts[e]) if e < len(starts) else end
                pieces.append(raw[at:end])
                out[row + d] = b"".join(pieces).decode()
        result = pa.array(out, pa.string())
        return result if not column.null_count else pc.if_else(column.is_null(), pa.scalar(None, pa.string()), result)

    return remainder.asNondeterministic()(text, ranges)


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(k1, k2, removed)``: per text the ranges of windows that occur elsewhere too.

    ``keyed`` has ``k1``, ``k2``, ``text``. Rows with equal keys hold equal texts and count as
    separate places."""
    rows = keyed.select("k1", "k2", F.explode(anchors(F.col("text"), length, seed)).alias("s"))
    rows = rows.select("k1", "k2", "s.a", "s.c", "s.lo", "s.hi")
    seen = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
    # Stored, so that the join shuffles both sides itself and can split the rows of a hot anchor.
    seen = stored(seen, "anchors")
    shared = stored(rows.join(seen.select("a", (F.col("low") != F.col("high")).alias("mixed")), "a"), "shared-anchors")
    mixed = shared.filter("mixed")
    one = F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")
    kinds = stored(mixed.groupBy("a", "c").agg(F.count("*").alias("n"), one), "stretches")
    whole = mixed.join(kinds.filter("n > 1").select("a", "c"), ["a", "c"])
    done = shared.filter("NOT mixed").select("k1", "k2", "lo", "hi").unionByName(whole.select("k1", "k2", "lo", "hi"))
    # One text per distinct stretch is extended; those of single stretches look for their windows.
    edges = kinds.select(F.col("one.k1"), F.col("one.k2"), F.struct("a", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi")).alias("edge"))
    edges = edges.groupBy("k1", "k2").agg(F.collect_list("edge").alias("edges"))
    texts = keyed.select("k1", "k2", "text").join(edges, ["k1", "k2"])
    extended = texts.select("k1", "k2", F.explode(windows(F.col("text"), F.col("edges"), length)).alias("s"))
    extended = stored(extended.select("k1", "k2", "s.a", "s.w", "s.i"), "windows")
    again = extended.groupBy("a", "w").agg(F.count("*").alias("n")).filter("n > 1").select("a", "w")
    again = stored(again, "repeated-windows")
    found = extended.join(again, ["a", "w"]).select("k1", "k2", F.col("i").alias("lo"), F.col("i").alias("hi"))
    return done.unionByName(found).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("removed"))


def with_ranges(df: DataFrame, text_col: str, id_col: str | None, length: int, seed: int) -> tuple[DataFrame, str]:
    """``df`` with the array of repeated window ranges in a column of a free name."""
    free = "_removed"
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    k1, k2 = f"{free}k1", f"{free}k2"
    # The id only spreads exact copies; rows that are equal in both share a key.
    salt = F.xxhash64(F.col(id_col), F.col(text_col)) if id_col else F.xxhash64(F.lit(1), F.col(text_col))
    keyed = df.withColumns({k1: F.xxhash64(F.col(text_col)), k2: salt})
    slim = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(slim, length, seed).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("removed").alias(free))
    return keyed.join(ranges, [k1, k2], "left"), free


def removal_digest(df: DataFrame, text_col: str = "text", id_col: str | None = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """All columns of ``df`` but the text, and ``n_words``, ``n_removed``, ``kept_sha256``.

    Null and empty texts have no words. Texts of fewer than ``length`` words lose nothing. Equal
    rows are places of their own, so all their windows repeat. An empty table gives an empty one.
    Columns of ``df`` named like a result column are replaced."""
    joined, free = with_ranges(df, text_col, id_col, length, seed)
    out = joined.withColumn(f"{free}out", digest(F.col(text_col), F.col(free), length))
    keep = [F.col(f"`{c}`") for c in df.columns if c != text_col and c not in OUTCOME.names]
    return out.select(*keep, F.col(f"{free}out.*"))


def without_repeats(df: DataFrame, text_col: str = "text", id_col: str | None = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``df``; the text lacks the repeated passages. A text that is one
    repeat altogether becomes empty."""
    joined, free = with_ranges(df, text_col, id_col, length, seed)
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(free), length)).select(*[F.col(f"`{c}`") for c in df.columns])
