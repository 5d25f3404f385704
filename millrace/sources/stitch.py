"""Records of large files whose records span lines: arrays of objects and quoted delimited text.

Spark's text source cuts a file into line-aligned splits wherever they fall, so a split may begin
inside an array, an object or a quoted field. Two passes put that right without reading a file in
one task:

1. every split is scanned once and leaves a summary of what it does to the state, whichever state
   it begins in (how deep in brackets, inside quotes or not), and how many records it opens;
2. the summaries of a file, one row per split, are combined in order by a running sum. Each split is
   scanned again from its true state and hands out its records. Records that end where they began
   are done; only the pieces at the edges of splits are shuffled and put together.

Compressed files have a single split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small, ensure_checkpoint_dir, plan_bytes

CHUNK_BYTES = 4 << 20
QUOTE, BACKSLASH, COMMA, NEWLINE = b'"\\,\n'
OPENING, CLOSING = b"[{", b"]}"


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, block, value``: lines as bytes, ended by a line feed only. ``block`` is the start of
    the split a line was read from; within a split rows come in the order of the file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, list[bytes]]]:
    """``(file, block, further columns, lines)`` in chunks of bounded bytes; a chunk is of one split."""
    for batch in batches:
        files, blocks, values = batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist()
        more = {n: batch[n].to_pylist() for n in batch.schema.names if n not in ("file", "block", "value")}
        at = 0
        for i in range(1, len(files) + 1):
            held = sum(len(v or b"") for v in values[at:i]) if i == len(files) or i % 512 == 0 else 0
            if i == len(files) or files[i] != files[at] or blocks[i] != blocks[at] or held > CHUNK_BYTES:
                yield files[at], blocks[at], {n: v[at] for n, v in more.items()}, [v or b"" for v in values[at:i]]
                at = i


# ---- arrays ------------------------------------------------------------------------------------
def outside_strings(data: np.ndarray) -> np.ndarray:
    """Bytes that are not part of a JSON string; a string never goes beyond its line."""
    where = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data == BACKSLASH, -1, where)) if len(data) else where
    quotes = np.flatnonzero(data == QUOTE)
    # A quote after an odd number of backslashes is part of the string.
    before = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)
    real = np.zeros(len(data), dtype=np.int64)
    real[quotes[before % 2 == 0]] = 1
    opened = np.cumsum(real)
    ends = np.flatnonzero(data == NEWLINE)
    starts = np.concatenate(([0], ends + 1))
    sizes = np.diff(np.concatenate((starts, [len(data)])))
    at_start = np.concatenate(([0], opened))[starts]
    return ((opened - np.repeat(at_start, sizes)) % 2 == 0) & (data != QUOTE)


def depth_steps(lines: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Joined lines, depth after each byte relative to the start, bytes outside of strings."""
    raw = b"\n".join(lines) + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    free = outside_strings(data)
    step = np.isin(data, np.frombuffer(OPENING, np.uint8)).astype(np.int64) - np.isin(data, np.frombuffer(CLOSING, np.uint8))
    return raw, np.cumsum(np.where(free, step, 0)), free


@dataclass
class ArraySummary:
    """What a split does to the depth, and how many items it opens by the depth they lie at."""

    depth: int = 0
    opened: Counter = field(default_factory=Counter)

    def add(self, lines: list[bytes]) -> None:
        raw, depth, free = depth_steps(lines)
        data = np.frombuffer(raw, dtype=np.uint8)
        cuts = free & ((data == COMMA) | (data == OPENING[0]))
        for level, n in zip(*np.unique(depth[cuts] + self.depth, return_counts=True)):
            self.opened[int(level)] += int(n)
        self.depth += int(depth[-1])

    def rows(self) -> list[tuple]:
        return [(self.depth, level, n) for level, n in self.opened.items()] or [(self.depth, 0, 0)]


class ArrayCutter:
    """Cuts the lines of a split into items, given the depth and the number of items before it."""

    def __init__(self, depth: int, items: int):
        self.depth, self.item, self.pending, self.first = depth, items, [], True

    def add(self, lines: list[bytes]) -> Iterator[tuple[int, bytes, bool]]:
        """``(item, text, whole)``"""
        raw, depth, free = depth_steps(lines)
        data = np.frombuffer(raw, dtype=np.uint8)
        depth = depth + self.depth
        opens = free & (depth == 1) & ((data == COMMA) | (data == OPENING[0]))
        ends = free & (depth == 0) & (data == CLOSING[0])
        at = 0
        for cut in np.flatnonzero(opens | ends).tolist():
            self.pending.append(raw[at:cut])
            yield from self.flush(True)
            self.item += bool(opens[cut])
            at = cut + 1
        self.pending.append(raw[at:])
        self.depth = int(depth[-1])

    def flush(self, ended: bool) -> Iterator[tuple[int, bytes, bool]]:
        text, whole = b"".join(self.pending).strip(), ended and not self.first
        self.pending, self.first = [], self.first and not ended
        if text:
            yield self.item, text, whole

    def end(self) -> Iterator[tuple[int, bytes, bool]]:
        yield from self.flush(False)


# ---- delimited text ----------------------------------------------------------------------------
class QuoteScanner:
    """Whether a line ends inside a quoted field. A quote opens a field only at its start."""

    def __init__(self, separator: str):
        self.opening = re.compile(b"(?:^|" + re.escape(separator.encode()) + b')"')
        self.later = re.compile(re.escape(separator.encode()) + b'"')
        self.inner = re.compile(rb'(?:[^"]|"")*+')

    def ends_inside(self, line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at, opening = 0, self.opening
        while True:
            if not inside:
                found = opening.search(line, at)
                if not found:
                    return False
                at = found.end()
            at = self.inner.match(line, at).end()
            if at == len(line):
                return True
            at, inside, opening = at + 1, False, self.later


@dataclass
class QuoteSummary:
    """End state and number of opened records for a split that begins outside and inside quotes."""

    scanner: QuoteScanner
    inside: list[bool] = field(default_factory=lambda: [False, True])
    opened: list[int] = field(default_factory=lambda: [0, 0])

    def add(self, lines: list[bytes]) -> None:
        for line in lines:
            before = self.inside
            same = before[0] == before[1]
            first = self.scanner.ends_inside(line, before[0])
            self.inside = [first, first if same else self.scanner.ends_inside(line, before[1])]
            self.opened = [n + (not state) for n, state in zip(self.opened, before)]

    def rows(self) -> list[tuple]:
        return [(int(inside), start, n) for start, (inside, n) in enumerate(zip(self.inside, self.opened))]


class QuoteCutter:
    """Cuts the lines of a split into records; ``items`` records were opened before it."""

    def __init__(self, scanner: QuoteScanner, inside: int, items: int):
        self.scanner, self.inside, self.item, self.pending, self.whole = scanner, bool(inside), items, [], not inside

    def add(self, lines: list[bytes]) -> Iterator[tuple[int, bytes, bool]]:
        for line in lines:
            if not self.inside:
                self.item += 1
            self.pending.append(line)
            self.inside = self.scanner.ends_inside(line, self.inside)
            if not self.inside:
                yield self.item, b"\n".join(self.pending), self.whole
                self.pending, self.whole = [], True

    def end(self) -> Iterator[tuple[int, bytes, bool]]:
        if self.pending:
            yield self.item, b"\n".join(self.pending), False


# ---- the two passes ----------------------------------------------------------------------------
def summaries(lines: DataFrame, new: Callable) -> DataFrame:
    """``file, block, ends, start, n, utf8``: rows of each split's summary."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, utf8 = {}, {}
        for file, block, _, chunk in runs_of_blocks(batches):
            done.setdefault((file, block), new()).add(chunk)
            utf8[file, block] = utf8.get((file, block), True) and is_utf8(b"\n".join(chunk))
        rows = [(*key, *row, utf8[key]) for key, summary in done.items() for row in summary.rows()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "ends", "start", "n", "utf8"])

    return lines.mapInArrow(go, "file string, block long, ends long, start long, n long, utf8 boolean")


def is_utf8(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def records(lines: DataFrame, states: DataFrame, new: Callable, other_encoding: str | None) -> DataFrame:
    """``file, item, value``: the records of ``lines`` (see :func:`text_lines`), numbered from 0 or 1
    in each file. ``states`` has ``file, block, state, items, utf8``."""
    numbered = lines.withColumn("nth", F.monotonically_increasing_id())
    known = numbered.join(broadcast_if_small(states), ["file", "block"])
    if plan_bytes(states) > DEFAULT_BROADCAST_BYTES:
        known = known.sortWithinPartitions("file", "block", "nth")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, encoding = None, None, "utf-8"

        def out(found) -> pa.RecordBatch:
            rows = [(*key, item, text.decode(encoding, "replace"), whole) for item, text, whole in found]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "item", "value", "whole"])

        for file, block, more, chunk in runs_of_blocks(batches):
            if key != (file, block):
                if cutter:
                    yield out(cutter.end())
                key, cutter = (file, block), new(more["state"], more["items"])
                encoding = "utf-8" if more["utf8"] or not other_encoding else other_encoding
            yield out(cutter.add(chunk))
        if cutter:
            yield out(cutter.end())

    pieces = known.select("file", "block", "value", "state", "items", "utf8").mapInArrow(go, "file string, block long, item long, value string, whole boolean")
    return pieces


def put_together(pieces: DataFrame) -> DataFrame:
    """``file, item, value``; a record in several splits is joined from its pieces, which are as many
    as it has splits."""
    whole = pieces.filter("whole").select("file", "item", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    cut = pieces.filter("NOT whole").groupBy("file", "item").agg(F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("value"))
    return whole.unionByName(cut)


def stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def before(column: Column) -> Column:
    """Sum over the splits of a file before this one."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(order), F.lit(0))


def array_items(lines: DataFrame) -> DataFrame:
    """``file, item, value``: the items of files that hold an array over several lines, as JSON text.

    Brackets inside strings do not count; a string ends with its line at the latest. Text outside of
    the array is an item too. Blank items are none."""
    found = summaries(lines, ArraySummary)
    levels = F.map_from_entries(F.collect_list(F.struct("start", "n")))
    blocks = found.groupBy("file", "block").agg(F.max("ends").alias("ends"), levels.alias("levels"), F.min("utf8").alias("utf8"))
    deep = blocks.withColumn("state", before(F.col("ends"))).withColumn("opened", F.coalesce(F.try_element_at("levels", 1 - F.col("state")), F.lit(0)))
    states = stored(deep.withColumn("items", before(F.col("opened"))).select("file", "block", "state", "items", "utf8"))
    return put_together(stored(records(lines, states, ArrayCutter, None)))


def delimited_records(lines: DataFrame, separator: str, other_encoding: str = "latin-1") -> DataFrame:
    """``file, item, value``: the records of delimited files, the header is item 1. A quoted field may
    hold line breaks. A file with bytes that are not UTF-8 is decoded as ``other_encoding`` whole."""
    found = summaries(lines, lambda: QuoteSummary(QuoteScanner(separator)))
    by_start = [F.max(F.when(F.col("start") == s, F.struct("ends", "n"))).alias(name) for s, name in enumerate(("outside", "inside"))]
    blocks = found.groupBy("file", "block").agg(*by_start, F.min("utf8").alias("utf8"))
    # A split that ends alike from both states sets the state; the others between it and this one
    # keep it or turn it over.
    blocks = blocks.withColumns({"sets": F.col("outside.ends") == F.col("inside.ends"), "turns": (F.col("outside.ends") == 1) & (F.col("inside.ends") == 0)})
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = blocks.withColumn("turned", F.coalesce(F.sum(F.when(F.col("turns"), 1).otherwise(0)).over(order), F.lit(0)))
    last = F.max(F.when(F.col("sets"), F.struct("block", "outside.ends", "turned"))).over(order)
    known = turned.withColumn("last", last)
    state = F.coalesce((F.col("last.ends") + F.col("turned") - F.col("last.turned")) % 2, F.col("turned") % 2)
    known = known.withColumn("state", state.cast("long"))
    opened = F.when(F.col("state") == 0, F.col("outside.n")).otherwise(F.col("inside.n"))
    utf8 = F.min("utf8").over(Window.partitionBy("file"))
    states = stored(known.withColumn("opened", opened).withColumn("items", before(F.col("opened"))).select("file", "block", "state", "items", utf8.alias("utf8")))
    return put_together(stored(records(lines, states, lambda inside, items: QuoteCutter(QuoteScanner(separator), inside, items), other_encoding)))
