"""Vector compression by product codes, with Lloyd rounds over partition-local cover trees.

Vectors become integers and are cut into equal parts; every part position has its own codebook. The
rows of a task are packed into blocks, and a block holds one cover tree per part: a node is a
centre and a radius that covers all points below it, the centres of its children lie more than half
its covering distance apart and each covers the points within that half. Points are kept in tree
order, so a subtree is a range and its sum is a difference of two cumulative sums.

A round goes down each tree from the root. If the nearest entry of a node's centre stays nearest by
more than twice the radius (the triangle inequality), the whole subtree is assigned with one
subtraction; only ambiguous nodes are opened, and only the points of ambiguous leaves are compared
exactly. A round moves one sum per entry and component and task, and the codebooks, which are as
large as ``entries`` vectors, whatever the number of rows. The trees are built and stored once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.kd_search import EXACT, LONG
from millrace.llm.stage import stored

TREES = "trees array<struct<points: array<bigint>, row: array<int>, start: array<int>, `end`: array<int>, radius: array<double>, first: array<int>, kids: array<int>>>"
NAMES = ["points", "row", "start", "end", "radius", "first", "kids"]
#: Room for the rounding of distances in doubles.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block_rows: int = 4096
    leaf_rows: int = 48


def numbers(points: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles while all sums of squares are exact in them, else Python integers."""
    return points.astype(np.float64) if exact else points.astype(object)


class Tree:
    """Cover tree in arrays: node i covers the points ``start[i]:end[i]`` of the tree order within
    ``radius[i]`` of the first of them, its centre; its children are ``first[i]`` to
    ``first[i] + kids[i] - 1``."""

    def __init__(self, points: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, radius: np.ndarray, first: np.ndarray, kids: np.ndarray):
        self.points, self.row, self.start, self.end, self.radius, self.first, self.kids = points, row, start, end, radius, first, kids

    @classmethod
    def build(cls, points: np.ndarray, leaf_rows: int) -> Tree:
        where = points.astype(np.float64)
        order = np.arange(len(points))
        start, end, radius, first, kids = [0], [len(points)], [], [], []
        node = 0
        while node < len(start):
            s, e = start[node], end[node]
            rows = order[s:e].copy()
            far = np.sqrt(((where[rows] - where[rows[0]]) ** 2).sum(axis=1))
            radius.append(float(far.max()))
            first.append(len(start))
            kids.append(0)
            if e - s > leaf_rows and radius[node] > 0:
                at = s
                for child in cover(where, rows, far, radius[node] / 2):
                    order[at : at + len(child)] = child
                    start.append(at)
                    end.append(at + len(child))
                    at += len(child)
                    kids[node] += 1
            node += 1
        whole = [np.array(x, dtype=np.int64) for x in (start, end)]
        return cls(points[order], order, *whole, np.array(radius), np.array(first, dtype=np.int64), np.array(kids, dtype=np.int64))

    def assign(self, codebook: np.ndarray) -> tuple[list, np.ndarray]:
        """``(start, end, entry)`` of the subtrees assigned whole, and the points left over."""
        sure, left = [], []
        level = np.zeros(min(1, len(self.start)), dtype=np.int64)
        while len(level):
            near = np.sqrt(distances(self.points[self.start[level]], codebook).astype(np.float64))
            best = near.argmin(axis=1)
            lowest = near[np.arange(len(level)), best]
            near[np.arange(len(level)), best] = np.inf
            apart = near.min(axis=1) - lowest > 2 * self.radius[level] + SLACK * (1 + lowest + self.radius[level])
            sure += zip(self.start[level[apart]].tolist(), self.end[level[apart]].tolist(), best[apart].tolist())
            level = level[~apart]
            leaf = self.kids[level] == 0
            left += [np.arange(self.start[n], self.end[n]) for n in level[leaf]]
            level = level[~leaf]
            level = np.concatenate([np.arange(self.first[n], self.first[n] + self.kids[n]) for n in level]) if len(level) else level
        return sure, np.concatenate(left) if left else np.empty(0, np.int64)

    def sums(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the points and their number for each entry."""
        cumulative = np.concatenate((np.zeros_like(self.points[:1]), np.cumsum(self.points, axis=0)))
        total, count = np.zeros_like(codebook), np.zeros(len(codebook), dtype=np.int64)
        sure, left = self.assign(codebook)
        for s, e, entry in sure:
            total[entry] += cumulative[e] - cumulative[s]
            count[entry] += e - s
        entry = distances(self.points[left], codebook).argmin(axis=1)
        np.add.at(total, entry, self.points[left])
        return total, count + np.bincount(entry, minlength=len(codebook))

    def codes(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the order the rows had before the tree."""
        entry = np.zeros(len(self.points), dtype=np.int64)
        sure, left = self.assign(codebook)
        for s, e, i in sure:
            entry[s:e] = i
        entry[left] = distances(self.points[left], codebook).argmin(axis=1)
        off = ((self.points - codebook[entry]) ** 2).sum(axis=1) if len(entry) else np.empty(0, self.points.dtype)
        out, error = np.empty_like(entry), np.empty_like(off)
        out[self.row], error[self.row] = entry, off
        return out, error


def cover(where: np.ndarray, rows: np.ndarray, far: np.ndarray, reach: float) -> Iterator[np.ndarray]:
    """Groups of ``rows``, each within ``reach`` of its first row; first rows lie further apart."""
    while len(rows):
        inside = far <= reach
        yield rows[inside]
        rows = rows[~inside]
        if len(rows):
            far = np.sqrt(((where[rows] - where[rows[0]]) ** 2).sum(axis=1))


def distances(points: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances ``[point, entry]``; ``argmin`` takes the lower index of equal ones."""
    out = np.zeros((len(points), len(codebook)), dtype=points.dtype)
    for i in range(codebook.shape[1]):
        out += (points[:, i, None] - codebook[None, :, i]) ** 2
    return out


def sound(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """``vec_id, label, vector`` of ``floor(scale * x)`` for the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    return df.filter(F.col(f"`{vector_col}`").isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), whole.alias("vector"))


def part_width(width: int, parts: int) -> int:
    return max(1, -(-width // parts))


def packed(rows: DataFrame, width: int, settings: Settings) -> DataFrame:
    """One row per block: ``vec_id`` and ``label`` as lists, and a tree per part."""
    per = part_width(width, settings.parts)
    fields = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(rows.schema["label"].dataType))])
    fields.add(T.StructType.fromDDL(TREES)[0])

    def block(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(pieces).combine_chunks()
        vectors = whole_matrix(own["vector"].combine_chunks(), per * settings.parts)
        trees = [Tree.build(vectors[:, p * per : (p + 1) * per], settings.leaf_rows) for p in range(settings.parts)]
        arrays = []
        for name in NAMES:
            values = [getattr(t, name).reshape(-1) for t in trees]
            kind = pa.float64() if name == "radius" else pa.int64() if name == "points" else pa.int32()
            arrays.append(pa.ListArray.from_arrays(offsets(map(len, values)), pa.array(np.concatenate(values), kind)))
        tree = pa.StructArray.from_arrays(arrays, names=NAMES)
        lists = [pa.ListArray.from_arrays(offsets([own.num_rows]), own[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(offsets([settings.parts]), tree)], names=["vec_id", "label", "trees"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, settings.block_rows):
                piece = batch.slice(at, settings.block_rows)
                if held + piece.num_rows > settings.block_rows:
                    yield block(pieces)
                    pieces, held = [], 0
                pieces.append(piece)
                held += piece.num_rows
        if held:
            yield block(pieces)

    return rows.mapInArrow(pack, fields)


def whole_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` longs, shorter ones filled up with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(list(sizes)))), pa.int32())


def trees_of(blocks: pa.RecordBatch, row: int, per: int, exact: bool) -> list[Tree]:
    """The trees of one block."""
    trees, out = blocks["trees"][row].values, []
    for p in range(len(trees)):
        points, row_of, start, end, radius, first, kids = (np.asarray(trees.field(name)[p].values) for name in NAMES)
        whole = [x.astype(np.int64) for x in (row_of, start, end, first, kids)]
        out.append(Tree(numbers(points.reshape(-1, per), exact), *whole[:3], radius, *whole[3:]))
    return out


def round_sums(blocks: DataFrame, codebooks: list[np.ndarray], per: int, exact: bool) -> DataFrame:
    """``part, entry, place, total, n``: sums of the points of each entry; ``n`` is their number."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [numbers(c, exact) for c in codebooks]
        totals, counts = [np.zeros(c.shape, dtype=object) for c in books], [np.zeros(len(c), dtype=np.int64) for c in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree in enumerate(trees_of(batch, row, per, exact)):
                    total, count = tree.sums(books[p])
                    totals[p] += np.vectorize(int, otypes=[object])(total)
                    counts[p] += count
        out = [(p, e, i, str(totals[p][e, i]), int(counts[p][e])) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for i in range(per)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["part", "entry", "place", "total", "n"])

    found = blocks.select("trees").mapInArrow(go, "part int, entry int, place int, total string, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def coded(blocks: DataFrame, codebooks: list[np.ndarray], per: int, exact: bool) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    label = blocks.schema["label"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [numbers(c, exact) for c in codebooks]
        for batch in batches:
            for row in range(batch.num_rows):
                found = [tree.codes(books[p]) for p, tree in enumerate(trees_of(batch, row, per, exact))]
                code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, e in found)
                text = code.tobytes().hex()
                step = 2 * code.shape[1]
                codes = [text[i : i + step] for i in range(0, len(text), step)]
                whole = pa.array([min(int(x), LONG) for x in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"][row].values, batch["label"][row].values, pa.array(codes), whole], names=schema.names)

    return blocks.mapInArrow(go, schema)


def trained(blocks: DataFrame, start: list[np.ndarray], per: int, exact: bool, rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds; what comes to the driver is one row per entry and component."""
    books = [c.copy() for c in start]
    for _ in range(rounds):
        for r in round_sums(blocks, books, per, exact).collect():
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", settings: Settings = Settings()) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` of every sound vector, and the codebooks (one array of entries
    by components per part).

    Rows with a null vector or with a null or non-finite component take no part. A codebook starts as
    the parts of the ``entries`` smallest ids; of equal ids the smaller vector comes first, rows
    without an id come last. With fewer rows the codebooks are shorter, with none they are empty and
    so is the result. Vectors of other lengths than the longest are filled up with zeros, as is the
    last part if the length is no multiple of ``parts``. Equal rows count each. Scaled components
    outside a long are cut to its limits, errors above it as well; sums that doubles cannot hold are
    computed in integers. Columns of other names take no part.
    """
    if not 1 <= settings.entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    rows = sound(df, id_col, vector_col, label_col, settings.scale)
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("largest")).first()
    per = part_width(facts.width or 0, settings.parts)
    # Differences are at most twice the largest component, a task's sums stay below a block's rows.
    largest = float(facts.largest or 0.0) + 1
    exact = 4 * largest * largest * per < EXACT and largest * settings.block_rows < EXACT
    smallest = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(settings.entries).collect()
    start = np.zeros((len(smallest), per * settings.parts), dtype=object)
    for i, r in enumerate(smallest):
        start[i, : len(r.vector)] = r.vector
    blocks = stored(packed(rows, facts.width or 0, settings), "trees")
    books = trained(blocks, [start[:, p * per : (p + 1) * per] for p in range(settings.parts)], per, exact, settings.rounds)
    return coded(blocks, books, per, exact), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of the errors of equal labels; nulls are one label."""
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
