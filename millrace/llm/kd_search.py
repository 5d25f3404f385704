"""Exact top-k inner-product search with KD-trees per shard.

Vectors are dealt into shards by a hash. A shard builds one KD-tree: nodes are split at the median
of their widest component until leaves are small, and every node keeps the tight bounding box of
its vectors. The score of a query with any vector in a box is at most the sum over components of
the larger product with the box's two ends, so nodes are visited best bound first and the search
of a shard ends when no bound beats the query's kth score.

A first pass searches each query in one shard, its own. The kth score found there goes along to
all other shards, so their searches begin with a bound. Both passes stream: a task holds one
shard's tree and meets its queries in batches, sorted behind the shard's vectors.

Queries against all rows in blocks is the stated work; it grows with queries times shards. A shard
meets at most ``query_rows`` queries in one task, more queries are dealt over copies of the shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.stage import stored

FOUND = "query_id long, vec_id long, copies long, score long"
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 5
    shard_rows: int = 16384
    query_rows: int = 65536
    leaf_rows: int = 128
    batch_rows: int = 512


class Tree:
    """KD-tree over the rows of ``points``; children of node i are in ``kids[i]``."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.points = points
        self.rows, self.kids, low, high = [], [], [], []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.rows)
            if parent is not None:
                self.kids[parent][side] = node
            own = points[rows]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            widest = int(np.argmax(high[-1] - low[-1]))
            self.kids.append([-1, -1])
            # Equal vectors cannot be parted; they stay one leaf and are scored at once.
            if len(rows) <= leaf_rows or high[-1][widest] == low[-1][widest]:
                self.rows.append(rows)
                continue
            self.rows.append(None)
            half = len(rows) // 2
            order = np.argpartition(own[:, widest], half)
            todo.append((rows[order[:half]], node, 0))
            todo.append((rows[order[half:]], node, 1))
        self.low, self.high = np.array(low), np.array(high)

    def search(self, queries: np.ndarray, ids: np.ndarray, kth: np.ndarray, own: np.ndarray, copies: np.ndarray, k: int):
        """``(query row, point row, score)`` of all points that can be among the k best.

        ``kth`` is the kth score known so far, -inf if fewer are known; ties may win by id, so a
        node is left out only if its bound is below. Nodes are opened best bound first; bounds of
        children are computed when their node is opened, and the search ends when the best open
        node is below the kth score.
        """
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        out = []
        for q in range(len(queries)):
            best = kth[q]
            have_score, have_row = np.empty(0, self.points.dtype), np.empty(0, np.int64)
            # Open nodes by falling bound; the second entry only keeps equal bounds apart.
            heap = [(-self.bound([0], positive[q], negative[q])[0], 0)]
            while heap and -heap[0][0] >= best:
                node = heapq.heappop(heap)[1]
                if self.rows[node] is None:
                    kids = self.kids[node]
                    for bound, kid in zip(self.bound(kids, positive[q], negative[q]), kids):
                        if bound >= best:
                            heapq.heappush(heap, (-bound, kid))
                    continue
                rows = self.rows[node]
                score = self.points[rows] @ queries[q]
                near = (score >= best) & (ids[rows] != own[q])
                if not near.any():
                    continue
                have_score = np.concatenate((have_score, score[near]))
                have_row = np.concatenate((have_row, rows[near]))
                order = by_score(have_score, ids[have_row])
                upto = np.searchsorted(np.cumsum(copies[have_row[order]]), k) + 1
                have_score, have_row = have_score[order[:upto]], have_row[order[:upto]]
                if copies[have_row].sum() >= k:
                    best = max(best, have_score[-1])
            out.append((np.full(len(have_row), q), have_row, have_score))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3

    def bound(self, nodes: list[int], positive: np.ndarray, negative: np.ndarray) -> list:
        """Upper bounds of the score with any vector below each node, of a query by its positive and
        its negative components."""
        return (self.high[nodes] @ positive + self.low[nodes] @ negative).tolist()


def by_score(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of falling scores, equal ones by rising id; scores may be Python integers."""
    rising = np.argsort(ids, kind="stable")
    return rising[np.argsort(-score[rising], kind="stable")]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, shorter ones filled up with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(vectors: np.ndarray, bound: float) -> np.ndarray:
    """Doubles while all sums of products are exact in them, else Python integers."""
    return vectors if bound < EXACT else np.vectorize(int, otypes=[object])(vectors) if vectors.size else vectors.astype(object)


def shard_search(settings: Settings, width: int, largest: float):
    """Arrow function over a partition sorted by shard, vectors before queries."""
    bound = largest * largest * max(width, 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree, ids, copies = None, [], None, None, None
        for batch in batches:
            key = np.stack([np.asarray(batch["shard"]), np.asarray(batch["part"])], axis=1)
            query = np.asarray(batch["is_query"].cast(pa.int8()))
            # Runs of one shard and one kind.
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (query[1:] != query[:-1])) + 1
            for s, e in zip([0, *change], [*change, batch.num_rows]):
                piece = batch.slice(s, e - s)
                if shard != tuple(key[s]):
                    shard, parts, tree = tuple(key[s]), [], None
                if not query[s]:
                    parts.append(piece)
                    continue
                if not parts and tree is None:
                    continue  # a query of a shard without vectors
                if tree is None:
                    points = exact(np.concatenate([matrix(p["vector"], width) for p in parts]), bound)
                    ids = np.concatenate([np.asarray(p["vec_id"]) for p in parts])
                    copies = np.concatenate([np.asarray(p["copies"]) for p in parts])
                    tree, parts = Tree(points, settings.leaf_rows), []
                for at in range(0, piece.num_rows, settings.batch_rows):
                    some = piece.slice(at, settings.batch_rows)
                    own = np.asarray(some["vec_id"])
                    kth = np.asarray(some["kth"].fill_null(-math.inf)).astype(np.float64)
                    q, row, score = tree.search(exact(matrix(some["vector"], width), bound), ids, kth, own, copies, settings.k)
                    whole = pa.array([min(max(int(x), -LONG), LONG) for x in score], pa.int64())
                    columns = [pa.array(own[q]), pa.array(ids[row]), pa.array(copies[row]), whole]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "copies", "score"])

    return search


def searched(vectors: DataFrame, queries: DataFrame, settings: Settings, width: int, largest: float) -> DataFrame:
    """Candidates of ``queries`` (``shard, part, vec_id, vector, kth``) in the shards of ``vectors``."""
    columns = ["shard", "part", "is_query", "vec_id", "vector", "copies", "kth"]
    left = vectors.withColumns({"is_query": F.lit(False), "kth": F.lit(None).cast("double")}).select(*columns)
    right = queries.withColumns({"is_query": F.lit(True), "copies": F.lit(1).cast("long")}).select(*columns)
    dealt = left.unionByName(right).repartition("shard", "part").sortWithinPartitions("shard", "part", "is_query")
    return dealt.mapInArrow(shard_search(settings, width, largest), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks; a vector of several equal rows takes several."""
    several = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = several.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``vec_id``, ``vector`` of ``floor(scale * x)`` and ``copies`` (equal rows). Rows with a null id
    or vector, or with a null or non-finite component, take no part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & sound)
    # NaN counts as larger than infinity in Spark, so it fails the test as well.
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("vector")).groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the k best rows by inner product for
    each row whose id is divisible by ``every``, rows of the query's own id left out; ties go to
    the smaller id.

    Vectors of different lengths are filled up with zeros. Equal rows are candidates each; equal
    query rows are one query, and rows of one id with different vectors share its list. With fewer
    than k candidates all are returned; an empty table gives an empty result. Sums beyond 2^53 are
    computed in integers; components and scores beyond a long are cut to its limits.
    """
    rows = stored(quantised(df, id_col, vector_col), "vectors")
    size = rows.agg(
        F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"),
    ).first()
    shards = max(1, math.ceil((size.n or 0) / settings.shard_rows))
    parts = max(1, math.ceil((size.q or 0) / settings.query_rows))
    width, largest = size.width or 0, float(size.largest or 0.0)
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard")
    vectors = rows.select(shard, F.lit(0).alias("part"), "vec_id", "vector", "copies")
    queries = rows.filter(F.col("vec_id") % every == 0).select(shard, "vec_id", "vector")
    none = F.lit(None).cast("double").alias("kth")
    home = stored(searched(vectors, queries.select("shard", F.lit(0).alias("part"), "vec_id", "vector", none), settings, width, largest), "home")
    if shards == 1:
        return best(home, settings.k)
    kth = best(home, settings.k).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("worst"))
    bounds = kth.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= settings.k, F.col("worst")).cast("double").alias("kth"))
    elsewhere = queries.join(bounds, "vec_id", "left").withColumnRenamed("shard", "home")
    elsewhere = elsewhere.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter("shard <> home")
    elsewhere = elsewhere.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(parts)).cast("int"))
    copied = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rest = searched(copied, elsewhere.select("shard", "part", "vec_id", "vector", "kth"), settings, width, largest)
    return best(home.unionByName(rest), settings.k)
