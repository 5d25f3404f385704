"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a row of it should be taken ``target / size of its
source`` times. The whole part of that is certain. The fractional parts are rounded together:
rows exchange mass so that the words they stand for stay the same, in a random direction that keeps
each row's expectation, until one of them is 0 or 1.

Rows are settled from the largest to the smallest, each against a pool of the next smaller ones
that move together, so what stays fractional at the end is a small row and a source comes near its
target. What is left of each block of rows is one fractional row; these go on to the next level of
the tree, until one row a source is left, which is rounded alone. Rows that are larger than what the
pool of a block can move are settled before, against the whole rest of their source: only one
number comes back to the blocks, how far all fractions of the source are shifted. Where the words of a
large row cannot be made up for in one of the two directions, it goes the other way: the target
comes before the odds. Each row is taken whole-part or whole-part plus one times.

Blocks are dealt by a hash of the row, so a source with a third of all rows is as many blocks as
others of its size together; every task holds one block of bounded size. All random draws are
hashes of row keys and the seed: reruns and recomputed partitions agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import wordscan as W
from millrace.llm.stage import stored

WEIGHTS = (5, 2, 1)
CAP = 3.0
BLOCK_ROWS = 4096
#: A source has no more shares of its pool than this; rows beyond a share are settled before.
POOL_SHARES = 256
POOL_ROWS = 64
#: The number that the draws of large rows take in place of a level of the tree.
LARGE_LEVEL = 999_999
COLUMNS = ["source", "key", "tie", "row", "size"]
STATE = "source string, key long, tie long, row long, size long, blocks long, p double, chosen long"
LARGE = "source string, key long, tie long, row long, chosen long, shift double"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sources`` (``source``, ``source_size``; one row a source) with ``target``.

    Sources in order of their code points, null last, weigh ``weights`` in turn and share the sum
    of all sizes; a target stops at ``cap`` times the size of its source and the excess is shared
    by weight among the rest. In order of ``cap * size / weight`` the stopped sources are a prefix,
    so running sums give the level at which the rest share. The windows run over one row a source.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy(F.lit(1))
    before = whole.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", free / rest)
    # The level of the first source that it does not stop; all are stopped only if nothing is left.
    found = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(whole)
    target = F.least("limit", F.col("weight") * F.coalesce(found["level"], F.lit(float("inf"))))
    return levelled.withColumn("target", target).select("source", "source_size", "target")


def row_hash(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(1), f"`{id_col}`", f"`{text_col}`", F.col(f"`{source_col}`").cast("string"))


def draws(key: np.ndarray, level: int, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row keys."""
    salt = W.mix(np.array([seed * 1_000_003 + level], dtype=np.uint64))[0]
    return (W.mix(np.ascontiguousarray(key).view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def exchange(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> int | None:
    """Round ``p`` in place, rows by falling size; the place of a row that stays fractional, or None.

    A row goes to 1 with odds ``p``, else to 0, and the pool of the next fractional rows takes or
    gives its words: every pool row moves by the same share of its distance to the nearer end, so
    words and all expectations are kept. If all later rows together cannot move that far, they move
    by what they have in the direction that is possible, or that comes closer.
    """
    for i in range(len(p)):
        a, s = p[i], size[i]
        if not 0.0 < a < 1.0:
            continue
        gain, loss = (1.0 - a) * s, a * s  # words of the row at 1 and at 0
        pool, moved, reach = np.empty(0, np.int64), 0.0, i + 1
        while moved < max(gain, loss) and reach < len(p):
            later = np.arange(reach, min(reach + POOL_ROWS, len(p)))
            later = later[(p[later] > 0.0) & (p[later] < 1.0)]
            pool, reach = np.concatenate((pool, later)), reach + POOL_ROWS
            moved = float((size[pool] * np.minimum(p[pool], 1.0 - p[pool])).sum())
        if not len(pool):
            return i
        own, words = p[pool], size[pool]
        if moved >= max(gain, loss):
            up = u[i] < a
            step = -gain / moved if up else loss / moved
            p[pool] = own + step * np.minimum(own, 1.0 - own)
        else:
            give, take = float((words * own).sum()), float((words * (1.0 - own)).sum())
            possible = give >= gain, take >= loss
            up = u[i] < a if all(possible) else possible[0] if any(possible) else gain - give < loss - take
            p[pool] = own * (1.0 - min(1.0, gain / give)) if up else own + (1.0 - own) * min(1.0, loss / take)
        p[i] = float(up)
        np.clip(p, 0.0, 1.0, out=p)
    return None


def row_keys(block: pa.Table | pa.RecordBatch) -> np.ndarray:
    """One key a row; the rows of equal key, tie and row do not occur."""
    key, tie, row = (np.asarray(block[c]) for c in ("key", "tie", "row"))
    return key ^ tie ^ W.mix(row).view(np.int64)


def rounding_step(level: int, seed: int):
    """Arrow function over one block: settled rows get ``chosen`` 0 or 1, the residual none."""

    def step(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("key", "ascending"), ("tie", "ascending"), ("row", "ascending")])
        p, keys = block["p"].to_numpy().copy(), row_keys(block)
        left = exchange(p, block["size"].to_numpy().astype(np.float64), draws(keys, 2 * level, seed))
        if left is not None and block["blocks"][0].as_py() == 1:
            p[left] = float(draws(keys[left : left + 1], 2 * level + 1, seed)[0] < p[left])
            left = None
        chosen = [int(x) if i != left else None for i, x in enumerate(p.tolist())]
        columns = [block[c] for c in (*COLUMNS, "blocks")]
        return pa.table([*columns, pa.array(p, pa.float64()), pa.array(chosen, pa.int64())], names=[*COLUMNS, "blocks", "p", "chosen"])

    return step


def settle_large(seed: int):
    """Arrow function over the large rows of whole sources, by falling size: ``chosen`` of each, and
    the shift of the source's pool so far. A shift of 1 moves every pool row by its distance to the
    nearer end. Nothing is held but the words that are owed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, owed = object(), 0.0
        for batch in batches:
            sources, size, p, moved = (batch[c].to_pylist() for c in ("source", "size", "p", "moved"))
            chosen, shifts = [], []
            for s, n, a, w, u in zip(sources, size, p, moved, draws(row_keys(batch), LARGE_LEVEL, seed).tolist()):
                if s != source:
                    source, owed = s, 0.0
                up, down = owed + (1.0 - a) * n, owed - a * n
                taken = u < a if max(abs(up), abs(down)) <= w else abs(up) < abs(down)
                owed = up if taken else down
                chosen.append(int(taken))
                shifts.append(-max(-1.0, min(1.0, owed / w)) if w > 0 else 0.0)
            columns = [batch[c] for c in COLUMNS[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen, pa.int64()), pa.array(shifts, pa.float64())], names=[*COLUMNS[:-1], "chosen", "shift"])

    return go


def numbered(df: DataFrame, count: str, row: str, span: int = 1 << 16) -> DataFrame:
    """Each row ``count`` times with the numbers from 1 in ``row``; arrays stay below ``span``."""
    high = df.withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / span))))
    first, end = F.col("_high") * span + 1, F.least((F.col("_high") + 1) * span, F.col(count))
    return high.withColumn(row, F.explode(F.sequence(first, end))).drop("_high")


def distance() -> Column:
    """Words a row can move in either direction."""
    return F.col("size") * F.least(F.col("p"), 1 - F.col("p"))


def without_large(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Fractional rows less the large ones of sources of several blocks, with their fractions shifted;
    and ``(key, tie, row, chosen)`` of the large ones."""
    per_source = rows.filter("blocks > 1").groupBy("source").agg((F.sum(distance()) / F.least(F.max("blocks"), F.lit(POOL_SHARES))).alias("share"))
    of = per_source.withColumnRenamed("source", "of")
    marked = rows.join(of, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("large", F.coalesce(F.col("size") > F.col("share"), F.lit(False)))
    marked = stored(marked.drop("of", "share"), "marked")
    pools = marked.filter("NOT large").groupBy(F.col("source").alias("of")).agg(F.sum(distance()).alias("moved"))
    large = marked.filter("large").join(pools, F.col("source").eqNullSafe(F.col("of")), "left").select(*COLUMNS, "p", F.coalesce("moved", F.lit(0.0)).alias("moved"))
    in_order = large.repartition("source").sortWithinPartitions("source", F.desc("size"), "key", "tie", "row")
    settled = stored(in_order.select(*COLUMNS, "p", "moved").mapInArrow(settle_large(seed), LARGE), "large")
    # The last shift of a source is that of its smallest large row, which came last.
    ends = settled.join(large.select("key", "tie", "row", "size"), ["key", "tie", "row"])
    least = F.struct((-F.col("size")).alias("size"), "key", "tie", "row")
    shifts = ends.groupBy(F.col("source").alias("of")).agg(F.max_by("shift", least).alias("shift"))
    near = F.least(F.col("p"), 1 - F.col("p"))
    rest = marked.filter("NOT large").join(shifts, F.col("source").eqNullSafe(F.col("of")), "left")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce("shift", F.lit(0.0)) * near))
    return rest.withColumn("p", moved).select(*COLUMNS, "blocks", "p"), settled.select("key", "tie", "row", "chosen")


def rounded(rows: DataFrame, most: int, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """``(key, tie, row, chosen)`` of fractional rows (``source, key, tie, row, size, blocks, p``);
    ``blocks`` is the number of blocks of the row's source, ``most`` that of the largest one."""
    done, level = None, 0
    if most > 1:
        rows, done = without_large(rows, seed)
    rows = rows.withColumn("chosen", F.lit(None).cast("long"))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "key", "tie", "row"), F.col("blocks")))
        step = dealt.groupBy("source", "block").applyInArrow(rounding_step(level, seed), STATE)
        settled = step if most == 1 else stored(step, f"rounding-{level}")
        part = settled.filter("chosen IS NOT NULL").select("key", "tie", "row", "chosen")
        done = part if done is None else done.unionByName(part)
        if most == 1:
            return done
        # A block leaves one row at most.
        rows = settled.filter("chosen IS NULL").withColumn("blocks", F.ceil(F.col("blocks") / block_rows))
        most, level = math.ceil(most / block_rows), level + 1


def mix(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block_rows: int = BLOCK_ROWS, seed: int = 0,
) -> DataFrame:
    """``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``
    (words), one row per row of ``df``; ``_text``, ``_tie`` (hashes of the text, and of id, text
    and source), ``_row`` and ``same`` tell which of ``same`` equal rows it is.

    Null texts have size 0; rows of size 0 are taken no times. A null source is a source of its
    own. A null id counts as any other id. Rows equal in id, text and source are told apart by a number
    within their group. If nothing has words all targets are 0. An empty table gives an empty one.
    """
    slim = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(f"`{text_col}`").alias("key"), row_hash(id_col, text_col, source_col).alias("tie"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    # Equal rows become one row with a count, and are numbered when they are handed back.
    sized = stored(slim.groupBy("id", "source", "key", "tie").agg(F.first("size").alias("size"), F.count("*").alias("same")), "sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.sum("same").alias("rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    targets = targets.join(totals.select(F.col("source").alias("of"), F.ceil(F.col("rows") / block_rows).alias("blocks")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    most = totals.agg(F.ceil(F.max("rows") / block_rows)).first()[0] or 1
    rows = numbered(sized, "same", "row")
    # One row a source; whether it is small enough to broadcast is left to adaptive execution.
    renamed = targets.withColumnRenamed("source", "target_source")
    rows = rows.join(renamed, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = stored(rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")), "rates")
    part = rows.filter("p > 0").select(*COLUMNS, "blocks", "p")
    extra = rounded(part, most, block_rows, seed).withColumnRenamed("chosen", "extra")
    out = rows.join(extra, ["key", "tie", "row"], "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "source", F.col("key").alias("_text"), F.col("tie").alias("_tie"), F.col("row").alias("_row"),
        "same", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """Every row of ``df`` as often as the mix takes it, with the columns of ``df``."""
    free = "_mix"
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    plan = mix(df, text_col, id_col, source_col, **settings).filter("copies > 0")
    wanted = plan.select(*[F.col(c).alias(f"{free}_{c.strip('_')}") for c in ("_text", "_tie", "_row", "same", "copies")])
    text, tie, row, same, copies = wanted.columns
    own = [f"{c}_own" for c in (text, tie, row)]
    keyed = df.withColumns({own[0]: F.xxhash64(f"`{text_col}`"), own[1]: row_hash(id_col, text_col, source_col)})
    like = (F.col(own[0]) == F.col(text)) & (F.col(own[1]) == F.col(tie))
    columns = [F.col(f"`{c}`") for c in df.columns]
    single = keyed.join(wanted.filter(F.col(same) == 1), like).select(*columns, copies)
    # Equal rows are few; only they are numbered.
    several = wanted.filter(F.col(same) > 1)
    groups = several.select(text, tie).distinct()
    order = Window.partitionBy(*own[:2]).orderBy(own[0])
    repeated = keyed.join(groups, like).drop(text, tie).withColumn(own[2], F.row_number().over(order))
    repeated = repeated.join(several, like & (F.col(own[2]) == F.col(row))).select(*columns, copies)
    both = single.unionByName(repeated)
    return numbered(both, copies, f"{free}_nth").select(*columns)
