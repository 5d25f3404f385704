"""Exact and near duplicates.

No step emits the pairs of a group: copies point at one representative, so a group
holding a third of all rows costs one row per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.functions import text as T
from millrace.session import ensure_checkpoint_dir

# --- Fixed values: the MinHash family (seed, prime and slot range of the public datasketch library)
MINHASH_SEED = 1
MERSENNE_PRIME = (1 << 61) - 1
MAX_SLOT = (1 << 32) - 1
NUM_HASHES = 128

#: Slots whose minima are one row of the aggregate.
PART_SLOTS = 64

#: Members of a band that are compared with each other, or with those of another block, in one task.
BLOCK = 1024
#: Records besides the smallest id that the members of a band larger than a block are compared with first.
LEADERS = 16


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """``(key, keep, copies)`` of the keys that occur more than once."""
    return df.groupBy(key).agg(F.min(id_col).alias("keep"), F.count("*").alias("copies")).filter("copies > 1")


def surplus_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Ids of all copies but the first."""
    slim = df.select(key, id_col)
    groups = duplicate_groups(slim, key, id_col).select(key, "keep")
    return slim.join(groups, key).filter(F.col(id_col) != F.col("keep")).select(id_col)


def drop_exact_duplicates(df: DataFrame, key: str = "_id_hash", id_col: str = "doc_id") -> DataFrame:
    """The first record of every key. Only keys and ids are compared; the usually short list
    of surplus ids is what the records are then matched against."""
    return df.join(surplus_ids(df, key, id_col), id_col, "left_anti")


def hash_family(count: int) -> list[tuple[int, int]]:
    """Factor and summand of each hash."""
    state = np.random.RandomState(MINHASH_SEED)
    return [
        (int(state.randint(1, MERSENNE_PRIME, dtype=np.uint64)), int(state.randint(0, MERSENNE_PRIME, dtype=np.uint64)))
        for _ in range(count)
    ]


def item_code(item: Column) -> Column:
    """The first four bytes of the item's SHA-1, the lowest first, as a number below 2^32."""
    return swapped(F.conv(F.substring(F.sha1(item), 1, 8), 16, 10).cast("long"))


def swapped(code: Column) -> Column:
    """The four bytes of a number below 2^32 in the other order."""
    low, high = code.bitwiseAND(F.lit(0xFF00FF)), F.shiftright(code, 8).bitwiseAND(F.lit(0xFF00FF))
    pairs = F.shiftleft(low, 8).bitwiseOR(high)
    return F.shiftleft(pairs, 16).bitwiseAND(F.lit(MAX_SLOT)).bitwiseOR(F.shiftright(pairs, 16))


@contextmanager
def wrapping_integers(spark: SparkSession) -> Iterator[None]:
    """Column arithmetic built inside wraps around at 64 bits, as these hashes need; outside it is
    checked again. The mode is taken when an expression is built, not when it runs."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slot(code: Column, factor: Column, summand: Column) -> Column:
    """``((factor * code + summand) mod 2^64) mod (2^61 - 1)``, cut to 32 bits. The product wraps; the
    Mersenne prime needs shifts and masks only."""
    product = code * factor + summand
    rest = product.bitwiseAND(F.lit(MERSENNE_PRIME)) + F.shiftrightunsigned(product, 61)
    return (rest + F.shiftrightunsigned(rest + 1, 61)).bitwiseAND(F.lit(MAX_SLOT))


def minhash(df: DataFrame, items: Column, keep: list[str], count: int = NUM_HASHES) -> DataFrame:
    """``keep`` and ``signature`` (``array<long>``) of an array of strings, one row per row of ``df``.

    All in column arithmetic: items become rows, the minima of the slots are one aggregate. The items
    of a row lie in one task, so its partial results are whole and few rows are shuffled per record.
    Null items and nulls in the array add nothing; no items at all leave every slot at its maximum.

    An item gives a row for every ``PART_SLOTS`` slots: an aggregate of 128 minima is too long a method
    for the engine's compiler and took several times as long.
    """
    numbered = df.select(*keep, items.alias("_items")).withColumn("_row", F.monotonically_increasing_id())
    coded = numbered.select(*keep, "_row", F.explode_outer("_items").alias("_item")).withColumn("_code", item_code(F.col("_item")))
    # No column is null and a missing item sets all bits, which keeps the expressions short.
    missing = F.when(F.col("_code").isNull(), F.lit(MAX_SLOT)).otherwise(F.lit(0).cast("long"))
    whole = coded.select(*keep, "_row", F.coalesce("_code", F.lit(0).cast("long")).alias("_code"), missing.alias("_missing"))
    family = hash_family(count)
    parts = [family[i : i + PART_SLOTS] for i in range(0, count, PART_SLOTS)]
    dealt = whole.withColumn("_part", F.explode(F.array(*[F.lit(p) for p in range(len(parts))])))

    def own(i: int, which: int) -> Column:
        """Factor or summand of slot ``i`` of the row's part; a shorter last part repeats its last slot."""
        values = [F.lit(part[min(i, len(part) - 1)][which]) for part in parts]
        return reduce(lambda rest, p: F.when(F.col("_part") == p, values[p]).otherwise(rest), range(len(parts) - 1), values[-1])

    with wrapping_integers(df.sparkSession):
        minima = [
            F.min(slot(F.col("_code"), own(i, 0), own(i, 1)).bitwiseOR(F.col("_missing"))).alias(f"_m{i}")
            for i in range(min(count, PART_SLOTS))
        ]
        signed = dealt.groupBy("_row", *keep, "_part").agg(*minima)
    # Minima again, of one row per part: numbers are merged in place, lists would be sorted.
    slots = [F.min(F.when(F.col("_part") == i // PART_SLOTS, F.col(f"_m{i % PART_SLOTS}"))).alias(f"_s{i}") for i in range(count)]
    merged = signed.groupBy("_row", *keep).agg(*slots)
    return merged.select(*keep, F.array(*[f"_s{i}" for i in range(count)]).alias("signature"))


def token_runs(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` neighbouring tokens, joined by a space; fewer tokens are one run."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda acc, x: acc + x) / F.size(a)


def band_keys(signature: Column, bands: int = 16) -> Column:
    rows = NUM_HASHES // bands
    return F.array(*[F.xxhash64(F.lit(i), F.slice(signature, i * rows + 1, rows)) for i in range(bands)])


def verified_links(signatures: DataFrame, id_col: str, threshold: float, bands: int = 16) -> DataFrame:
    """``(a, b)``, ``a > b``: links of records that share a band and whose estimate reaches the threshold.
    They join the same components as all such pairs do.

    Two members of a band are compared unless other links have joined them before: all with its smallest
    id first, in bands larger than a block then with the next ``LEADERS`` ids, what is still apart in
    blocks, every pair. So a band of like records costs one comparison a member, one of unlike records
    all its pairs. Records that share no band are not fetched again.
    """
    ensure_checkpoint_dir(signatures.sparkSession)
    own = signatures.select(F.col(id_col).alias("id"), "signature").filter("id IS NOT NULL AND signature IS NOT NULL")
    keyed = own.select("id", F.explode(band_keys(F.col("signature"), bands)).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = keyed.join(shared, "band").distinct().checkpoint()
    own = own.join(members.select("id").distinct(), "id", "left_semi").checkpoint()
    least = members.groupBy("band").agg(F.min("id").alias("b"))
    links = scored_links(members.withColumnRenamed("id", "a").join(least, "band").filter("a > b"), own, threshold)
    apart = members_apart(members, links)
    sizes = apart.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("band")
    large = apart.join(sizes, "band").checkpoint()
    if not large.isEmpty():
        order = Window.partitionBy("band").orderBy("id")
        leaders = large.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= LEADERS + 1)
        leaders = leaders.select("band", F.col("id").alias("leader"), F.col("root").alias("leader_root"))
        met = large.join(leaders, "band").filter("root <> leader_root")
        met = met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b"))
        links = links.unionByName(scored_links(met, own, threshold))
        apart = members_apart(members, links)
    return links.unionByName(links_in_blocks(apart, own, threshold)).distinct()


def scored_links(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures reach the threshold."""
    left, right = (own.select(F.col("id").alias(x), F.col("signature").alias(f"{x}_signature")) for x in "ab")
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return both.filter(jaccard_estimate(F.col("a_signature"), F.col("b_signature")) >= threshold).select("a", "b").distinct().checkpoint()


def members_apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(band, id, root)`` of the bands whose members the links do not join to one component."""
    roots = connected_components(links).withColumnRenamed("node", "id")
    rooted = members.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    return rooted.join(several, "band").checkpoint()


def links_in_blocks(apart: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Links between members of different roots of all bands of ``apart``; of the links that two
    blocks have, as many as join their components.

    A root with many members in a band has blocks of its own, which are not compared with each
    other; the members of the other roots share blocks.
    """
    sizes = apart.groupBy("band", "root").agg(F.count("*").alias("n")).withColumn("whole", F.col("n") >= BLOCK)
    rest = F.sum(F.when(~F.col("whole"), F.col("n")))
    shared = sizes.groupBy("band").agg(F.ceil(rest / BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"))
    plan = sizes.join(shared, "band").withColumn("blocks", F.when(F.col("whole"), F.ceil(F.col("n") / BLOCK).cast("int")).otherwise(F.col("blocks")))
    number = F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("id")).otherwise(F.col("root"))), F.col("blocks")).cast("int")
    block = F.struct("whole", F.when(F.col("whole"), F.col("root")).otherwise(F.col("low")).alias("root"), number.alias("number"))
    dealt = apart.join(plan, ["band", "root"]).select("band", "id", "root", block.alias("block")).checkpoint()
    blocks = dealt.select("band", "block").distinct()
    both = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band")
    both = both.filter("x < y OR (x = y AND NOT x.whole)").filter("NOT (x.whole AND y.whole AND x.root = y.root)")
    sides = both.select("band", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    full = dealt.join(sides, ["band", "block"]).withColumn("first", F.col("block") == F.col("x")).drop("block").join(own, "id")
    kind = own.schema["id"].dataType
    found = full.groupBy("band", "x", "y").applyInArrow(
        lambda table: block_links(table, threshold), StructType([StructField("a", kind), StructField("b", kind)])
    )
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links that join the components of one block (all rows are ``first``) or of two, by all pairs."""
    first = table["first"].to_numpy()
    order = np.argsort(~first, kind="stable")
    table, n, cut = table.take(pa.array(order)), len(first), int(first.sum())
    slots = table["signature"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    label = table["root"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
    # One byte of each slot tells most pairs apart; equal slots have equal bytes.
    marks = np.ascontiguousarray((slots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).T)
    counts, out = np.uint8 if len(marks) < 256 else np.uint32, []
    for i in range(cut):
        start = i + 1 if cut == n else cut
        rest = start + np.flatnonzero(label[start:] != label[i])
        if not len(rest):
            continue
        others = marks[:, start:] if len(rest) == n - start else marks[:, rest]
        alike = np.add.reduce((others == marks[:, i : i + 1]).view(np.uint8), axis=0, dtype=counts)
        for j in rest[alike / len(marks) >= threshold].tolist():
            if label[j] != label[i] and (slots[i] == slots[j]).sum() / len(marks) >= threshold:
                out.append((i, j))
                label[label == label[j]] = label[i]
    ends = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.table({x: table["id"].take(pa.array(ends[:, k])) for k, x in enumerate("ab")})


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest id of each component, by alternating large-star and
    small-star rounds; each round is checkpointed and the rounds stop when nothing changes."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select("a", "b").checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == state:
            break
        state = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, text_col: str, id_col: str, threshold: float = 0.8, bands: int = 16) -> DataFrame:
    """``(id, cluster, similarity)`` of records in clusters of more than one.

    Records are linked if their signatures share a band and agree in ``threshold`` of their slots
    (see :func:`verified_links`); a cluster is a connected component of links and is named by its
    smallest id. ``similarity`` is the estimate against that record.

    Exact copies are folded into their first record before the bands are compared and are
    handed back at the end with that record's cluster. Signatures are computed where the
    texts lie, so only signatures and ids are ever shuffled.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    hashed = df.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("h"))
    groups = duplicate_groups(hashed, "h", "id").select("h", F.col("keep").alias("first"))
    copies = hashed.join(groups, "h").select("id", "first").filter("id <> first").checkpoint()
    split = df.select(F.col(id_col).alias("id"), T.tokens(F.lower(text_col)).alias("tokens"))
    signed = minhash(split, token_runs(F.col("tokens"), 3), ["id"])
    signatures = signed.join(copies.select("id"), "id", "left_anti").checkpoint()
    components = connected_components(verified_links(signatures, "id", threshold, bands))
    # A first record without near duplicates still heads the cluster of its exact copies.
    heads = copies.select(F.col("first").alias("node")).distinct().join(components, "node", "left_anti")
    rooted = components.unionByName(heads.select("node", F.col("node").alias("root")))
    roots = rooted.select(F.col("root").alias("node")).distinct().join(rooted.select("node"), "node", "left_anti")
    rooted = rooted.unionByName(roots.select("node", F.col("node").alias("root")))
    own = signatures.select(F.col("id").alias("node"), "signature")
    head = signatures.select(F.col("id").alias("root"), F.col("signature").alias("root_signature"))
    scored = rooted.join(own, "node").join(head, "root").select(
        F.col("node").alias("id"), F.col("root").alias("cluster"), jaccard_estimate(F.col("signature"), F.col("root_signature")).alias("similarity")
    )
    exact = copies.join(scored.select(F.col("id").alias("first"), "cluster", "similarity"), "first").select("id", "cluster", "similarity")
    return scored.unionByName(exact)
