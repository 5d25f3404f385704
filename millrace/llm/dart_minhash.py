"""MinHash near-dedup with DartMinHash signatures.

A text is the multiset of its runs of five words; two texts are near copies if their weighted
Jaccard similarity, the sum of smaller counts over the sum of larger counts, is 0.8 or more.

Darts. The region of an element is as high as its count and is cut into cells of height one. Each
cell receives a stream of darts with exponential gaps, drawn from a hash of element and cell, so
equal cells of different texts receive equal darts. A dart falls on a hashed coordinate of the
signature; each coordinate keeps its earliest dart. Darts are thrown only as long as the text
needs to fill all coordinates, so a text of n words costs about n + k log k steps.

Links. Signatures are cut into bands; equal bands make a bucket. A bucket's members are compared
with its hubs only, the members that share most bands with others, never with each other. Pairs
whose signatures come near the threshold are compared exactly by their texts; those that reach it
are links. A second pass tries
sixteen more hubs against members of other components, so small buckets are compared completely and
a large group of copies costs one comparison per member and hub. In buckets that still hold several
components the other members are then compared in blocks, each pair of different components in the
first bucket it shares, so no pair that shares a band is left out. That step grows with the square
of the members of such a bucket; it moves members once per block, not once per partner.

Exact copies are folded before the bands are compared, by a hash of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan as W
from millrace.llm.stage import stored
from millrace.operators.dedup import connected_components


@dataclass(frozen=True)
class Settings:
    """``bands * rows`` coordinates; a pair at the threshold misses all bands with probability
    ``(1 - threshold^rows)^bands``, 3e-6 by default. One hub is tried per bucket in the first pass
    and ``hubs`` more in the second; the rest goes in blocks of about ``block`` members and
    ``block_bytes`` of text."""

    run: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    hubs: int = 16
    block: int = 1024
    block_bytes: int = 1 << 24

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingles(words: W.Words, run: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of all runs of words; a shorter text with words is one run."""
    n = len(words.starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, text = words.hashes(), words.text_of_word()
    counts = words.counts
    per = np.where(counts >= run, counts - run + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per)
    start = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    end = np.minimum(start + run, words.first[owner + 1])
    sums, downs = W.prefix_hash(W.mix(h), W.SEQUENCE_BASES[0])
    return owner, W.mix((sums[end] - sums[start]) * downs[start] + (end - start).astype(np.uint64))


def cells(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, cell)``: an element that occurs c times in a text has the cells 0 to c - 1."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return owner, W.mix(h + W.mix(nth.astype(np.uint64)))


def waits(cell: np.ndarray, nth: int) -> np.ndarray:
    """Exponential gap before the nth dart of each cell."""
    bits = W.mix(cell ^ np.uint64((2 * nth + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def signatures(owner: np.ndarray, cell: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(signature [texts, k], has cells)``: ids of the earliest dart of each coordinate."""
    out = np.zeros((texts, k), dtype=np.uint64)
    sizes = np.bincount(owner, minlength=texts)
    todo = sizes > 0
    horizon = k * (np.log(k) + 2.0) / np.maximum(sizes, 1)
    while todo.any():
        mine = todo[owner]
        who, what = owner[mine], cell[mine]
        time = np.zeros(len(what))
        found, nth = [], 0
        while len(what):
            time = time + waits(what, nth)
            on = time < horizon[who]
            who, what, time = who[on], what[on], time[on]
            dart = W.mix(what ^ np.uint64((2 * nth + 2) * 0xD1342543DE82EF95 % 2**64))
            found.append((who * k + (dart % np.uint64(k)).astype(np.int64), time, dart))
            nth += 1
        place, time, dart = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(-time, kind="stable")
        filled = np.zeros((texts, k), dtype=bool)
        filled.reshape(-1)[place] = True
        flat = out.reshape(-1)
        flat[place[order]] = dart[order]  # the earliest dart is written last
        todo &= ~filled.all(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return out, sizes > 0


#: Bytes and texts that are signed at once: a text throws about a thousand darts, however short it is.
SIGNED_BYTES, SIGNED_TEXTS = 1 << 18, 256
SIGNED = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def signed(text: Column, settings: Settings) -> Column:
    """``bands``, the band hashes, and ``sketch``, one byte a coordinate; both empty for null texts
    and texts without words."""

    @F.arrow_udf(SIGNED)
    def keys(column: pa.Array) -> pa.Array:
        lengths, values, sketches = [], [], []
        for _, data, bounds in W.slices(column, SIGNED_BYTES, SIGNED_TEXTS):
            texts = len(bounds) - 1
            owner, cell = cells(*shingles(W.find_words(data, bounds), settings.run))
            signature, some = signatures(owner, cell, texts, settings.coordinates)
            grouped = signature.reshape(texts, settings.bands, settings.rows)
            key = np.broadcast_to(W.mix(np.arange(1, settings.bands + 1, dtype=np.uint64)), (texts, settings.bands)).copy()
            for r in range(settings.rows):
                key = W.mix(key * np.uint64(0xAF251AF3B0F025B5) + grouped[:, :, r])
            lengths.append(np.where(some, settings.bands, 0))
            values.append(key[some].reshape(-1))
            low = (signature >> np.uint64(56)).astype(np.uint8)
            sketches += [low[i].tobytes() if some[i] else b"" for i in range(texts)]
        size = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        flat = np.concatenate(values) if values else np.empty(0, np.uint64)
        bands = pa.ListArray.from_arrays(pa.array(offsets), W.as_long(flat))
        return pa.StructArray.from_arrays([bands, pa.array(sketches, pa.binary())], names=SIGNED.names)

    return keys.asNondeterministic()(text)


def similarity(a: Column, b: Column, run: int) -> Column:
    """Exact weighted Jaccard similarity of the word runs of two texts."""

    @F.arrow_udf(T.DoubleType())
    def compared(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.empty(len(left))
        for i in range(len(left)):
            bags = []
            for side in (left, right):
                data, bounds = W.text_buffers(side.slice(i, 1))
                own = data[bounds[0] : bounds[1]]
                bags.append(cells(*shingles(W.find_words(own, np.array([0, len(own)])), run))[1])
            # Cells are distinct within a text, so cells in common are smaller counts.
            both = len(np.intersect1d(*bags, assume_unique=True))
            total = len(bags[0]) + len(bags[1]) - both
            out[i] = both / total if total else 0.0
        return pa.array(out)

    return compared.asNondeterministic()(a, b)


def least_agreement(settings: Settings) -> float:
    """Coordinates that pairs at the threshold share, less four standard deviations."""
    t, k = settings.threshold, settings.coordinates
    return k * (t - 4 * (t * (1 - t) / k) ** 0.5)


def promising(pairs: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose sketches agree in ``least_agreement`` coordinates or more, so that few texts
    are fetched for pairs that are far from the threshold."""
    k, least = settings.coordinates, least_agreement(settings)

    @F.arrow_udf(T.BooleanType())
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (W.text_buffers(side) for side in (left, right))
        rows = [x[o[0] : o[-1]].reshape(-1, k) for x, o in (a, b)]
        return pa.array((rows[0] == rows[1]).sum(axis=1) >= least)

    sides = [sketches.select(F.col("node").alias(n), F.col("sketch").alias(f"{n}_sketch")) for n in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.filter(near.asNondeterministic()(F.col("a_sketch"), F.col("b_sketch"))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", similarity(F.col("a_text"), F.col("b_text"), settings.run).alias("s"))
    return scored.filter(F.col("s") >= settings.threshold).select("a", "b")


def labelled(df: DataFrame, components: DataFrame | None, node: str, out: str) -> DataFrame:
    """``df`` with the component of ``node``; a node without links is its own."""
    if components is None:
        return df.withColumn(out, F.col(node))
    roots = components.select(F.col("node").alias(node), F.col("root").alias(f"{out}_root"))
    return df.join(roots, node, "left").withColumn(out, F.coalesce(f"{out}_root", node)).drop(f"{out}_root")


def link_components(nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame | None:
    """``(node, root)`` of all nodes with links, None if there are none. ``nodes`` has ``node``,
    ``bands`` and ``sketch``; ``texts`` has ``node`` and ``text``, a node in as many rows as it has copies."""
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(members.join(sizes, "band"), "buckets")
    degrees = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    members = stored(members.select("band", "node").join(degrees, "node"), "members")
    own = stored(texts.join(degrees.select("node"), "node", "left_semi").dropDuplicates(["node"]), "candidate-texts")
    sketches = stored(nodes.select("node", "sketch").join(degrees.select("node"), "node"), "sketches")
    order = Window.partitionBy("band").orderBy(F.desc("degree"), "hub")
    components = None
    for tried, upto in ((0, 1), (1, 1 + settings.hubs)):
        rooted = labelled(members, components, "node", "root")
        ranked = rooted.select("band", "degree", F.col("node").alias("hub"), F.col("root").alias("hub_root")).withColumn("place", F.row_number().over(order))
        hubs = ranked.filter(F.col("place") <= upto).filter(F.col("place") > tried).select("band", "hub", "hub_root")
        pairs = rooted.select("band", "node", "root").join(hubs, "band").filter("root <> hub_root")
        # Either member may be the hub of the other in another bucket.
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        found = stored(verified(promising(pairs, sketches, settings), own, settings), "links")
        if not found.isEmpty():
            components = merged(components, found)
    rooted = labelled(members, components, "node", "root")
    ranked = rooted.select("band", "degree", F.col("node").alias("hub")).withColumn("place", F.row_number().over(order))
    hubs = ranked.filter(F.col("place") <= 1 + settings.hubs).select("band", F.col("hub").alias("node"))
    found = stored(links_in_blocks(rooted.join(hubs, ["band", "node"], "left_anti"), nodes, own, settings), "links-in-blocks")
    return components if found.isEmpty() else merged(components, found)


LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def links_in_blocks(rooted: DataFrame, nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links ``(a, b)`` between members of different roots of all buckets of ``rooted`` (``band``,
    ``node``, ``root``); of the links of two blocks as many as join their components."""
    members = rooted.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    several = F.ceil(F.greatest(F.count("*") / settings.block, F.sum("bytes") / settings.block_bytes)).cast("int")
    blocks = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), several.alias("blocks")).filter("low <> high")
    dealt = members.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root")
    full = dealt.join(nodes.select("node", "bands", "sketch"), "node").join(texts.select("node", "text"), "node")

    def compared(table: pa.Table) -> pa.Table:
        pairs = block_links(table, settings)
        return pa.table({n: pa.array([p[i] for p in pairs], pa.binary()) for i, n in enumerate(LINKS.names)})

    found = full.groupBy("band", "x", "y").applyInArrow(compared, LINKS)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_links(table: pa.Table, settings: Settings) -> list[tuple[bytes, bytes]]:
    """Links that join the components of one block (``x`` = ``y``) or of two, by all pairs."""
    node, k, least = table["node"].to_pylist(), settings.coordinates, least_agreement(settings)
    n = len(node)
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, k)
    bands = np.array(table["bands"].to_pylist(), dtype=np.int64).reshape(n, settings.bands)
    here = bands == table["band"][0].as_py()
    place, own = here.argmax(axis=1), np.array(table["own"].to_pylist())
    single = table["x"][0] == table["y"][0]
    label = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)[1]
    bags: list[np.ndarray | None] = [None] * n

    def bag(i: int) -> np.ndarray:
        if bags[i] is None:
            data, bounds = W.text_buffers(table["text"].slice(i, 1).combine_chunks())
            text = data[bounds[0] : bounds[1]]
            bags[i] = np.sort(cells(*shingles(W.find_words(text, np.array([0, len(text)])), settings.run))[1])
        return bags[i]

    out = []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not single:
            rest = rest[own[rest] != own[i]]
        rest = rest[(sketch[rest] == sketch[i]).sum(axis=1) >= least]
        # A pair that shares an earlier band is compared there.
        rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == place[i]]
        for j in rest.tolist():
            if label[j] == label[i]:
                continue
            small, large = sorted((bag(i), bag(j)), key=len)
            if len(small) < settings.threshold * len(large):
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if both / (len(small) + len(large) - both) >= settings.threshold:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return out


def merged(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; only the roots that the links join are searched again. Roots
    are in the second column only."""
    if components is None:
        return stored(connected_components(links), "components")
    ends = labelled(labelled(links, components, "a", "a_root"), components, "b", "b_root")
    ends = ends.filter("a_root <> b_root").select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
    joined = stored(connected_components(ends), "joined-roots")
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = components.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return stored(old.unionByName(joined), "components")


def with_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``id_col``, ``node`` (hash of the text), ``class_id`` (smallest id of the class),
    ``class_size`` (its rows) and ``class_node`` (the text that carries the smallest id), one row
    per row of ``df``.

    Null texts and texts without words are classes of their own with a null ``class_node``. Equal
    texts share a class whatever their ids; a class whose ids are all null has a null id. Long
    texts are compared whole; an empty table gives an empty one.
    """
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    slim = slim.withColumn("node", F.unhex(F.md5("text")))
    worded = slim.select("id", "node", signed(F.col("text"), settings).alias("signed")).filter(F.size("signed.bands") > 0)
    nodes = worded.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("signed").alias("signed"))
    nodes = stored(nodes.select("node", "id", "copies", "signed.*"), "signatures")
    components = link_components(nodes, slim.select("node", "text"), settings)
    roots = labelled(nodes.select("node", "id", "copies"), components, "node", "root")
    # Null ids come last.
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("least")
    classes = roots.groupBy("root").agg(least, F.sum("copies").alias("class_size"))
    classes = roots.select("node", "root").join(classes, "root")
    classes = stored(classes.select("node", F.col("least.id").alias("class_id"), "class_size", F.col("least.node").alias("class_node")), "classes")
    out = slim.select("id", "node").join(classes, "node", "left")
    alone = F.col("class_size").isNull()
    return out.select(
        F.col("id").alias(id_col), "node", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), "class_node",
    )


def one_per_class(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row of every class, that with the smallest id; all columns of ``df``. Rows without
    words stay. Of rows that are equal in id and text one stays."""
    free = "_near"
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    node, other, own_id, copies = (f"{free}{x}" for x in ("node", "other", "id", "copies"))
    text, row_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    classes = with_classes(df, text_col, id_col, settings)
    first = (F.col("node") == F.col("class_node")) & row_id.eqNullSafe(F.col("class_id"))
    keep = classes.filter(first).groupBy(F.col("node").alias(other), row_id.alias(own_id)).agg(F.count("*").alias(copies))
    keyed = df.withColumn(node, F.when(text.rlike("[^ \\t-\\r]"), F.unhex(F.md5(text))))
    kept = keyed.join(keep, (F.col(node) == F.col(other)) & row_id.eqNullSafe(F.col(own_id)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    single = kept.filter(F.col(copies) == 1).select(*columns)
    # Rows repeated in id and text are few; only they are compared with each other.
    several = kept.filter(F.col(copies) > 1).dropDuplicates([node]).select(*columns)
    return single.unionByName(several).unionByName(keyed.filter(F.col(node).isNull()).select(*columns))
