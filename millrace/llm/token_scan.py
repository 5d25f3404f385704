"""Token counts by separator scan.

A flat token file is a sequence of fixed-width token ids with an end-of-document id after each
document and no index. It is cut into blocks by position; a task reads its blocks by range and
finds the separators of a block with one vectorised comparison. A document may span blocks, so
block summaries (tokens, separators, place of the last separator) are stitched by a prefix scan:
the carry of a block is the place of the last separator and the number of separators before it.

Files written here have a side table with the id of each document by file and number, made in the same
pass; it holds no places. Counts are joined to it by file and number, so they carry document ids and
do not depend on how the files are called.

The scan has two levels. Spans of ``fan`` blocks are scanned first, then their totals; a file that
holds a third of all tokens is still as many spans as it needs, and no task sees more than ``fan``
blocks or a file's spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.stage import folder, stored

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- Fixed values: the split pattern of the public byte-level vocabulary and its free id.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256

BLOCKS = "path string, block long, n_tokens long, ends array<int>"


@dataclass(frozen=True)
class Layout:
    """Width and byte order of a token, the id that ends a document, tokens read at a time."""

    dtype: str = "<u2"
    end: int = END_OF_DOCUMENT
    block_tokens: int = 1 << 21
    fan: int = 1024

    @property
    def width(self) -> int:
        return np.dtype(self.dtype).itemsize


def token_bytes(text: Column, vocabulary_path: str = VOCABULARY_PATH, layout: Layout = Layout()) -> Column:
    """The tokens of a text as the bytes of a flat file, without the end-of-document id; empty for
    null and empty texts. Strings that look like special tokens are plain text."""
    with open(vocabulary_path, "rb") as f:  # below a megabyte; sent with the function
        vocabulary = f.read()

    @F.arrow_udf(T.BinaryType())
    def encoded(column: pa.Array) -> pa.Array:
        encode = encoder(vocabulary)
        return pa.array([np.array(encode(t.as_py() or ""), dtype=layout.dtype).tobytes() for t in column], pa.binary())

    return encoded(text)


_ENCODERS: dict[bytes, object] = {}


def encoder(vocabulary: bytes):
    """The encoder of a vocabulary file, made once per worker."""
    if vocabulary not in _ENCODERS:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary].encode_ordinary


def write_token_files(df: DataFrame, tokens: Column, path: str, layout: Layout = Layout()) -> None:
    """One flat token file per partition. The text writer copies the bytes of a value as they are
    and the end-of-document id is its line separator."""
    end = np.array([layout.end], dtype=layout.dtype).tobytes().decode("latin-1")
    flat = df.select(tokens.cast("string").alias("value"))
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


def write_identified_files(df: DataFrame, id_col: str, text_col: str, path: str, vocabulary_path: str = VOCABULARY_PATH, layout: Layout = Layout()) -> DataFrame:
    """One flat token file per partition below ``path``, and the stored side table ``name, doc,
    doc_id``: which document is the nth of which file. A task that is run again writes another file;
    only files that the side table names count."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    end = np.array([layout.end], dtype=layout.dtype).tobytes()
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("doc", T.LongType()), T.StructField("doc_id", df.schema[id_col].dataType)])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, name, done, out = encoder(vocabulary), f"{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            if out is None:
                system, inner = fs.FileSystem.from_uri(path)
                system.create_dir(inner, recursive=True)
                out = system.open_output_stream(f"{inner}/{name}")
            for text in batch["text"]:
                out.write(np.array(encode(text.as_py() or ""), dtype=layout.dtype).tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(done, done + n)), batch["doc_id"]], names=schema.names)
            done += n
        if out is not None:
            out.close()

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(written, schema), "token-ids")


def file_name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_blocks(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """``(path, block, size)``: the blocks of all files below a path, from their listed sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    per = layout.block_tokens * layout.width
    last = F.floor((F.col("length") - 1) / per)
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return blocks.withColumn("size", F.least(F.lit(per), F.col("length") - F.col("block") * per))


def scan_blocks(layout: Layout):
    """Arrow function: reads blocks by range and finds their separators."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: tuple[str, object] | None = None
        for batch in batches:
            for path, block, size in zip(*(batch[c].to_pylist() for c in ("path", "block", "size"))):
                if opened is None or opened[0] != path:
                    system, inner = fs.FileSystem.from_uri(path)
                    opened = (path, system.open_input_file(inner))
                raw = opened[1].read_at(size, block * layout.block_tokens * layout.width)
                if len(raw) % layout.width:
                    raise ValueError(f"{path} does not hold whole tokens")
                tokens = np.frombuffer(raw, dtype=layout.dtype)
                ends = np.flatnonzero(tokens == layout.end).astype(np.int32)
                columns = [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "n_tokens", "ends"])

    return scanned


def carries(blocks: DataFrame, layout: Layout) -> DataFrame:
    """Blocks with ``start`` (first token not yet in a document) and ``first`` (documents ended
    before the block), by a prefix scan over spans of blocks and then over the spans of a file."""
    place = F.col("block") * layout.block_tokens
    summed = blocks.select(
        "path", "block", F.floor(F.col("block") / layout.fan).alias("span"), F.size("ends").cast("long").alias("n"),
        F.when(F.size("ends") > 0, place + F.element_at("ends", -1)).alias("last"),
    )
    inside = Window.partitionBy("path", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = summed.select("path", "block", "span", F.max("last").over(inside).alias("last"), F.sum("n").over(inside).alias("n"))
    spans = summed.groupBy("path", "span").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    before = Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("path", "span", F.max("last").over(before).alias("span_last"), F.sum("n").over(before).alias("span_n"))
    both = local.join(spans, ["path", "span"])
    last = F.greatest("last", "span_last")
    count = F.coalesce("n", F.lit(0)) + F.coalesce("span_n", F.lit(0))
    return both.select("path", "block", F.coalesce(last + 1, F.lit(0)).alias("start"), count.alias("first"))


def document_tokens(spark: SparkSession, path: str, layout: Layout = Layout(), names: DataFrame | None = None) -> DataFrame:
    """``path``, ``doc`` (from 0 within the file), ``start``, ``n_tokens`` and ``ended`` of every
    document in the token files below ``path``.

    Adjacent separators hold an empty document. Tokens after the last separator of a file are a
    last document that has not ``ended``; nothing is added if a file ends with a separator. Empty
    files give no rows; a file that does not hold whole tokens is an error. Files are read in any
    store that pyarrow opens by address. With ``names`` (``name``) only the files so called are read.
    """
    listed = file_blocks(spark, path, layout)
    if names is not None:
        listed = listed.join(names.select("name").distinct(), file_name() == F.col("name"), "left_semi")
    tasks = spark.sparkContext.defaultParallelism
    # Neighbouring blocks of a file go to one task, which keeps the file open.
    dealt = listed.repartitionByRange(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block").sortWithinPartitions("path", "block")
    blocks = stored(dealt.mapInArrow(scan_blocks(layout), BLOCKS), "blocks")
    joined = blocks.filter(F.size("ends") > 0).join(carries(blocks, layout), ["path", "block"])
    place = F.col("block") * layout.block_tokens
    # The place before the first token of each document, next to the place of its separator.
    ends = F.transform("ends", lambda x: place + x)
    before = F.concat(F.array(F.col("start") - 1), F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    pairs = joined.select("path", "first", F.posexplode(F.arrays_zip(before.alias("before"), ends.alias("end"))).alias("nth", "d"))
    closed = pairs.select(
        "path", (F.col("first") + F.col("nth")).alias("doc"), (F.col("d.before") + 1).alias("start"),
        (F.col("d.end") - F.col("d.before") - 1).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    sizes = blocks.groupBy("path").agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.size("ends")).alias("doc"),
        F.max(F.when(F.size("ends") > 0, place + F.element_at("ends", -1) + 1)).alias("last"),
    )
    start = F.coalesce("last", F.lit(0))
    tails = sizes.filter(F.col("tokens") > start).select(
        "path", F.col("doc").cast("long").alias("doc"), start.cast("long").alias("start"), (F.col("tokens") - start).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return closed.unionByName(tails)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY_PATH, layout: Layout = Layout()) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ended`` of every row of ``df``: writes the texts as flat token
    files to the shared folder, scans these and joins the ids back by file and number.

    Null and empty texts are documents of no tokens. Ids may be null or repeat; every row is counted.
    An empty table gives an empty result; other columns are not read."""
    path = folder(df.sparkSession, "tokens")
    names = write_identified_files(df, id_col, text_col, path, vocabulary_path, layout)
    if names.isEmpty():
        return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    found = document_tokens(df.sparkSession, path, layout, names).select(file_name().alias("name"), "doc", "n_tokens", "ended")
    return names.join(found, ["name", "doc"], "left").select("doc_id", "n_tokens", "ended")
