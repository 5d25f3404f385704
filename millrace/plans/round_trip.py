"""Writers and readers together: whole tables are written below the shared checkpoint
folder, read back and compared with the tables themselves."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.standardize import standardize
from millrace.plans.mapping import BAD_RECORD, CHOICES, chat_mapping
from millrace.session import ensure_checkpoint_dir, plan_bytes, read_table
from millrace.sources import sinks as K
from millrace.sources.listing import list_files, verify_output
from millrace.sources.scan import read_delimited, read_json, read_staged, scan

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def scratch(spark) -> str:
    """A new folder every executor reaches."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"


def records(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _digest(df):
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", "source")


_TABLE = "SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents"


def _json(spark, sf_dir):
    path = scratch(spark)
    K.write_records(records(spark, sf_dir), path, ".jsonl.gz")
    return _digest(scan(spark, path, "*.json.gz"))


def _parquet(spark, sf_dir):
    """The format is found from the files."""
    path = scratch(spark)
    K.write_records(records(spark, sf_dir), path, ".parquet")
    return _digest(scan(spark, path))


def _delimited(separator, glob, encoding="UTF-8"):
    def run(spark, sf_dir):
        path = scratch(spark)
        docs = records(spark, sf_dir)
        if encoding != "UTF-8":
            docs = docs.withColumn("text", F.regexp_replace("text", r"[^\x00-\xFF]", "?"))
        writer = docs.write.option("header", "true").option("sep", separator).option("extension", glob[2:]).option("encoding", encoding)
        writer.option("quoteAll", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
            "ignoreTrailingWhiteSpace", "false"
        ).csv(path)
        return _digest(scan(spark, path, glob))

    return run


_register("s03_k04_json_lines", _json, _TABLE)
_register("s02_k04_parquet_detected", _parquet, _TABLE)
_register("s04_csv", _delimited(",", "*.csv"), _TABLE)
_register("s04_tsv", _delimited("\t", "*.tsv"), _TABLE)
_register(
    "s04_latin1", _delimited(",", "*.csv", "ISO-8859-1"),
    "SELECT doc_id, md5(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')) AS text_md5, lang, source FROM documents",
)


def _with_outcome(good, bad):
    return good.withColumn("outcome", F.lit("good")).unionByName(bad.select(F.col("value").alias("outcome")), allowMissingColumns=True)


def _json_field(name):
    """``"name":value`` as JSON text."""
    whole = F.to_json(F.struct(name), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


# Stored bytes of the documents in one of the large files written here.
FILE_BYTES = 16 * 1024 * 1024


def _in_pieces(df, file_bytes):
    """``of``, four sets of documents, and ``piece``, the file of its set; a large table has more files, so
    that no task writes a quarter of it. Also the number of pieces of a set."""
    pieces = max(1, math.ceil(plan_bytes(df) / (4 * file_bytes)))
    return df.withColumns({"of": F.col("doc_id") % 4, "piece": F.pmod(F.xxhash64("doc_id"), F.lit(pieces))}), pieces


def _one_large_array(spark, sf_dir, file_bytes=FILE_BYTES):
    """Arrays laid out over many lines; a bare number is the last item of the first one of each set."""
    path = scratch(spark)
    docs, pieces = _in_pieces(records(spark, sf_dir), file_bytes)
    item = F.concat(F.lit("{\n  "), F.concat_ws(",\n  ", *[_json_field(c) for c in ("doc_id", "text", "lang", "source")]), F.lit("\n},"))
    parts = docs.select("of", "piece").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy("piece")))
    lines = docs.select("of", "piece", F.lit(1).alias("place"), "doc_id", item.alias("value"))
    for place, text in ((0, F.lit("[")), (2, F.when(F.col("nth") == 1, "7\n]").otherwise("]"))):
        lines = lines.unionByName(parts.select("of", "piece", F.lit(place).alias("place"), F.lit(0).cast("long").alias("doc_id"), text.alias("value")))
    lines.repartition(4 * pieces, "of", "piece").sortWithinPartitions("of", "piece", "place", "doc_id").select("value").write.text(path)
    good, bad = read_json(spark, path, "*.txt")
    return _with_outcome(_digest(good), bad)


_register(
    "s03_one_large_array", _one_large_array,
    "SELECT doc_id, md5(text) AS text_md5, lang, source, 'good' AS outcome FROM documents UNION ALL "
    "SELECT NULL, NULL, NULL, NULL, '7' FROM (SELECT DISTINCT doc_id % 4 FROM documents)",
)


def _quoted_breaks(spark, sf_dir, file_bytes=FILE_BYTES):
    """Quoted fields with line breaks, quotes and separators; rows that lack fields are handed out."""
    path = scratch(spark)
    docs, pieces = _in_pieces(records(spark, sf_dir), file_bytes)
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('\nlast "" line, end"'))
    row = F.concat_ws(",", F.col("doc_id").cast("string"), quoted, "lang", "source")
    value = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("short,"), F.col("doc_id").cast("string"))).otherwise(row)
    rows = docs.select("of", "piece", F.lit(1).alias("place"), value.alias("value"))
    headers = rows.select("of", "piece").distinct().select("of", "piece", F.lit(0).alias("place"), F.lit("doc_id,text,lang,source").alias("value"))
    whole = rows.unionByName(headers).repartition(4 * pieces, "of", "piece").sortWithinPartitions("of", "piece", "place")
    whole.select("of", "piece", "value").write.partitionBy("of", "piece").text(path)
    good, bad = read_delimited(spark, path, "*.txt")
    return _with_outcome(_digest(good), bad)


_register(
    "s04_quoted_breaks", _quoted_breaks,
    "SELECT doc_id, md5(text || chr(10) || 'last \" line, end') AS text_md5, lang, source, 'good' AS outcome FROM documents WHERE doc_id % 7 <> 0 UNION ALL "
    "SELECT NULL, NULL, NULL, NULL, 'short,' || doc_id FROM documents WHERE doc_id % 7 = 0",
)


def _bad_lines(spark, sf_dir):
    """Lines cut off in the middle are quarantined, the rest is read."""
    path = scratch(spark)
    docs = records(spark, sf_dir).select("doc_id", "lang", "source")
    line = F.to_json(F.struct("doc_id", "lang", "source"))
    docs.select(F.when(F.col("doc_id") % 6 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    good, bad = read_json(spark, path, "*.txt")
    kept = good.select("doc_id", "source", F.lit("good").alias("outcome"))
    return kept.unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("bad").alias("outcome")))


_register(
    "s03_bad_lines", _bad_lines,
    "SELECT CASE WHEN doc_id % 6 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 6 <> 0 THEN source END AS source, "
    "CASE WHEN doc_id % 6 = 0 THEN 'bad' ELSE 'good' END AS outcome FROM documents",
)


def _mixed_shapes(spark, sf_dir):
    """Lines beside arrays laid out over several lines, each of which holds a bare number too."""
    path = scratch(spark)
    docs = records(spark, sf_dir).select("doc_id", "source")
    line = F.to_json(F.struct("doc_id", "source"))
    docs.filter("doc_id % 3 <> 1").select(line.alias("value")).write.text(f"{path}/lines")
    laid_out = F.concat(F.lit("[\n"), F.array_join(F.collect_list(line), ",\n"), F.lit(",\n7\n]")).alias("value")
    docs.filter("doc_id % 3 = 1").groupBy("source").agg(laid_out).write.partitionBy("source").text(f"{path}/arrays")
    good, bad = read_json(spark, path, "*.txt")
    kept = good.select("doc_id", "source", F.lit("good").alias("outcome"))
    return kept.unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.col("value").alias("outcome")))


_register(
    "s03_mixed_shapes", _mixed_shapes,
    "SELECT doc_id, source, 'good' AS outcome FROM documents UNION ALL "
    "SELECT NULL, NULL, '7' FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 1)",
)


def _mixed_formats(spark, sf_dir):
    """One folder with JSON Lines, Parquet and delimited files, read without a pattern."""
    path = scratch(spark)
    docs = records(spark, sf_dir).select("doc_id", "source", "lang")
    docs.filter("doc_id % 3 = 0").write.json(f"{path}/a")
    docs.filter("doc_id % 3 = 1").write.parquet(f"{path}/b")
    docs.filter("doc_id % 3 = 2").withColumn("doc_id", F.col("doc_id").cast("string")).write.option("header", "true").csv(f"{path}/c")
    return scan(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang")


_register("s02_mixed_formats", _mixed_formats, "SELECT doc_id, source, lang FROM documents")


def _processed(spark, sf_dir):
    """The processed layer written by language; what its files hold and how many languages they cover."""
    path = scratch(spark)
    docs = records(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/raw/set/"), "source", F.lit("/f.jsonl")))
    standard = standardize(docs, ["en", "fr"], "set", "/data/raw/set", F.col("path"), F.col("lang"), exclude=("path", "lang"))
    K.write_processed(standard.drop("_full_text", "path", "lang"), path, "dist")
    back = scan(spark, path, "*.json.gz")
    return back.groupBy("_lang", "_dataset_name", "_dataset_path", "_subpath", "_filename").agg(F.count("*").alias("records"))


_register(
    "k01_write_processed", _processed,
    "SELECT CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS _lang, 'processed__set' AS _dataset_name, '/data/processed/set' AS _dataset_path, "
    "'dist' AS _subpath, 'f_processed' AS _filename, count(*) AS records FROM documents GROUP BY 1",
)


def _verified(spark, sf_dir):
    """Languages that have files with bytes after a write."""
    path = scratch(spark)
    docs = records(spark, sf_dir).withColumn("lang_folder", F.col("lang"))
    K.write_records(docs, path, ".parquet", ["lang_folder"])
    files = list_files(spark, path, "*.parquet")
    out = verify_output(files, F.regexp_extract("path", "lang_folder=([^/]+)/", 1))
    return out.select("lang", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


_register(
    "k08_written_files", _verified,
    "SELECT DISTINCT lang, true AS has_files, true AS has_bytes FROM documents UNION ALL SELECT NULL, true, true",
)


def _query_result(spark, sf_dir):
    """A saved query result: every record once, its chunk name well formed."""
    path = scratch(spark)
    picked = records(spark, sf_dir).filter("lang <> 'de'")
    chunks = K.write_query_result(picked, path, chunk=256 * 1024)
    back = scan(spark, path, "*.json.gz")
    number = F.regexp_extract("_filename", r"^query_results_(\d{5})\.jsonl\.gz$", 1).cast("int")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), number.between(1, chunks).alias("named"))


_register("k06_query_result", _query_result, "SELECT doc_id, md5(text) AS text_md5, true AS named FROM documents WHERE lang <> 'de'")


def _sampled(spark, sf_dir):
    path = scratch(spark)
    K.materialize_sample(records(spark, sf_dir), path, "doc_id", 0.25, 5)
    return _digest(scan(spark, path, "*.parquet"))


_register(
    "k07_r03_sampled_copy", _sampled,
    _TABLE + " WHERE ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|5'), 1, 8))::BIGINT < 0.25 * 4294967296",
)


def _staged(spark, sf_dir):
    """All configurations of one split of a staged hub dataset, one per source."""
    root = scratch(spark)
    docs = records(spark, sf_dir).withColumns({"config": F.col("source"), "split": F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")})
    K.write_records(docs, f"{root}/org/set", ".jsonl.gz", ["config", "split"])
    back = read_staged(spark, root, "org/set", "split=train", "*.json.gz", distribution_key="lang")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "_dataset_name", F.col("_distribution").alias("distribution"))


_register(
    "s08_staged_hub_dataset", _staged,
    "SELECT doc_id, 'org/set/' || source AS _dataset_name, lang AS distribution FROM documents WHERE doc_id % 4 <> 0",
)


def _mapped_job(spark, sf_dir):
    """A mapping job written once, good rows and quarantine side by side."""
    source, mapping = chat_mapping(spark, sf_dir)
    path = scratch(spark)
    K.write_with_quarantine(mapping.apply(source, ["doc_id"]).select("doc_id", "template", "errors"), path)
    back = scan(spark, path, "*.json.gz")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "template", (F.size("errors") > 0).alias("quarantined"))


_register(
    "m19_write_with_quarantine", _mapped_job,
    f"SELECT doc_id, 'simple_chat' AS template, {BAD_RECORD} AS quarantined FROM (SELECT *, {CHOICES} AS ch FROM documents)",
)


def _mapped_layer(spark, sf_dir):
    """The mapped layer written by folder and read back."""
    docs = records(spark, sf_dir).selectExpr(
        "doc_id", "'set_' || source AS _dataset_name", "'/data/mapped/set' AS _dataset_path", "lang || '/part/' || source AS _subpath",
        "'f.jsonl.gz' AS _filename", "lang AS _lang", "sha2(text, 256) AS _id_hash",
    )
    path = scratch(spark)
    K.write_mapped(docs, path, ".parquet")
    return scan(spark, path, "*.parquet").select("doc_id", "_dataset_name", "_subpath", "_filename", "_lang")


_register(
    "k02_write_mapped", _mapped_layer,
    "SELECT doc_id, 'mapped__set_' || source AS _dataset_name, 'part/' || source AS _subpath, 'f_mapped' AS _filename, lang AS _lang FROM documents",
)
