"""Scans, listings and layer columns over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import constants as C
from millrace.operators import standardize as S
from millrace.plans.sql_text import quote
from millrace.session import read_table
from millrace.sources import listing as L
from millrace.sources import sinks as K
from millrace.sources.scan import sample_records, scan, window_of_rows
from millrace.sources.webpages import html_to_markdown, markdown_pages

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _parquet(spark, sf_dir):
    """The parquet scan by folder and pattern."""
    return scan(spark, sf_dir, "documents.parquet").select("doc_id", "lang", "source", "n_chars")


_register("s01_scan_by_pattern", _parquet, "SELECT doc_id, lang, source, n_chars FROM documents")
_register(
    "s05_parquet_scan", lambda s, d: scan(s, d, "labels.parquet"), "SELECT doc_id, quality, toxic FROM labels",
)
_register(
    "s09_skip_limit",
    lambda s, d: window_of_rows(read_table(s, d, "events").select("event_id", "event_type"), ["event_id"], 250, 400),
    "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 400 OFFSET 250",
)
_register(
    "s13_sample_records",
    lambda s, d: sample_records(read_table(s, d, "pages"), 50, ["page_id"]).select("page_id", "url", F.length("html").alias("chars")),
    "SELECT page_id, url, length(html) AS chars FROM pages ORDER BY page_id LIMIT 50",
)


def _pages(spark, sf_dir):
    """Pages as Markdown with their language and identity."""
    pages = markdown_pages(read_table(spark, sf_dir, "pages"), ["en", "fr", "de", "es"])
    return pages.select("page_id", "_lang", F.length("text").alias("chars"), S.id_hash(F.col("text")).alias("_id_hash"))


_register("s07_pages_markdown", _pages)


def _page_titles(spark, sf_dir):
    """How often scripts and styles survive the conversion: never."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", html_to_markdown("html").alias("text"))
    return pages.select("page_id", F.contains("text", F.lit("track(0)")).alias("has_script"), F.contains("text", F.lit("margin:0")).alias("has_style"))


_register(
    "s07_hidden_parts", _page_titles, "SELECT page_id, false AS has_script, false AS has_style FROM pages",
)

_PATH = (
    "'/lake/raw/set' || CAST(l_suppkey AS STRING) || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '/train' WHEN 3 THEN '/.cache/x' "
    "WHEN 4 THEN '/Logs' WHEN 5 THEN '/_tmp' ELSE '/en/part' || CAST(l_linenumber AS STRING) END || '/' || "
    "CASE l_partkey % 6 WHEN 0 THEN 'f.' || CAST(l_orderkey AS STRING) || '.JSONL.gz' WHEN 1 THEN 'a.parquet' WHEN 2 THEN 'README' "
    "WHEN 3 THEN 'x.tar.zst' WHEN 4 THEN 'b.lock' ELSE 'c.v2.txt' END"
)
ROOT = "/lake/raw"


def files(spark, sf_dir):
    """A listing with one file per line item."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(f"{_PATH} AS path", "l_orderkey + 1 AS length", "l_suppkey")


_FILES = f"files AS (SELECT {_PATH} AS path, l_orderkey + 1 AS length, l_suppkey FROM lineitem)"
_EXT = (
    "CASE WHEN path LIKE '%.JSONL.gz' THEN '.jsonl.gz' WHEN path LIKE '%.tar.zst' THEN '.tar.zst' WHEN path LIKE '%.parquet' THEN '.parquet' "
    "WHEN path LIKE '%.lock' THEN '.lock' WHEN path LIKE '%.txt' THEN '.txt' ELSE '' END"
)
_register(
    "s11_leaf_partitions", lambda s, d: L.leaf_partitions(files(s, d), ROOT),
    f"WITH {_FILES} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files WHERE NOT regexp_matches(regexp_replace(path, '/[^/]*$', ''), '(?i)\\.cache|logs|__pycache__')",
)
_register(
    "s12_minimal_globs", lambda s, d: L.minimal_globs(files(s, d), ROOT),
    f"WITH {_FILES} SELECT DISTINCT regexp_replace(substring(path, 11), '/[^/]*$', '') || '/*' || {_EXT} AS glob FROM files",
)
_register(
    "s12_filtered_globs", lambda s, d: L.filtered_globs(files(s, d), ROOT),
    f"WITH {_FILES}, r AS (SELECT DISTINCT regexp_replace(substring(path, 11), '/[^/]*$', '') AS dir, {_EXT} AS ext FROM files), "
    "g AS (SELECT dir || '/*' || ext AS \"glob\" FROM r WHERE ext <> '' UNION SELECT array_to_string(string_split(dir, '/')[1:n], '/') || '/*' FROM r CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) t WHERE n <= len(string_split(dir, '/'))) "
    'SELECT g."glob" AS "glob" FROM g WHERE NOT contains(g."glob", \'.cache\') AND NOT contains(g."glob", \'/_tmp\') AND NOT g."glob" LIKE \'%.lock\'',
)
_register(
    "k08_output_verification", lambda s, d: L.verify_output(files(s, d), F.concat(F.lit("l"), F.col("l_suppkey") % 5)),
    f"WITH {_FILES} SELECT 'l' || CAST(l_suppkey % 5 AS VARCHAR) AS lang, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM files GROUP BY 1 UNION ALL "
    "SELECT NULL, count(*), CAST(sum(length) AS BIGINT) FROM files",
)


def _core(spark, sf_dir):
    """Documents as standard records with untidy core fields."""
    return read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "' set_' || source AS _dataset_name", "'/data/raw/' || source || ' ' AS _dataset_path",
        "CASE doc_id % 5 WHEN 0 THEN lang || '/sub/' || source WHEN 1 THEN 'sub/' || source || '/' || lang WHEN 2 THEN lang WHEN 3 THEN 'x/en/y' ELSE NULL END AS _subpath",
        "'part-' || CAST(doc_id % 3 AS STRING) || '.v1.jsonl.gz' AS _filename",
        "CASE WHEN lang = 'es' THEN ' ' ELSE lang END AS _lang", "sha2(text, 256) AS _id_hash",
    )


_register(
    "k01_processed_columns", lambda s, d: K.processed_columns(_core(s, d), F.concat(F.lit("/"), F.lit("train/"))).select("doc_id", *C.CORE_COLUMNS),
    "SELECT doc_id, 'processed__set_' || source AS _dataset_name, '/data/processed/' || source AS _dataset_path, 'train' AS _subpath, "
    "'part-' || CAST(doc_id % 3 AS VARCHAR) || '_processed' AS _filename, CASE WHEN lang = 'es' THEN 'un' ELSE lang END AS _lang, sha256(text) AS _id_hash FROM documents",
)


def _mapped(spark, sf_dir):
    core = _core(spark, sf_dir).withColumn("_dataset_name", F.when(F.col("doc_id") % 2 == 0, F.lit("mapped__x")).otherwise(F.trim("_dataset_name")))
    return K.mapped_columns(core).select("doc_id", "_dataset_name", "_subpath", "_filename", "_id_hash")


_register(
    "k02_mapped_columns", _mapped,
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'mapped__x' ELSE 'mapped__set_' || source END AS _dataset_name, "
    "CASE doc_id % 5 WHEN 0 THEN 'sub/' || source WHEN 1 THEN 'sub/' || source WHEN 2 THEN '' WHEN 3 THEN 'x/en/y' ELSE '' END AS _subpath, "
    "'part-' || CAST(doc_id % 3 AS VARCHAR) || '_mapped' AS _filename, sha256(text) AS _id_hash FROM documents",
)


def _downloaded(spark, sf_dir):
    named = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("solo")).otherwise(F.concat_ws("/", F.lit("hub"), "source", F.lit("cfg"))).alias("_dataset_name"),
        F.col("lang").alias("_lang"), F.lit("train").alias("_split"),
    )
    return K.download_columns(named, "/data/base/")


_register(
    "k03_download_columns", _downloaded,
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'solo' ELSE 'hub_' || source || '_cfg' END AS _dataset_name, lang AS _lang, "
    "CASE WHEN doc_id % 3 = 0 THEN '/data/base/solo' ELSE '/data/base/hub' END AS _dataset_path, "
    "CASE WHEN doc_id % 3 = 0 THEN lang ELSE source || '/cfg/' || lang END AS _subpath FROM documents",
)


def _json_safe(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.col("value").cast("decimal(12,2)").alias("amount"), "ts",
        F.create_map(F.col("user_id"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("by_user"),
    )
    safe = K.json_safe(rows)
    return safe.select("event_id", "value", "amount", F.substring("ts", 1, 19).alias("ts"), F.map_keys("by_user")[0].alias("user"), F.map_values("by_user")[0].alias("user_value"))


_register(
    "k05_json_safe", _json_safe,
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, "
    "CAST(user_id AS VARCHAR) AS \"user\", CASE WHEN event_id % 7 <> 0 THEN value END AS user_value FROM events",
)
