"""Record standardisation over whole documents, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import constants as C
from millrace.functions import text as T
from millrace.functions.language import choose_language, detect
from millrace.operators import standardize as S
from millrace.plans.sql_text import quote, sql_strip
from millrace.session import read_table

LANGS = ["en", "fr", "de", "es"]
ROOT = "/data/raw/corpus"
LAYER_PREFIXES = [("/data/raw", 1), ("/data/processed", 2), ("/data/mapped", 3)]
HOST_PREFIXES = [
    ("/data/raw", "/host/lake/raw"),
    ("/data/processed", "/host/lake/processed"),
    ("/data/mapped", "/host/lake/mapped"),
    ("/data", "/host/base"),
]
QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# A raw record: padded text, an often blank note, a number and a flag.
_RAW_SQL = (
    "SELECT doc_id, '  ' || text || chr(10) AS body, CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE source END AS note, "
    "n_chars AS size, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS code FROM documents"
)


def raw_records(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("body"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("   ")).otherwise(F.col("source")).alias("note"),
        F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("code"),
    )


_CLEAN = (
    f"SELECT doc_id, nullif({sql_strip('body')}, '') AS body, nullif({sql_strip('note')}, '') AS note, size, "
    f"nullif({sql_strip('code')}, '') AS code FROM ({_RAW_SQL})"
)


def _clean(spark, sf_dir):
    return S.clean(raw_records(spark, sf_dir)).select("doc_id", F.md5("body").alias("body_md5"), "note", "size", "code")


_register("p01_clean", _clean, f"SELECT doc_id, md5(body) AS body_md5, note, size, code FROM ({_CLEAN})")

_FULL = "concat_ws('', body, code, note, CAST(size AS VARCHAR))"


def _full_text(spark, sf_dir):
    records = S.clean(raw_records(spark, sf_dir))
    text = S.full_text(records, ["body", "note", "size", "code"])
    return records.select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("text_md5"))


_register(
    "p02_full_text", _full_text,
    f"SELECT doc_id, length({_FULL}) AS chars, md5({_FULL}) AS text_md5 FROM ({_CLEAN})",
)


def _id_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", S.id_hash(F.col("text")).alias("_id_hash"))


_register(
    "p03_id_hash", _id_hash,
    "SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS _id_hash FROM documents",
)


def _quarantine(spark, sf_dir):
    """Records whose text strips to nothing have no identity and go to quarantine."""
    docs = documents(spark, sf_dir)
    text = F.when(F.length("text") < 200, F.lit(" \n ")).otherwise(F.col("text"))
    hashed = S.clean(docs.select("doc_id", text.alias("text"))).withColumn("_id_hash", S.id_hash(F.coalesce("text", F.lit(""))))
    good, bad = S.split_identified(hashed)
    return good.select("doc_id", F.lit("kept").alias("outcome")).unionByName(
        bad.select("doc_id", F.lit("quarantined").alias("outcome"))
    )


_register(
    "p03_empty_quarantine", _quarantine,
    "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'quarantined' ELSE 'kept' END AS outcome FROM documents",
)

_SENTENCE = "CASE WHEN length({0}) > 64 AND contains({0}, ' ') THEN {0} END"
_SAMPLE = (
    f"coalesce({_SENTENCE.format('body')}, {_SENTENCE.format('note')}, {_SENTENCE.format('code')}, "
    "concat_ws(' ', nullif(CAST(doc_id AS VARCHAR), '0'), body, note, nullif(CAST(size AS VARCHAR), '0'), code))"
)


def _lang_sample(spark, sf_dir):
    records = S.clean(raw_records(spark, sf_dir))
    sample = S.lang_sample(records)
    return records.select("doc_id", F.length(sample).alias("chars"), F.md5(sample).alias("sample_md5"))


_register(
    "p04_lang_sample", _lang_sample,
    f"SELECT doc_id, length({_SAMPLE}) AS chars, md5({_SAMPLE}) AS sample_md5 FROM ({_CLEAN})",
)


def _language_rules(spark, sf_dir):
    """The rules around the detector, with the stored language as the detected one."""
    docs = documents(spark, sf_dir)
    found = F.col("lang")
    return docs.select(
        "doc_id",
        choose_language(F.col("text"), ["it"], found).alias("single"),
        choose_language(F.col("text"), ["en", "fr"], found).alias("two"),
        choose_language(F.col("text"), [], found).alias("none"),
        choose_language(F.col("text"), ["fr", "en", "de"], found, min_chars=10).alias("download"),
    )


_register(
    "p05_language_rules", _language_rules,
    "SELECT doc_id, 'it' AS single, CASE WHEN length(text) > 0 AND lang IN ('en', 'fr') THEN lang ELSE 'en' END AS two, "
    "'un' AS none, CASE WHEN length(text) >= 10 AND lang IN ('fr', 'en', 'de') THEN lang ELSE 'fr' END AS download "
    "FROM documents",
)


def _detected(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", detect(F.col("text")).alias("detected"))


def _detector_agreement(spark, sf_dir):
    """Detected against stored language, counted."""
    return _detected(spark, sf_dir).groupBy("lang", F.coalesce("detected", F.lit("none")).alias("detected")).agg(
        F.count("*").alias("records")
    )


def _profile_sql():
    from millrace.functions.language import PROFILES

    words = f"string_split_regex(lower(text), {quote('[^' + C.WORD_CHAR + ']+')})"
    counts = " UNION ALL ".join(
        f"SELECT doc_id, {quote(code)} AS code, len(list_filter(w, lambda x: x IN ({', '.join(map(quote, vocabulary))}))) AS score FROM b"
        for code, vocabulary in sorted(PROFILES.items())
    )
    return (
        f"WITH b AS (SELECT doc_id, {words} AS w FROM documents), s AS ({counts}), "
        "best AS (SELECT doc_id, code FROM s WHERE score > 0 "
        "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1) "
        "SELECT d.lang, coalesce(best.code, 'none') AS detected, count(*) AS records "
        "FROM documents d LEFT JOIN best USING (doc_id) GROUP BY 1, 2"
    )


_register("p05_detector_agreement", _detector_agreement, _profile_sql())

_PATH = "'/data/raw/corpus/' || source || '/part-' || CAST(doc_id % 7 AS STRING) || '/docs.jsonl.gz'"


def _standard(spark, sf_dir):
    """Full standardisation of documents: cleaned data, identity and core fields."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", F.expr(_PATH).alias("path"))
    out = S.standardize(
        docs, LANGS, F.concat(F.lit("set_"), F.col("source")), ROOT, F.col("path"), F.col("lang"), exclude=("path", "lang")
    )
    return out.select("doc_id", *C.CORE_COLUMNS)


_register(
    "p06_core_metadata", _standard,
    "SELECT doc_id, 'set_' || source AS _dataset_name, '/data/raw/corpus' AS _dataset_path, "
    "source || '/part-' || CAST(doc_id % 7 AS VARCHAR) AS _subpath, 'docs.jsonl.gz' AS _filename, "
    "CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'en' END AS _lang, "
    f"sha256(concat_ws('', CAST(doc_id AS VARCHAR), source, nullif({sql_strip('text')}, ''))) AS _id_hash FROM documents",
)


def _subpath(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"^http://|\?.*$", "")
    return pages.select("page_id", S.subpath_of(path, F.regexp_extract("url", "http://([^/]+)", 1)).alias("_subpath"))


_register(
    "p07_subpath", _subpath,
    "WITH p AS (SELECT page_id, regexp_replace(url, '^http://|\\?.*$', '', 'g') AS path, "
    "regexp_extract(url, 'http://([^/]+)', 1) AS host FROM pages), "
    "f AS (SELECT page_id, host, regexp_replace(path, '/?[^/]*$', '') AS folder FROM p) "
    "SELECT page_id, CASE WHEN starts_with(folder, host || '/') THEN substring(folder, length(host) + 2) ELSE '' END AS _subpath FROM f",
)


def _reread(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        F.col("doc_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"),
        F.col("lang").alias("_lang"),
        F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("_id_hash"),
    )
    out = S.reread(docs)
    return out.select("doc_id", F.length("_reread_text").alias("chars"), F.col("_reread_id").alias("id"))


_RT = "CAST(doc_id AS VARCHAR) || ' ' || text || ' ' || CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'None' END || ' '"
_register(
    "p08_reread", _reread,
    f"SELECT doc_id, length({_RT}) AS chars, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256({_RT}) END AS id FROM documents",
)


def _nested_rows(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("body"),
        F.struct(
            F.col("lang").alias("code"),
            F.struct(F.col("source").alias("origin"), F.col("n_chars").alias("size")).alias("inner"),
        ).alias("outer"),
        F.array(F.col("source"), F.col("text")).alias("parts"),
    )
    return docs


def _flatten(spark, sf_dir):
    out = S.truncate_and_flatten(_nested_rows(spark, sf_dir), limit=300)
    return out.select(
        "doc_id", F.length("body").alias("chars"), "code", "origin", "size",
        F.length(F.col("parts")[1]).alias("part_chars"),
    )


_register(
    "p09_truncate_flatten", _flatten,
    "SELECT doc_id, length(substring(text, 1, 300)) AS chars, lang AS code, source AS origin, n_chars AS size, "
    "length(substring(text, 1, 300)) AS part_chars FROM documents",
)
_register(
    "p09_flatten_whole",
    lambda s, d: S.truncate_and_flatten(_nested_rows(s, d)).select("doc_id", F.md5("body").alias("body_md5"), "code", "origin", "size", F.md5(F.col("parts")[1]).alias("part_md5")),
    "SELECT doc_id, md5(text) AS body_md5, lang AS code, source AS origin, n_chars AS size, md5(text) AS part_md5 FROM documents",
)
_URI = (
    "CASE doc_id % 5 WHEN 0 THEN 'file:///data/raw/' || source WHEN 1 THEN '/data/processed/' || source "
    "WHEN 2 THEN 'file:///data/mapped/' || source WHEN 3 THEN '/data/other/' || source ELSE '/mnt/data/' || source END"
)


def _rebase(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(_URI).alias("uri"))
    return docs.select("doc_id", S.rebase_path(F.col("uri"), HOST_PREFIXES).alias("uri"))


_register(
    "p10_rebase_path", _rebase,
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'file:///host/lake/raw/' || source WHEN 1 THEN '/host/lake/processed/' || source "
    "WHEN 2 THEN 'file:///host/lake/mapped/' || source WHEN 3 THEN '/host/base/other/' || source "
    "ELSE '/mnt/host/base/' || source END AS uri FROM documents",
)


def _step(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(_URI).alias("uri"))
    return docs.select("doc_id", S.step_from_uri(F.col("uri"), LAYER_PREFIXES, F.lit(9)).alias("step"))


_register(
    "p11_step_from_uri", _step,
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END AS step FROM documents",
)


def _rewrite(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang").alias("_subpath"))
    a = S.rewrite_subpath(docs, "picked").withColumnRenamed("_subpath", "appended")
    joined = S.rewrite_subpath(a, "picked", "replace").withColumnRenamed("_subpath", "added")
    return joined.select("doc_id", "appended", "added")


_register(
    "p12_rewrite_subpath", _rewrite,
    "SELECT doc_id, source || '/picked' AS appended, 'picked' AS added FROM documents",
)
