"""The mapping language, validation and schema inference over whole documents and pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

from millrace.constants import WHITESPACE
from millrace.functions import transforms as X
from millrace.operators.mapping import Mapping, json_schema_paths, mapping_counts, run_mapping
from millrace.operators.validate import infer_json_schema, presence, validate_first, with_violations
from millrace.plans.sql_text import quote, sql_collapse, sql_strip
from millrace.session import read_table
from millrace.sources.scan import json_schema

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def nested(spark, sf_dir):
    """Documents as nested records with a struct, a list of turns and a list of choices."""
    docs = read_table(spark, sf_dir, "documents")

    def turn(role, content, tag):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), tag.alias("tag"))

    return docs.select(
        "doc_id",
        F.col("text").alias("body"),
        F.struct(
            F.col("lang").alias("code"),
            F.col("source").alias("tag"),
            F.struct(F.col("source").alias("origin"), F.col("n_chars").alias("size")).alias("inner"),
        ).alias("meta"),
        F.array(
            turn("user", F.split("text", "\n")[0], F.lit("q")),
            turn("assistant", F.col("text"), F.lit("a")),
            turn("tool", F.col("source"), F.col("lang")),
        ).alias("turns"),
        F.slice(F.split("text", " "), F.lit(1), (1 + F.col("doc_id") % 5).cast("int")).alias("choices"),
        F.split("text", "\n").alias("lines"),
    )


_FIRST = "string_split(text, chr(10))[1]"
_CHOICES = "string_split(text, ' ')[1:(1 + doc_id % 5)]"


def _mapped(spec, select, **options):
    def run(spark, sf_dir):
        source = nested(spark, sf_dir)
        mapping = Mapping(spec, source.schema, **options)
        return mapping.apply(source, ["doc_id"]).selectExpr("doc_id", *select)

    return run


_register(
    "m01_source_paths",
    _mapped(
        {
            "code": ["meta.code"], "origin": ["meta.inner.origin"], "second": ["turns[1].content"],
            "roles[]": ["turns[].role"], "beyond": ["turns[7].role"], "whole": ["body[0]"], "wrapped[]": ["body[]"],
        },
        ["code", "origin", "md5(second) AS second", "array_join(roles, ',') AS roles", "beyond",
         "md5(whole) AS whole", "CAST(size(wrapped) AS BIGINT) AS wrapped"],
        declared={"properties": {
            "body": {"items": {"type": "string"}},
            "meta": {"properties": {"code": {}, "inner": {"properties": {"origin": {}}}}},
            "turns": {"items": {"properties": {"role": {}, "content": {}}}},
        }},
    ),
    "SELECT doc_id, lang AS code, source AS origin, md5(text) AS second, 'user,assistant,tool' AS roles, "
    "CAST(NULL AS VARCHAR) AS beyond, md5(text) AS whole, CAST(1 AS BIGINT) AS wrapped FROM documents",
)
_register(
    "m02_flattened_name",
    _mapped({"from": ["origin"], "n": ["size"]}, ["`from`", "n"], declared={"properties": {"origin": {}, "size": {}}}),
    "SELECT doc_id, source AS \"from\", n_chars AS n FROM documents",
)
_register(
    "m03_any_depth",
    _mapped({"tags[]": ["tag"], "first": ["tag"]}, ["array_join(tags, ',') AS tags", "`first`"], declared={"properties": {"tag": {}}}),
    "SELECT doc_id, source || ',q,a,' || lang AS tags, source AS first FROM documents",
)
_register(
    "m06_copy_and_constant",
    _mapped(
        {"copy": ["meta.code"], "text": ["no.such.path"], "number": [7], "flag": [True], "escaped": [{"lit": "body"}]},
        ["copy", "text", "number", "flag", "escaped"],
    ),
    "SELECT doc_id, lang AS copy, 'no.such.path' AS text, 7 AS number, true AS flag, 'body' AS escaped FROM documents",
)
_register(
    "m07_destination_write",
    _mapped(
        {
            "messages[0].role": ["USER"], "messages[0].content": ["turns[0].content"],
            "messages[2].role": ["ASSISTANT"], "messages[2].note.size": ["meta.inner.size"],
            "pairs[].who": ["turns[].role"], "pairs[].tag": ["turns[].tag"], "pairs[0].code": ["meta.code"],
            "deep.inner.lang": ["meta.code"], "scalar": ["turns[].role"],
        },
        ["to_json(messages) AS messages", "to_json(pairs) AS pairs", "deep.inner.lang AS deep", "scalar"],
    ),
    f"SELECT doc_id, '[{{\"role\":\"USER\",\"content\":' || to_json({_FIRST})::VARCHAR || '}},{{}},{{\"role\":\"ASSISTANT\",\"note\":{{\"size\":' || "
    "CAST(n_chars AS VARCHAR) || '}}]' AS messages, "
    "'[{\"who\":\"user\",\"tag\":\"q\",\"code\":\"' || lang || '\"},{\"who\":\"assistant\",\"tag\":\"a\"},{\"who\":\"tool\",\"tag\":\"' || lang || '\"}]' AS pairs, "
    "lang AS deep, 'user' AS scalar FROM documents",
)
_register(
    "m08_fixed_value", _mapped({"a": ["set_fixed_value", "v1"], "b": ["set_fixed_value", "meta.code"]}, ["a", "b"]),
    "SELECT doc_id, 'v1' AS a, lang AS b FROM documents",
)
_register(
    "m09_concat", _mapped({"a": ["concat", "meta.code", "", "meta.inner.size", "literal"]}, ["a"]),
    "SELECT doc_id, lang || ' ' || CAST(n_chars AS VARCHAR) || ' literal' AS a FROM documents",
)
_ROLES = {"user": "USER", "assistant": "ASSISTANT"}
_register(
    "m10_map_enum",
    _mapped(
        {"roles[]": ["map_enum", "turns[].role", _ROLES], "lang": ["map_enum", "meta.code", {"en": "English", "fr": "French"}]},
        ["array_join(roles, ',', 'none') AS roles", "lang"],
    ),
    "SELECT doc_id, 'USER,ASSISTANT,none' AS roles, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' END AS lang FROM documents",
)
_PIECES = ["the", " de", "ou"]
_removed = "text"
for _piece in _PIECES:
    _removed = f"replace({_removed}, {quote(_piece)}, '')"
_register(
    "m11_remove_strings",
    _mapped({"a": ["remove_strings", "body", _PIECES], "b": ["remove_strings", "body", []]}, ["md5(a) AS a", "md5(b) AS b"]),
    f"SELECT doc_id, md5({sql_collapse(_removed)}) AS a, md5(text) AS b FROM documents",
)
_PATTERNS = [r"[aeiou]{2,}", r"\([^)]*\)", "th."]
_subbed = "text"
for _pattern in _PATTERNS:
    _subbed = f"regexp_replace({_subbed}, {quote('(?is)' + _pattern)}, '', 'g')"
_register(
    "m12_remove_regex", _mapped({"a": ["remove_regex_strings", "body", _PATTERNS]}, ["md5(a) AS a"]),
    f"SELECT doc_id, md5({sql_collapse(_subbed)}) AS a FROM documents",
)
_register(
    "m13_remove_prefix", _mapped({"a": ["remove_prefix", "the", "body"]}, ["md5(a) AS a"]),
    "SELECT doc_id, md5(CASE WHEN instr(text, 'the') > 0 THEN "
    f"regexp_replace(substring(text, instr(text, 'the') + 3), {quote('^[' + WHITESPACE + ']+')}, '') ELSE text END) AS a FROM documents",
)


def _page_tags(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    mapping = Mapping(
        {f"{tag}": ["extract_tag_content", tag, "html"] for tag in ("p", "title", "blink")}, pages.schema
    )
    return mapping.apply(pages, ["page_id"]).select("page_id", *[F.md5(c).alias(c) for c in ("p", "title", "blink")])


def _extract_sql(tag):
    gap = f"[{WHITESPACE}]*"
    pattern = quote(f"(?is)<{gap}{tag}{gap}>(.*?)</{gap}{tag}{gap}>")
    inner = sql_strip(f"regexp_extract(html, {pattern}, 1)")
    return f"md5(CASE WHEN regexp_matches(html, {pattern}) THEN '[' || {inner} || ']' END) AS {tag}"


_register(
    "m14_extract_tag", _page_tags,
    f"SELECT page_id, {', '.join(map(_extract_sql, ('p', 'title', 'blink')))} FROM pages",
)


def _remove_tags(spark, sf_dir):
    """Tags removed from pages, and from pages wrapped in tags nested two deep."""
    pages = read_table(spark, sf_dir, "pages").withColumn(
        "deep", F.concat(F.lit("a <b>x <b>"), "html", F.lit("</b> y</b> z </b>"))
    )
    mapping = Mapping({t_: ["remove_tag_content", t_, "html"] for t_ in ("p", "li")} | {"b": ["remove_tag_content", "b", "deep"]}, pages.schema)
    return mapping.apply(pages, ["page_id"]).select("page_id", *[F.md5(c).alias(c) for c in ("p", "li", "b")])


def _remove_sql(tag, column, depth=4):
    gap = f"[{WHITESPACE}]*"
    pattern = quote(f"(?is)<{gap}{tag}{gap}>.*?</{gap}{tag}{gap}>")
    out = column
    for _ in range(depth):
        out = f"regexp_replace({out}, {pattern}, ' ', 'g')"
    return f"md5({sql_collapse(out)}) AS {tag}"


_DEEP = "('a <b>x <b>' || html || '</b> y</b> z </b>')"
_register(
    "m15_remove_tag", _remove_tags,
    f"SELECT page_id, {_remove_sql('p', 'html')}, {_remove_sql('li', 'html')}, {_remove_sql('b', _DEEP)} FROM pages",
)
_CHOICE = " || ".join(
    f"CASE WHEN len(ch) > {i} THEN chr(10) || '{letter}: ' || ch[{i + 1}] ELSE '' END" for i, letter in enumerate("ABCD")
)
_register(
    "m16_lettered_choices",
    _mapped({"a": ["ARC_simple_chat", "turns[0].content", "choices"]}, ["md5(a) AS a"]),
    f"SELECT doc_id, md5({_FIRST} || {_CHOICE}) AS a FROM (SELECT *, {_CHOICES} AS ch FROM documents)",
)
_register(
    "m16_whole_choices",
    _mapped({"a": ["ARC_simple_chat", "body", "lines"]}, ["md5(a) AS a"]),
    f"SELECT doc_id, md5(text || {_CHOICE}) AS a FROM (SELECT *, string_split(text, chr(10)) AS ch FROM documents)",
)

CHAT_TARGET = {
    "type": "object",
    "required": ["messages", "template", "_lang", "_id_hash"],
    "properties": {
        "messages": {
            "type": "array", "minItems": 1,
            "items": {
                "type": "object", "required": ["role", "content"],
                "properties": {
                    "role": {"type": "string", "enum": ["USER", "ASSISTANT", "SYSTEM"]},
                    "content": {"anyOf": [{"type": "string", "minLength": 1, "maxLength": 8000}, {"type": "null"}]},
                },
                "additionalProperties": False,
            },
        },
        "template": {"type": "string", "enum": ["simple_chat", "context_chat"]},
        "context": {"type": ["string", "null"], "minLength": 1},
        "_lang": {"type": "string", "maxLength": 2},
        "_id_hash": {"type": "string", "pattern": "^[a-fA-F0-9]{64}$"},
    },
    "additionalProperties": False,
}
CHAT_SPEC = {
    "messages[0].role": ["USER"],
    "messages[0].content": ["ARC_simple_chat", "turns[0].content", "choices"],
    "messages[1].role": ["ASSISTANT"],
    "messages[1].content": ["turns[1].content"],
    "template": ["simple_chat"],
    "context": ["concat", "meta.inner.origin", "meta.code"],
    "_lang": ["meta.code"],
    "_id_hash": ["hash"],
}


def chat_mapping(spark, sf_dir):
    source = nested(spark, sf_dir).withColumn("hash", F.when(F.col("doc_id") % 9 == 0, F.lit("bad")).otherwise(F.sha2("body", 256)))
    return source, Mapping(CHAT_SPEC, source.schema, target=CHAT_TARGET)


_BAD = "(doc_id % 9 = 0)"
_QUESTION = f"({_FIRST} || {_CHOICE})"
_TOO_LONG = f"(length(text) > 8000 OR length({_QUESTION}) > 8000)"

BAD_RECORD, CHOICES = f"({_BAD} OR {_TOO_LONG})", _CHOICES


def _mapped_records(spark, sf_dir):
    source, mapping = chat_mapping(spark, sf_dir)
    good, _ = run_mapping(source, mapping, ["doc_id"])
    return good.select("doc_id", "_lang", "template", "context", F.md5(F.col("messages")[0]["content"]).alias("question"))


_register(
    "m18_map_and_validate", _mapped_records,
    f"SELECT doc_id, lang AS _lang, 'simple_chat' AS template, source || ' ' || lang AS context, md5({_QUESTION}) AS question "
    f"FROM (SELECT *, {_CHOICES} AS ch FROM documents) WHERE NOT {_BAD} AND NOT {_TOO_LONG}",
)


def _quarantined(spark, sf_dir):
    source, mapping = chat_mapping(spark, sf_dir)
    _, bad = run_mapping(source, mapping, ["doc_id"])
    return bad.select("doc_id", F.array_contains("errors", "_id_hash: does not match the pattern").alias("bad_hash"),
                      F.array_contains("errors", "messages[].content: no alternative matches").alias("bad_content"))


_register(
    "m18_quarantine", _quarantined,
    f"SELECT doc_id, {_BAD} AS bad_hash, {_TOO_LONG} AS bad_content FROM (SELECT *, {_CHOICES} AS ch FROM documents) "
    f"WHERE {_BAD} OR {_TOO_LONG}",
)


def _counts(spark, sf_dir):
    source, mapping = chat_mapping(spark, sf_dir)
    return mapping_counts(mapping.apply(source))


_register(
    "m19_mapping_counts", _counts,
    f"SELECT count(*) AS read, count(*) FILTER (NOT ({_BAD} OR {_TOO_LONG})) AS mapped, count(*) FILTER ({_BAD} OR {_TOO_LONG}) AS skipped "
    f"FROM (SELECT *, {_CHOICES} AS ch FROM documents)",
)


def _sample_mapping(spark, sf_dir):
    """Preview of the mapping on the first records by id, with the errors of each."""
    source, mapping = chat_mapping(spark, sf_dir)
    return mapping.apply(source.orderBy("doc_id").limit(50), ["doc_id"]).select("doc_id", F.size("errors").cast("long").alias("errors"))


_register(
    "m20_mapping_on_sample", _sample_mapping,
    f"SELECT doc_id, CAST(CASE WHEN {_BAD} THEN 1 ELSE 0 END + CASE WHEN length(text) > 8000 THEN 1 ELSE 0 END + "
    f"CASE WHEN length({_QUESTION}) > 8000 THEN 1 ELSE 0 END AS BIGINT) AS errors "
    f"FROM (SELECT *, {_CHOICES} AS ch FROM documents ORDER BY doc_id LIMIT 50)",
)


@F.pandas_udf(t.ArrayType(t.StringType()))
def capital_words(text: pd.Series) -> pd.Series:
    """A trusted user function: the distinct words that start with a capital letter."""
    return text.map(lambda s: sorted({w for w in s.split() if w[:1].isupper()}))


def _user_function(spark, sf_dir):
    source = nested(spark, sf_dir)
    mapping = Mapping({"capitals": ["capital_words", "body"]}, source.schema, functions={"capital_words": lambda c: capital_words(c)})
    return mapping.apply(source, ["doc_id"]).select("doc_id", F.size("capitals").cast("long").alias("capitals"))


_register(
    "d02_user_function", _user_function,
    "SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(text, "
    f"{quote('[' + WHITESPACE + ']+')}), lambda w: regexp_matches(w, '^\\p{{Lu}}')))) AS BIGINT) AS capitals FROM documents",
)


def _sparse(spark, sf_dir):
    source = nested(spark, sf_dir)
    return source.select(
        F.when(F.col("doc_id") % 4 != 0, F.col("body")).alias("body"),
        F.struct(F.col("meta.code").alias("code"), F.when(F.col("doc_id") % 3 == 0, F.col("meta.tag")).alias("tag")).alias("meta"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.nullif(x["tag"], F.lit("q")).alias("tag"))).alias("turns"),
    )


def _presence(spark, sf_dir):
    return presence(_sparse(spark, sf_dir))


_register(
    "v01_schema_presence", _presence,
    "WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 4 <> 0) AS b, count(*) FILTER (doc_id % 3 = 0) AS t FROM documents) "
    "SELECT path, type, CAST(present AS BIGINT) AS present, CAST(total AS BIGINT) AS total, present = total AS required FROM ("
    "SELECT 'body' AS path, 'string' AS type, b AS present, n AS total FROM n UNION ALL "
    "SELECT 'meta', 'object', n, n FROM n UNION ALL SELECT 'meta.code', 'string', n, n FROM n UNION ALL "
    "SELECT 'meta.tag', 'string', t, n FROM n UNION ALL SELECT 'turns', 'array', n, n FROM n UNION ALL "
    "SELECT 'turns[].role', 'string', 3 * n, 3 * n FROM n UNION ALL SELECT 'turns[].tag', 'string', 2 * n, 3 * n FROM n)",
)
_RECORD_SCHEMA = {
    "type": "object", "required": ["text", "lang", "missing"],
    "properties": {
        "text": {"type": "string", "minLength": 100, "maxLength": 5000, "pattern": "^[A-Z]"},
        "lang": {"type": "string", "enum": ["en", "fr", "de"]},
        "n_chars": {"type": "string"},
        "source": {"type": ["string", "null"]},
    },
}


def _validated(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = with_violations(docs, _RECORD_SCHEMA)
    return out.select("doc_id", F.size("errors").cast("long").alias("errors"), F.array_join(F.array_sort("errors"), ";").alias("messages"))


_MESSAGES = [
    ("lang NOT IN ('en', 'fr', 'de')", "lang: is not one of the listed values"),
    ("true", "n_chars: is not of type string"),
    ("true", "record: missing is required"),
    ("NOT regexp_matches(text, '^[A-Z]')", "text: does not match the pattern"),
    ("length(text) > 5000", "text: is too long"),
    ("length(text) < 100", "text: is too short"),
]
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quote(m)} END" for c, m in _MESSAGES) + "], lambda x: x IS NOT NULL)"
_register(
    "v02_schema_violations", _validated,
    f"SELECT doc_id, CAST(len({_FOUND}) AS BIGINT) AS errors, array_to_string({_FOUND}, ';') AS messages FROM documents",
)


def _first_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").orderBy("doc_id")
    return validate_first(docs, _RECORD_SCHEMA).select("doc_id", F.size("errors").cast("long").alias("errors"))


_register(
    "v03_first_sample", _first_sample,
    f"SELECT doc_id, CAST(len({_FOUND}) AS BIGINT) AS errors FROM documents ORDER BY doc_id LIMIT 1",
)


def _from_text(spark, sf_dir):
    """The sparse records as JSON text, read back with the schema that fits all of them."""
    text = _sparse(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return text.select(F.from_json("value", json_schema(text)).alias("r")).select("r.*")


def _emitted(spark, sf_dir):
    """The JSON Schema document of all records, beside their number."""
    records = _from_text(spark, sf_dir)
    document = json.dumps(infer_json_schema(records), sort_keys=True)
    return records.agg(F.count("*").alias("records")).withColumn("json_schema", F.lit(document))


_SPARSE_SCHEMA = (
    '{"properties": {"body": {"type": "string"}, "meta": {"properties": {"code": {"type": "string"}, "tag": {"type": "string"}}, "required": ["code"], "type": "object"}, '
    '"turns": {"items": {"properties": {"role": {"type": "string"}, "tag": {"type": "string"}}, "required": ["role"], "type": "object"}, "type": "array"}}, '
    '"required": ["meta", "turns"], "type": "object"}'
)
_register("v01_json_schema", _emitted, f"SELECT count(*) AS records, '{_SPARSE_SCHEMA}' AS json_schema FROM documents")


def _valid_paths(spark, sf_dir):
    """Paths that a mapping may name, from the emitted schema, with the records that have them."""
    records = _from_text(spark, sf_dir)
    paths = json_schema_paths(infer_json_schema(records))
    have = presence(records).select("path", "present")
    return spark.createDataFrame([(p,) for p in paths], "path string").join(have, "path", "left")


_register(
    "m04_valid_paths", _valid_paths,
    "SELECT path, CASE path WHEN 'body' THEN count(*) FILTER (doc_id % 4 <> 0 AND text IS NOT NULL) WHEN 'meta.tag' THEN count(source) FILTER (doc_id % 3 = 0) WHEN 'meta.code' THEN count(lang) "
    "WHEN 'turns[].role' THEN 3 * count(*) WHEN 'turns[].tag' THEN count(*) + count(lang) WHEN 'turns[]' THEN NULL ELSE count(*) END AS present "
    "FROM documents, (VALUES ('body'), ('meta'), ('meta.code'), ('meta.tag'), ('turns'), ('turns[]'), ('turns[].role'), ('turns[].tag')) v(path) GROUP BY path",
)
