"""Conversation statistics over whole conversations, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import constants as C
from millrace.functions.chat_stats import (
    CHAT_COLUMNS,
    RATIOS,
    chat_stats_of_messages,
    chat_stats_of_turns,
    messages_of,
)
from millrace.plans.sql_text import quote, sql_fertility
from millrace.session import read_table


def _rounded(df, key, columns):
    return df.select(F.col("id").alias(key), *[F.round(c, 6).alias(c) if c in RATIOS else F.col(c) for c in columns])


def conversation_stats(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return chat_stats_of_turns(turns, "conv_id", "turn", "role", "text")


def page_messages(spark, sf_dir):
    """Each page as a two-message record: its address asked for, its source answered."""
    pages = read_table(spark, sf_dir, "pages")
    user = F.struct(F.lit("user").alias("role"), F.col("url").alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.col("html").alias("content"))
    full = [
        F.struct(
            m["role"].alias("role"),
            m["content"].alias("content"),
            F.lit(None).cast("string").alias("think"),
            F.lit(None).cast("struct<payload:string,response:string,call:string>").alias("functioncall"),
            F.lit(None).cast("string").alias("context"),
        )
        for m in (user, assistant)
    ]
    return pages.select(F.col("page_id").alias("id"), F.lit("en").alias("_lang"), F.array(*full).alias("messages"))


def document_messages(spark, sf_dir, *more):
    """Documents whose first line is a system prompt, whose text is asked and answered,
    with the second line as think text and the source as context and call payload; ``more``
    columns of the documents go along."""
    docs = read_table(spark, sf_dir, "documents")
    first = F.split("text", "\n")[0]
    even = F.col("doc_id") % 2 == 0
    none = F.lit(None).cast("string")

    def message(role, content, think=none, payload=none, context=none):
        return F.struct(
            F.lit(role).alias("role"),
            content.alias("content"),
            think.alias("think"),
            F.struct(payload.alias("payload"), none.alias("response"), none.alias("call")).alias("functioncall"),
            context.alias("context"),
        )

    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("_lang"),
        F.array(
            message("System", first),
            message("User", F.col("text"), context=F.when(even, F.col("source"))),
            message("Assistant", F.col("text"), think=F.when(even, F.col("text")), payload=F.when(~even, F.col("source"))),
        ).alias("messages"),
        *more,
    )


# ---- oracle side: one row per message, aggregated -----------------------------------
_CONV = (
    "SELECT conv_id AS id, turn, upper(role) AS r, coalesce(text, '') AS c, NULL::VARCHAR AS think, "
    "NULL::VARCHAR AS payload, NULL::VARCHAR AS ctx, 'en' AS lg FROM conversations"
)
_PAGE = (
    "SELECT page_id AS id, 0 AS turn, 'USER' AS r, url AS c, NULL::VARCHAR AS think, NULL::VARCHAR AS payload, "
    "NULL::VARCHAR AS ctx, 'en' AS lg FROM pages UNION ALL "
    "SELECT page_id, 1, 'ASSISTANT', html, NULL, NULL, NULL, 'en' FROM pages"
)
_DOC = (
    "SELECT doc_id AS id, 0 AS turn, 'SYSTEM' AS r, string_split(text, chr(10))[1] AS c, NULL::VARCHAR AS think, "
    "NULL::VARCHAR AS payload, NULL::VARCHAR AS ctx, lang AS lg FROM documents UNION ALL "
    "SELECT doc_id, 1, 'USER', text, NULL, NULL, CASE WHEN doc_id % 2 = 0 THEN source END, lang FROM documents UNION ALL "
    "SELECT doc_id, 2, 'ASSISTANT', text, CASE WHEN doc_id % 2 = 0 THEN text END, "
    "CASE WHEN doc_id % 2 = 1 THEN source END, NULL, lang FROM documents"
)


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(c, {quote(pattern)}))"


def _has(pattern: str) -> str:
    return f"regexp_matches(c, {quote(pattern)})"


def _sum(value: str, where: str = "true") -> str:
    return f"CAST(coalesce(sum({value}) FILTER ({where}), 0) AS BIGINT)"


def _flag(test: str) -> str:
    return f"CAST(max(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"


_U, _A, _S = "r = 'USER'", "r = 'ASSISTANT'", "r = 'SYSTEM'"
_WORDS = _count("[" + C.WORD_CHAR + "]+")
_CODE = r"(?s)```.*?```|`[^`]+`"
_BREAK = quote(C.LINE_BREAK)
_STEPS = (
    f"(len(string_split_regex(think, {_BREAK})) - "
    f"CASE WHEN string_split_regex(think, {_BREAK})[-1] = '' THEN 1 ELSE 0 END)"
)
_SQL = {
    "_user_char_count": _sum("length(c)", _U),
    "_assistant_char_count": _sum("length(c)", _A),
    "_system_char_count": _sum("length(c)", _S),
    "_user_word_count": _sum(_WORDS, _U),
    "_assistant_word_count": _sum(_WORDS, _A),
    "_system_word_count": _sum(_WORDS, _S),
    "_user_message_count": f"count(*) FILTER ({_U})",
    "_assistant_message_count": f"count(*) FILTER ({_A})",
    "_context_count": "count(*) FILTER (coalesce(ctx, '') <> '')",
    "_think_message_count": "count(*) FILTER (coalesce(think, '') <> '')",
    "_functioncall_message_count": "count(*) FILTER (coalesce(payload, '') <> '')",
    "_think_char_total": _sum("length(think)", "coalesce(think, '') <> ''"),
    "_think_steps_total": _sum(_STEPS, "coalesce(think, '') <> ''"),
    "_user_code_count": _sum(_count(_CODE), _U),
    "_curly_brackets_count": _sum(_count("[{}]")),
    "_html_tag_count": _sum(_count("<[^>]+>"), _A),
    "_xml_tag_count": _sum(_count(r"<[^>\s]+[^>]*>|</[^>]+>"), _A),
    "_has_system": _flag(_S),
    "_has_context": _flag("coalesce(ctx, '') <> ''"),
    "_has_think": _flag("coalesce(think, '') <> ''"),
    "_has_functioncall": _flag("coalesce(payload, '') <> ''"),
    "_user_ends_with_question": _flag(f"{_U} AND {_has('[?][' + C.WHITESPACE + ']*$')}"),
    "_assistant_has_json": _flag(_A + " AND " + _has(r"(?s)\{.*\}|\[.*\]")),
    "_assistant_has_code": _flag(f"{_A} AND {_has(_CODE)}"),
    "_assistant_has_markdown": _flag(_A + " AND " + _has(r"\*\*.*?\*\*|__.*?__|~~.*?~~|###|##|#")),
    "_assistant_has_table": _flag(_A + " AND " + _has(r"\|.*\|.*\|")),
    "_assistant_has_math": _flag(_A + " AND " + _has(r"\$\$(?s:.)*?\$\$|\$[^$]*?\$|\\\[|\\\(|\\\)|\\\]")),
}


def _over(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 6)"


_LAST = "(arg_max(length(c), turn) FILTER ({}))"
_FACTOR = sql_fertility("max(lg)")
_DERIVED = {
    "_user_avg_length": _over(_SQL["_user_char_count"], _SQL["_user_message_count"]),
    "_assistant_avg_length": _over(_SQL["_assistant_char_count"], _SQL["_assistant_message_count"]),
    "_user_assistant_ratio": _over(_SQL["_user_char_count"], _SQL["_assistant_char_count"]),
    "_last_interaction_ratio": _over(f"coalesce({_LAST.format(_U)}, 0)", _LAST.format(_A)),
    "_think_to_content_ratio": _over(_SQL["_think_char_total"], _SQL["_assistant_char_count"]),
    "_user_word_mean": f"round(coalesce(avg({_WORDS}) FILTER ({_U}), 0.0), 6)",
    "_assistant_word_mean": f"round(coalesce(avg({_WORDS}) FILTER ({_A}), 0.0), 6)",
    "_message_count": "count(*)",
    "_system_token_count": f"CAST(trunc({_SQL['_system_word_count']} * {_FACTOR}) AS BIGINT)",
    "_user_token_count": f"CAST(trunc({_SQL['_user_word_count']} * {_FACTOR}) AS BIGINT)",
    "_assistant_token_count": f"CAST(trunc({_SQL['_assistant_word_count']} * {_FACTOR}) AS BIGINT)",
    "_context_token_count": f"CAST(trunc({_SQL['_context_count']} * {_FACTOR}) AS BIGINT)",
}
CHAT_SQL = {**_SQL, **_DERIVED}
SOURCES = {"conversations": (_CONV, "conv_id"), "pages": (_PAGE, "page_id"), "documents": (_DOC, "doc_id")}


def oracle(source: str, columns: list[str]) -> str:
    body, key = SOURCES[source]
    picked = ", ".join(f"{CHAT_SQL[c]} AS {c}" for c in columns)
    return f"SELECT id AS {key}, {picked} FROM ({body}) GROUP BY id"


def _spark(source: str, columns: list[str]):
    def run(spark, sf_dir):
        if source == "conversations":
            stats = conversation_stats(spark, sf_dir)
        elif source == "pages":
            stats = chat_stats_of_messages(page_messages(spark, sf_dir))
        else:
            stats = chat_stats_of_messages(document_messages(spark, sf_dir))
        return _rounded(stats, SOURCES[source][1], columns)

    return run


_ROWS = {
    "c02_roles": ("conversations", ["_user_message_count", "_assistant_message_count", "_has_system"]),
    "c03_char_counts": ("documents", ["_user_char_count", "_assistant_char_count", "_system_char_count"]),
    "c04_word_counts": ("documents", ["_user_word_count", "_assistant_word_count", "_system_word_count"]),
    "c05_message_counts": ("conversations", ["_user_message_count", "_assistant_message_count", "_message_count"]),
    "c06_think": ("documents", ["_has_think", "_think_message_count", "_think_char_total", "_think_steps_total"]),
    "c07_functioncall": ("documents", ["_has_functioncall", "_functioncall_message_count"]),
    "c08_context": ("documents", ["_has_context", "_context_count"]),
    "c09_has_system": ("documents", ["_has_system"]),
    "c10_curly_brackets": ("pages", ["_curly_brackets_count"]),
    "c11_question_end": ("documents", ["_user_ends_with_question"]),
    "c12_user_code": ("documents", ["_user_code_count"]),
    "c13_assistant_markers": (
        "pages",
        ["_assistant_has_json", "_assistant_has_code", "_assistant_has_markdown", "_assistant_has_table", "_assistant_has_math"],
    ),
    "c13_document_markers": (
        "documents",
        ["_assistant_has_json", "_assistant_has_code", "_assistant_has_markdown", "_assistant_has_table", "_assistant_has_math"],
    ),
    "c14_tags": ("pages", ["_html_tag_count", "_xml_tag_count"]),
    "c15_mean_lengths": ("conversations", ["_user_avg_length", "_assistant_avg_length"]),
    "c16_user_assistant_ratio": ("conversations", ["_user_assistant_ratio"]),
    "c17_last_interaction": ("conversations", ["_last_interaction_ratio"]),
    "c18_think_ratio": ("documents", ["_think_to_content_ratio"]),
    "c19_word_means": ("conversations", ["_user_word_mean", "_assistant_word_mean"]),
    "c20_token_counts": ("documents", ["_system_token_count", "_user_token_count", "_assistant_token_count"]),
    "c21_context_tokens": ("documents", ["_context_token_count"]),
    "c22_all_turns": ("conversations", CHAT_COLUMNS),
    "c22_all_messages": ("documents", CHAT_COLUMNS),
}
QUERIES = {name: _spark(source, columns) for name, (source, columns) in _ROWS.items()}
ORACLES = {name: oracle(source, columns) for name, (source, columns) in _ROWS.items()}


def _message_source(spark, sf_dir):
    """Messages taken from mapped data, from the root field or from JSON text."""
    records = page_messages(spark, sf_dir)
    kind = F.col("id") % 3
    wrapped = records.select(
        "id", "_lang",
        F.when(kind == 0, F.col("messages")).alias("mapped"),
        F.when(kind == 1, F.col("messages")).alias("root"),
        F.when(kind == 2, F.to_json(F.struct("messages"))).alias("text"),
    )
    stats = chat_stats_of_messages(wrapped, messages_of(wrapped, "text", "mapped", "root"))
    columns = ["_message_count", "_user_char_count", "_assistant_char_count"]
    return _rounded(stats, "page_id", columns)


QUERIES["c01_message_source"] = _message_source
ORACLES["c01_message_source"] = oracle("pages", ["_message_count", "_user_char_count", "_assistant_char_count"])
