"""Conversation statistics: ``id`` and 39 numeric columns per conversation.

Two shapes give the same result. ``chat_stats_of_messages`` works inside the row on
an array of messages and needs no shuffle. ``chat_stats_of_turns`` works on one row
per turn with algebraic aggregates only, so map-side combining shrinks a conversation
to one partial row before the shuffle and a huge conversation is never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from millrace import constants as C
from millrace.functions import text as T

# --- Fixed values: content patterns ---------------------------------------------
# Existence tests are written in a form that scans the content once.
CODE_SPAN = r"(?s)```.*?```|`[^`]+`"
MARKDOWN = r"\*\*[^\n]*?\*\*|__[^\n]*?__|~~[^\n]*?~~|#"
TABLE = r"\|[^\n|]*\|[^\n|]*\|"
MATH = r"\$[^$]*\$|\\[\[\]()]"
HTML_TAG = r"<[^>]+>"
XML_TAG = rf"<[^>{C.WHITESPACE}][^>]*>"
QUESTION_END = rf"\?[{C.WHITESPACE}]*\z"
WORD = f"[{C.WORD_CHAR}]+"

MESSAGE_TYPE = t.StructType(
    [
        t.StructField("role", t.StringType()),
        t.StructField("content", t.StringType()),
        t.StructField("think", t.StringType()),
        t.StructField(
            "functioncall",
            t.StructType([t.StructField(n, t.StringType()) for n in ("payload", "response", "call")]),
        ),
        t.StructField("context", t.StringType()),
    ]
)
MESSAGES_TYPE = t.ArrayType(MESSAGE_TYPE)

SUMS = [
    "user_char_count", "assistant_char_count", "system_char_count",
    "user_word_count", "assistant_word_count", "system_word_count",
    "user_message_count", "assistant_message_count", "context_count", "think_message_count",
    "functioncall_message_count", "think_char_total", "think_steps_total", "user_code_count",
    "curly_brackets_count", "html_tag_count", "xml_tag_count",
]
FLAGS = [
    "has_system", "has_context", "has_think", "has_functioncall", "user_ends_with_question",
    "assistant_has_json", "assistant_has_code", "assistant_has_markdown", "assistant_has_table",
    "assistant_has_math",
]
RATIOS = [
    "_user_avg_length", "_assistant_avg_length", "_user_assistant_ratio", "_last_interaction_ratio",
    "_think_to_content_ratio", "_user_word_mean", "_assistant_word_mean",
]
TOTALS = [
    "_message_count", "_system_token_count", "_user_token_count", "_assistant_token_count", "_context_token_count",
]
CHAT_COLUMNS = [f"_{c}" for c in SUMS + FLAGS] + RATIOS + TOTALS


def _spans(opening: str, closing: str, content: Column) -> Column:
    """Whether ``closing`` occurs somewhere after ``opening``."""
    start = F.locate(opening, content)
    return (start > 0) & (F.instr(F.substring(content, start + 1, F.length(content)), closing) > 0)


def filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def message_metrics(
    role: Column, content: Column, think: Column, payload: Column, context: Column
) -> dict[str, Column]:
    """Every sum and flag of one message as a number."""
    role = F.upper(F.coalesce(role, F.lit("")))
    content = F.coalesce(content, F.lit(""))
    user, assistant, system = role == "USER", role == "ASSISTANT", role == "SYSTEM"
    size = F.length(content)
    words = F.regexp_count(content, F.lit(WORD))

    def only(role_test: Column, value: Column) -> Column:
        return F.when(role_test, value).otherwise(0).cast("long")

    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0).cast("long")

    # A search for the literal that every match needs costs little; most contents lack it.
    def holds(*literals: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(content, F.lit(x)) for x in literals])

    def matches(pattern: str, *literals: str) -> Column:
        return holds(*literals) & F.rlike(content, F.lit(pattern))

    def occurrences(pattern: str, literal: str) -> Column:
        return F.when(holds(literal), F.regexp_count(content, F.lit(pattern))).otherwise(0)

    thinks = filled(think)
    steps = T.line_count(F.coalesce(think, F.lit("")))
    return {
        "user_char_count": only(user, size),
        "assistant_char_count": only(assistant, size),
        "system_char_count": only(system, size),
        "user_word_count": only(user, words),
        "assistant_word_count": only(assistant, words),
        "system_word_count": only(system, words),
        "user_message_count": flag(user),
        "assistant_message_count": flag(assistant),
        "context_count": flag(filled(context)),
        "think_message_count": flag(thinks),
        "functioncall_message_count": flag(filled(payload)),
        "think_char_total": only(thinks, F.length(think)),
        "think_steps_total": only(thinks, steps),
        "user_code_count": only(user, occurrences(CODE_SPAN, "`")),
        "curly_brackets_count": (T.count_literal(content, "{") + T.count_literal(content, "}")).cast("long"),
        "html_tag_count": only(assistant, occurrences(HTML_TAG, "<")),
        "xml_tag_count": only(assistant, occurrences(XML_TAG, "<")),
        "has_system": flag(system),
        "has_context": flag(filled(context)),
        "has_think": flag(thinks),
        "has_functioncall": flag(filled(payload)),
        "user_ends_with_question": flag(user & matches(QUESTION_END, "?")),
        "assistant_has_json": flag(assistant & (_spans("{", "}", content) | _spans("[", "]", content))),
        "assistant_has_code": flag(assistant & matches(CODE_SPAN, "`")),
        "assistant_has_markdown": flag(assistant & matches(MARKDOWN, "**", "__", "~~", "#")),
        "assistant_has_table": flag(assistant & matches(TABLE, "|")),
        "assistant_has_math": flag(assistant & matches(MATH, "$", "\\")),
    }


def _finish(df: DataFrame) -> DataFrame:
    """Derived columns from ``id``, ``_factor``, the sums, the flags, ``messages``, ``last_user`` and ``last_assistant``."""
    factor = F.col("_factor")
    col = F.col

    def tokens(count: str) -> Column:
        return (col(count) * factor).cast("long")

    derived = {
        "_user_avg_length": T.safe_ratio(col("user_char_count"), col("user_message_count")),
        "_assistant_avg_length": T.safe_ratio(col("assistant_char_count"), col("assistant_message_count")),
        "_user_assistant_ratio": T.safe_ratio(col("user_char_count"), col("assistant_char_count")),
        "_last_interaction_ratio": T.safe_ratio(F.coalesce(col("last_user"), F.lit(0)), col("last_assistant")),
        "_think_to_content_ratio": T.safe_ratio(col("think_char_total"), col("assistant_char_count")),
        "_user_word_mean": T.safe_ratio(col("user_word_count"), col("user_message_count")),
        "_assistant_word_mean": T.safe_ratio(col("assistant_word_count"), col("assistant_message_count")),
        "_message_count": col("messages").cast("long"),
        "_system_token_count": tokens("system_word_count"),
        "_user_token_count": tokens("user_word_count"),
        "_assistant_token_count": tokens("assistant_word_count"),
        # The multiplier applies to the number of contexts, not to their words.
        "_context_token_count": tokens("context_count"),
    }
    plain = [col(c).alias(f"_{c}") for c in SUMS + FLAGS]
    return df.select("id", *plain, *[derived[c].alias(c) for c in RATIOS + TOTALS])


def messages_of(df: DataFrame, text_col: str = "text", nested_col: str | None = None, root_col: str | None = None) -> Column:
    """The messages of a record: mapped data first, then the root field, then JSON text."""
    candidates = [F.col(c) for c in (nested_col, root_col) if c]
    candidates = [F.when(F.size(c) > 0, c) for c in candidates]
    if text_col in df.columns:
        looks_like_json = F.rlike(F.col(text_col), F.lit(rf"\A[{C.WHITESPACE}]*\{{"))
        schema = t.StructType([t.StructField("messages", MESSAGES_TYPE)])
        candidates.append(F.when(looks_like_json, F.from_json(F.col(text_col), schema)["messages"]))
    return F.coalesce(*candidates)


def chat_stats_of_messages(
    df: DataFrame,
    messages: Column | str = "messages",
    id_col: str = "id",
    lang_col: str = "_lang",
    fertility: dict[str, float] | None = None,
) -> DataFrame:
    """In-row shape over ``array<struct<role, content, think, functioncall, context>>``."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    lang = F.coalesce(F.col(lang_col), F.lit(C.STATS_DEFAULT_LANG))
    base = df.select(
        F.col(id_col).alias("id"),
        T.fertility_of(lang, C.FERTILITY if fertility is None else fertility).alias("_factor"),
        F.coalesce(messages.cast(MESSAGES_TYPE), F.array().cast(MESSAGES_TYPE)).alias("_ms"),
    )

    def measure(m: Column) -> Column:
        call = F.coalesce(F.nullif(m["functioncall"]["payload"], F.lit("")), m["functioncall"]["call"])
        metrics = message_metrics(m["role"], m["content"], m["think"], call, m["context"])
        return F.struct(
            F.upper(m["role"]).alias("role"),
            F.length(F.coalesce(m["content"], F.lit(""))).alias("size"),
            *[metrics[c].alias(c) for c in SUMS + FLAGS],
        )

    measured = base.select("id", "_factor", F.transform("_ms", measure).alias("_mm"))

    def last_size(role: str) -> Column:
        return F.try_element_at(F.filter("_mm", lambda m: m["role"] == role), F.lit(-1))["size"]

    def total(name: str) -> Column:
        return F.aggregate(F.col(f"_mm.{name}"), F.lit(0).cast("long"), lambda a, x: a + x)

    folded = measured.select(
        "id", "_factor",
        *[total(c).alias(c) for c in SUMS],
        *[F.coalesce(F.array_max(F.col(f"_mm.{c}")), F.lit(0).cast("long")).alias(c) for c in FLAGS],
        F.size("_mm").alias("messages"),
        last_size("USER").alias("last_user"),
        last_size("ASSISTANT").alias("last_assistant"),
    )
    return _finish(folded)


def chat_stats_of_turns(
    df: DataFrame,
    id_col: str,
    turn_col: str,
    role_col: str,
    content_col: str,
    lang: Column | None = None,
    think_col: str | None = None,
    payload_col: str | None = None,
    context_col: str | None = None,
    fertility: dict[str, float] | None = None,
) -> DataFrame:
    """Grouped shape over one row per turn; ``lang`` must be constant per conversation."""
    absent = F.lit(None).cast("string")
    optional = [F.col(c) if c else absent for c in (think_col, payload_col, context_col)]
    metrics = message_metrics(F.col(role_col), F.col(content_col), *optional)
    # Turn and length packed into one number: every buffer of the aggregate stays a fixed
    # width value, so it hashes instead of sorting.
    turn = F.shiftleft(F.col(turn_col).cast("long"), 32) + F.length(F.coalesce(F.col(content_col), F.lit("")))
    role = F.upper(F.col(role_col))
    lang = F.coalesce(F.lit(None).cast("string") if lang is None else lang, F.lit(C.STATS_DEFAULT_LANG))
    per_turn = df.select(
        F.col(id_col).alias("id"),
        T.fertility_of(lang, C.FERTILITY if fertility is None else fertility).alias("_factor"),
        *[metrics[c].alias(c) for c in SUMS + FLAGS],
        F.when(role == "USER", turn).alias("last_user"),
        F.when(role == "ASSISTANT", turn).alias("last_assistant"),
    )

    def length_of(packed: str) -> Column:
        return F.max(packed).bitwiseAND(0xFFFFFFFF).alias(packed)

    grouped = per_turn.groupBy("id").agg(
        F.max("_factor").alias("_factor"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.max(c).alias(c) for c in FLAGS],
        F.count("*").alias("messages"),
        length_of("last_user"),
        length_of("last_assistant"),
    )
    return _finish(grouped)
