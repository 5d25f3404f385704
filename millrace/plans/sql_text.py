"""SQL text fragments shared by the oracle statements."""

from __future__ import annotations

from millrace import constants as C


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_class_count(column: str, body: str) -> str:
    return f"length(regexp_replace({column}, {quote('[^' + body + ']')}, '', 'g'))"


def sql_tokens(column: str) -> str:
    return f"list_filter(string_split_regex({column}, {quote('[' + C.WHITESPACE + ']+')}), lambda x: x <> '')"


def sql_lines(column: str) -> str:
    parts = f"string_split_regex({column}, {quote(C.LINE_BREAK)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, {quote('^[' + C.WHITESPACE + ']+|[' + C.WHITESPACE + ']+$')}, '', 'g')"


def sql_collapse(column: str) -> str:
    return f"array_to_string({sql_tokens(column)}, ' ')"


def sql_ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def sql_fertility(lang: str) -> str:
    branches = " ".join(f"WHEN {quote(k)} THEN CAST({v} AS DOUBLE)" for k, v in sorted(C.FERTILITY.items()))
    return f"(CASE {lang} {branches} ELSE CAST({C.FERTILITY['un']} AS DOUBLE) END)"
