"""Text measures as built-in column expressions.

Counting a character class is done by deleting everything outside it and taking
the length of what is left: one linear pass, no array of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import LETTER, LINE_BREAK, WHITESPACE


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An outer expression used inside a lambda is otherwise evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_class(text: Column, class_body: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{class_body}]+", ""))


def count_literal(text: Column, literal: str) -> Column:
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / F.lit(len(literal))).cast("long") if len(literal) > 1 else removed


def without_letters(text: Column) -> Column:
    return F.regexp_replace(text, f"[{LETTER}]+", "")


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character from both ends.

    The look-behind starts the tail match once per run, so long inner runs stay linear.
    """
    head = F.regexp_replace(text, rf"\A[{WHITESPACE}]+", "")
    return F.regexp_replace(head, rf"(?<![{WHITESPACE}])[{WHITESPACE}]+\z", "")


def collapse_spaces(text: Column) -> Column:
    """Join the white-space separated tokens by one space."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WHITESPACE}]+"), "")


def drop_empty_tail(parts: Column) -> Column:
    """Lines without the empty tail that follows a final line break."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Number of lines of a non-empty text; a final line break opens no further line."""
    closed = F.when(F.rlike(text, F.lit(rf"(?:{LINE_BREAK})\z")), 1).otherwise(0)
    return F.size(F.split(text, LINE_BREAK)) - closed


def count_where(items: Column, predicate) -> Column:
    return F.size(F.filter(items, predicate))


def token_runs(words: Column) -> Column:
    """``(distinct, clogc)`` of a token array in one fold over its sorted copy.

    ``clogc`` is the sum of ``c * ln(c)`` over the distinct tokens, the only term the
    entropy needs. The closing null flushes the last run.
    """
    closed = F.array_append(F.sort_array(words), F.lit(None).cast("string"))
    start = F.struct(
        F.lit(None).cast("string").alias("prev"),
        F.lit(0).cast("long").alias("run"),
        F.lit(0).cast("long").alias("distinct"),
        F.lit(0.0).alias("clogc"),
    )

    def step(acc: Column, word: Column) -> Column:
        same = acc["prev"].eqNullSafe(word)
        ended = (~same) & (acc["run"] > 0)
        return F.struct(
            word.alias("prev"),
            F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["distinct"] + F.when(ended, 1).otherwise(0)).alias("distinct"),
            (acc["clogc"] + F.when(ended, acc["run"] * F.log(acc["run"].cast("double"))).otherwise(0.0)).alias("clogc"),
        )

    return F.aggregate(closed, start, step, lambda acc: F.struct(acc["distinct"], acc["clogc"]))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def fertility_of(lang: Column, table: dict[str, float], default: str = "un") -> Column:
    pairs = [item for code, value in table.items() for item in (F.lit(code), F.lit(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), F.lit(table[default]))
