"""Normalisation of codes, names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import WHITESPACE
from millrace.functions import text as T


def vocabulary_code(raw: Column) -> Column:
    """Lower-case code of letters, digits and underscores; null when nothing is left."""
    joined = F.regexp_replace(F.lower(T.strip(raw)), f"[-{WHITESPACE}]+", "_")
    return F.nullif(F.regexp_replace(joined, "[^a-z0-9_]", ""), F.lit(""))


def match_code(raw: Column) -> Column:
    """The stricter form used for matching: letters and single underscores only."""
    joined = F.regexp_replace(F.lower(T.strip(raw)), rf"[{WHITESPACE}\-/]+", "_")
    letters = F.regexp_replace(F.regexp_replace(joined, "[^a-z_]", ""), "_+", "_")
    return F.nullif(F.trim(letters, F.lit("_")), F.lit(""))


def entity_name(raw: Column) -> Column:
    """Lower-case name, gaps as double underscores, edges cleaned."""
    joined = F.regexp_replace(F.lower(T.strip(raw)), f"[{WHITESPACE}]+", "__")
    kept = F.regexp_replace(joined, r"[^a-z0-9_\-.]", "")
    return F.trim(F.trim(F.trim(kept, F.lit("_")), F.lit("-")), F.lit("."))


def next_version(version: Column) -> Column:
    """Patch level plus one; a missing or malformed version starts at 1.0.0."""
    parts = F.split(version, r"\.")

    def part(i: int, default: int) -> Column:
        text = F.get(parts, F.lit(i))
        return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text.try_cast("int"))

    major, minor, patch = part(0, 1), part(1, 0), part(2, 0)
    bumped = F.concat_ws(".", major, minor, (patch + 1))
    sound = F.rlike(F.get(parts, F.lit(0)), F.lit(r"\A[0-9]+\z")) & minor.isNotNull() & patch.isNotNull() & major.isNotNull()
    return F.when(sound, bumped).otherwise("1.0.0")


def compact_sql(query: Column) -> Column:
    return T.collapse_spaces(query)
