"""Functions callable from a mapping rule, as column expressions.

Text arguments may be null; a null text gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import WHITESPACE
from millrace.functions import text as T


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def set_fixed_value(value) -> Column:
    return as_column(value)


def concat(*values) -> Column:
    """Non-empty values joined by one space."""
    return F.concat_ws(" ", *[F.nullif(as_column(v).cast("string"), F.lit("")) for v in values])


def map_enum(value: Column, table: dict) -> Column:
    """The table's entry for the value; null when there is none."""
    pairs = [item for key, target in table.items() for item in (F.lit(key), F.lit(target))]
    return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")


def remove_strings(text: Column, strings: list[str]) -> Column:
    if not strings:
        return text
    out = text
    for piece in strings:
        out = F.replace(out, F.lit(piece), F.lit(""))
    return F.when(text == "", text).otherwise(T.collapse_spaces(out))


def remove_regex_strings(text: Column, patterns: list[str]) -> Column:
    """Delete every match, ignoring case and letting the dot match line breaks."""
    if not patterns:
        return text
    out = text
    for pattern in patterns:
        out = F.regexp_replace(out, f"(?isu){pattern}", "")
    return F.when(text == "", text).otherwise(T.collapse_spaces(out))


def remove_prefix(prefix: str, text: Column) -> Column:
    """Text behind the first occurrence of the prefix, wherever that is."""
    at = F.instr(text, prefix)
    rest = F.substr(text, at + F.lit(len(prefix)))
    return F.when(at > 0, F.regexp_replace(rest, rf"\A[{WHITESPACE}]+", "")).otherwise(text)


def _tag_borders(tag: str) -> tuple[str, str]:
    name = re.escape(tag)
    gap = f"[{WHITESPACE}]*"
    return f"<{gap}{name}{gap}>", f"</{gap}{name}{gap}>"


def extract_tag_content(tag: str, text: Column) -> Column:
    """Trimmed content of the first such tag in square brackets; null without one."""
    opening, closing = _tag_borders(tag)
    pattern = f"(?isu){opening}(.*?){closing}"
    content = T.strip(F.regexp_extract(text, pattern, 1))
    return F.when(F.rlike(text, F.lit(pattern)), F.concat(F.lit("["), content, F.lit("]")))


def remove_tag_content(tag: str, text: Column) -> Column:
    """Remove the tag with its content until none is left, so nesting is handled.

    Every pass deletes at least one closing tag, so the number of closing tags bounds
    the passes; once a pass changes nothing the text is no longer looked at.
    """
    opening, closing = _tag_borders(tag)
    pattern = f"(?isu){opening}.*?{closing}"
    passes = F.regexp_count(text, F.lit(f"(?iu){closing}"))

    def one_pass(state: Column, _: Column) -> Column:
        def compared(less: Column) -> Column:
            return F.struct(less.alias("text"), (less == state["text"]).alias("done"))

        return F.when(state["done"], state).otherwise(T.let(F.regexp_replace(state["text"], pattern, " "), compared))

    start = F.struct(text.alias("text"), F.lit(False).alias("done"))
    return T.collapse_spaces(F.aggregate(F.sequence(F.lit(1), passes + 1), start, one_pass, lambda state: state["text"]))


def arc_simple_chat(question, choices: Column) -> Column:
    """Question followed by up to four lettered choices; a list of question parts is joined."""
    lettered = [
        F.when(F.size(choices) > i, F.concat(F.lit(f"\n{letter}: "), F.coalesce(F.get(choices, i).cast("string"), F.lit("None"))))
        for i, letter in enumerate("ABCD")
    ]
    return F.concat_ws("", question, *lettered)


# Name in a rule -> builder.
FUNCTIONS = {
    "set_fixed_value": set_fixed_value,
    "concat": concat,
    "map_enum": map_enum,
    "remove_strings": remove_strings,
    "remove_regex_strings": remove_regex_strings,
    "remove_prefix": remove_prefix,
    "extract_tag_content": extract_tag_content,
    "remove_tag_content": remove_tag_content,
    "ARC_simple_chat": arc_simple_chat,
}
ELEMENTWISE = {"map_enum"}
WHOLE_LIST = {"ARC_simple_chat", "set_fixed_value"}
