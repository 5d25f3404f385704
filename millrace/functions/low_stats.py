"""Per-record low-level statistics: ``id`` and 38 numeric columns in one projection.

Stacked projections share the costly intermediates (letters removed, tokens,
lines, token runs). Catalyst keeps such projections apart because the inner
expressions are not cheap, so each intermediate is computed once per record, and it
drops the intermediates nobody selects. There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import constants as C
from millrace.functions import text as T

# --- Fixed values: the word counted in any case, with the letters that fold to s and i ------
JAVASCRIPT = "[jJ][aA][vV][aA][sSſ][cC][rR][iIıİ][pP][tT]"

COUNT_COLUMNS = [
    "_length", "_lines_count", "_lines_empty_count", "_lines_short_char_20_count",
    "_lines_long_char_10000_count", "_lines_end_punctuation_count", "_lines_bulletpoint_start_count",
    "_lines_end_ellipsis_count", "_word_count", "_word_distinct_count", "_no_alpha_count",
    "_javascript_count", "_char_count", "_char_distinct_count", "_char_uppercase_count",
    "_char_symbol_count", "_char_punctuation_count", "_char_escape_count", "_numerical_char_count",
]
RATIO_COLUMNS = [
    "_token_count", "_white_space_ratio", "_non_alpha_digit_ratio", "_digit_ratio", "_uppercase_ratio",
    "_elipsis_ratio", "_punctuation_ratio", "_stop_word_ratio", "_unique_word_ratio", "_symbol_word_ratio",
    "_unigram_entropy", "_mean_word_length", "_lines_short_char_20_ratio", "_lines_long_char_10000_ratio",
    "_char_uppercase_ratio", "_numerical_char_ratio", "_char_symbol_ratio", "_char_punctuation_ratio",
    "_char_escape_ratio",
]


def _is_one_of(vocabulary: list[str]):
    return lambda word: F.lower(word).isin(vocabulary)


def _stop_word_count(words: Column, lang: Column, stop_words: dict[str, list[str]]) -> Column:
    """Occurrences of the record's own stop words; languages without a list count 0."""
    branches = F.lit(None).cast("int")
    for code in sorted(stop_words):
        hits = T.count_where(words, _is_one_of([w.lower() for w in stop_words[code]]))
        branches = F.when(lang == code, hits).otherwise(branches)
    return F.coalesce(branches, F.lit(0))


def low_level_stats(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "id",
    lang_col: str = "_lang",
    stop_words: dict[str, list[str]] | None = None,
    fertility: dict[str, float] | None = None,
) -> DataFrame:
    stop_words = C.STOP_WORDS if stop_words is None else stop_words
    fertility = C.FERTILITY if fertility is None else fertility
    text, lang = F.col("_text"), F.col("_lg")

    base = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(F.col(lang_col), F.lit(C.STATS_DEFAULT_LANG)).alias("_lg"),
    )
    shared = base.select(
        "id", "_text", "_lg",
        F.length(text).alias("_n"),
        T.without_letters(text).alias("_rest"),
        T.tokens(text).alias("_words"),
        F.split(text, C.LINE_BREAK).alias("_parts"),
    )
    # Letters, spaces and plain digits are nearly all of a text. Once they are gone the
    # remaining classes are counted on a short string.
    rest = F.col("_rest")
    shared = shared.select(
        "*",
        T.drop_empty_tail(F.col("_parts")).alias("_lines"),
        F.regexp_replace(rest, "[ 0-9]+", "").alias("_marks"),
        T.count_literal(rest, " ").alias("_spaces"),
    ).drop("_parts")
    words, line_list, marks = F.col("_words"), F.col("_lines"), F.col("_marks")
    plain_digits = F.length(rest) - F.length(marks) - F.col("_spaces")
    ellipsis_chars = sum(
        (F.length(text) - F.length(F.replace(text, F.lit(e), F.lit(""))) for e in C.ELLIPSES), start=F.lit(0)
    )
    # The letters are searched first; the word borders are looked at only around a hit.
    javascript = F.regexp_count(
        text, F.lit(f"{JAVASCRIPT}(?![{C.WORD_CHAR}])(?<![{C.WORD_CHAR}].{{10}})")
    )

    counted = shared.select(
        "id", "_lg", "_n",
        (F.col("_spaces") + T.count_class(marks, C.WHITESPACE)).alias("_ws"),
        F.length(rest).alias("_nl"),
        (plain_digits + T.count_class(marks, C.DIGIT)).alias("_dg"),
        T.count_class(text, C.UPPER).alias("_up"),
        ellipsis_chars.alias("_el"),
        T.count_class(marks, C.PUNCTUATION).alias("_pu"),
        T.count_class(marks, C.SYMBOL).alias("_sy"),
        T.count_class(marks, C.ESCAPE).alias("_es"),
        F.when(F.col("_n") == 0, 0).otherwise(F.size(line_list)).alias("_lc"),
        T.count_where(line_list, lambda x: ~F.rlike(x, F.lit(f"[^{C.WHITESPACE}]"))).alias("_le"),
        T.count_where(line_list, lambda x: F.length(x) < C.SHORT_LINE_CHARS).alias("_ls"),
        T.count_where(line_list, lambda x: F.length(x) > C.LONG_LINE_CHARS).alias("_ll"),
        T.count_where(
            line_list, lambda x: F.rlike(x, F.lit(rf"[{C.LINE_END_PUNCTUATION}][{C.WHITESPACE}]*\z"))
        ).alias("_lp"),
        T.count_where(
            line_list, lambda x: F.rlike(x, F.lit(rf"\A[{C.WHITESPACE}]*[{C.LINE_BULLET}]"))
        ).alias("_lb"),
        T.count_where(
            line_list, lambda x: F.rlike(x, F.lit(rf"(?:\.\.\.|…)[{C.WHITESPACE}]*\z"))
        ).alias("_lx"),
        F.size(words).alias("_wc"),
        T.token_runs(words).alias("_runs"),
        T.count_where(words, lambda w: ~F.rlike(w, F.lit(f"[{C.LETTER}]"))).alias("_na"),
        javascript.alias("_js"),
        F.size(F.array_distinct(F.split(text, ""))).alias("_cd"),
        _stop_word_count(words, lang, stop_words).alias("_sw"),
    )
    n, wc, lc = F.col("_n"), F.col("_wc"), F.col("_lc")
    empty = n == 0

    def count(expr: Column) -> Column:
        return F.when(empty, F.lit(0)).otherwise(expr).cast("long")

    def ratio(a: Column, b: Column) -> Column:
        return T.safe_ratio(a, b)

    col = F.col
    result: dict[str, Column] = {
        "_length": count(n),
        "_lines_count": count(lc),
        "_lines_empty_count": count(col("_le")),
        "_lines_short_char_20_count": count(col("_ls")),
        "_lines_long_char_10000_count": count(col("_ll")),
        "_lines_end_punctuation_count": count(col("_lp")),
        "_lines_bulletpoint_start_count": count(col("_lb")),
        "_lines_end_ellipsis_count": count(col("_lx")),
        "_word_count": count(wc),
        "_word_distinct_count": count(col("_runs.distinct")),
        "_no_alpha_count": count(col("_na")),
        "_javascript_count": count(col("_js")),
        "_char_count": count(n),
        "_char_distinct_count": count(col("_cd")),
        "_char_uppercase_count": count(col("_up")),
        "_char_symbol_count": count(col("_sy")),
        "_char_punctuation_count": count(col("_pu")),
        "_char_escape_count": count(col("_es")),
        "_numerical_char_count": count(col("_dg")),
        "_token_count": wc * T.fertility_of(lang, fertility),
        "_white_space_ratio": ratio(col("_ws"), n),
        "_non_alpha_digit_ratio": ratio(col("_nl") - col("_dg"), n),
        "_digit_ratio": ratio(col("_dg"), n),
        "_uppercase_ratio": ratio(col("_up"), n),
        "_elipsis_ratio": ratio(col("_el"), n),
        "_punctuation_ratio": ratio(col("_pu"), n),
        "_stop_word_ratio": ratio(col("_sw"), wc),
        "_unique_word_ratio": ratio(col("_runs.distinct"), wc),
        "_symbol_word_ratio": ratio(col("_sy"), wc),
        "_unigram_entropy": F.when(wc > 0, F.log(wc.cast("double")) - col("_runs.clogc") / wc).otherwise(0.0),
        # Tokens are exactly the characters that are not white space.
        "_mean_word_length": ratio(n - col("_ws"), wc),
        "_lines_short_char_20_ratio": ratio(col("_ls"), lc),
        "_lines_long_char_10000_ratio": ratio(col("_ll"), lc),
        "_char_uppercase_ratio": ratio(col("_up"), n),
        "_numerical_char_ratio": ratio(col("_dg"), n),
        "_char_symbol_ratio": ratio(col("_sy"), n),
        "_char_punctuation_ratio": ratio(col("_pu"), n),
        "_char_escape_ratio": ratio(col("_es"), n),
    }
    return counted.select("id", *[result[c].alias(c) for c in COUNT_COLUMNS + RATIO_COLUMNS])


def entropy_by_shuffle(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """The same entropy from exploded tokens; kept as a cross-check of the in-row fold."""
    exploded = df.select(F.col(id_col).alias("id"), F.explode(T.tokens(F.col(text_col))).alias("w"))
    per_word = exploded.groupBy("id", "w").agg(F.count("*").cast("double").alias("c"))
    per_id = per_word.groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return per_id.select("id", (F.log("n") - F.col("s") / F.col("n")).alias("_unigram_entropy"))
