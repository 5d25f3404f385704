"""Low-level statistics over whole documents, one registered query per inventory row."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import constants as C
from millrace.functions.low_stats import COUNT_COLUMNS, RATIO_COLUMNS, entropy_by_shuffle, low_level_stats
from millrace.plans.sql_text import quote, sql_class_count, sql_fertility, sql_lines, sql_ratio, sql_tokens
from millrace.session import read_table


def document_stats(spark, sf_dir):
    """Statistics of ``documents`` keyed by ``id`` = doc_id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return low_level_stats(docs, "text", "doc_id", "lang")


def _columns(*names):
    def run(spark, sf_dir):
        stats = document_stats(spark, sf_dir)
        picked = [F.round(n, 6).alias(n) if n in RATIO_COLUMNS else F.col(n) for n in names]
        return stats.select(F.col("id").alias("doc_id"), *picked)

    return run


_LINES = "ln"
_W = "w"


def _line_count(condition: str) -> str:
    return f"len(list_filter(ln, lambda x: {condition}))"


_STOP = " ".join(
    f"WHEN {quote(code)} THEN len(list_filter(w, lambda x: lower(x) IN ({', '.join(quote(x) for x in words)})))"
    for code, words in sorted(C.STOP_WORDS.items())
)
SQL: dict[str, str] = {
    "_length": "n",
    "_char_count": "n",
    "_lines_count": "len(ln)",
    "_lines_empty_count": _line_count(f"NOT regexp_matches(x, {quote('[^' + C.WHITESPACE + ']')})"),
    "_lines_short_char_20_count": _line_count("length(x) < 20"),
    "_lines_long_char_10000_count": _line_count("length(x) > 10000"),
    "_lines_end_punctuation_count": _line_count(f"regexp_matches(x, {quote('[.!?;:][' + C.WHITESPACE + ']*$')})"),
    "_lines_bulletpoint_start_count": _line_count(
        f"regexp_matches(x, {quote('^[' + C.WHITESPACE + ']*[' + C.LINE_BULLET + ']')})"
    ),
    "_lines_end_ellipsis_count": _line_count(
        f"regexp_matches(x, {quote('([.][.][.]|…)[' + C.WHITESPACE + ']*$')})"
    ),
    "_word_count": "len(w)",
    "_word_distinct_count": "len(list_distinct(w))",
    "_no_alpha_count": "len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{L}')))",
    "_javascript_count": (
        f"len(list_filter(regexp_extract_all(t, {quote('[' + C.WORD_CHAR + ']+')}), "
        "lambda x: lower(x) = 'javascript'))"
    ),
    "_char_distinct_count": "len(list_distinct(string_split(t, '')))",
    "_char_uppercase_count": sql_class_count("t", C.UPPER),
    "_char_symbol_count": sql_class_count("t", C.SYMBOL),
    "_char_punctuation_count": sql_class_count("t", C.PUNCTUATION),
    "_char_escape_count": sql_class_count("t", C.ESCAPE),
    "_numerical_char_count": sql_class_count("t", C.DIGIT),
}
_SQL_RATIO = {
    "_token_count": f"len(w) * {sql_fertility('lg')}",
    "_white_space_ratio": sql_ratio(sql_class_count("t", C.WHITESPACE), "n"),
    "_non_alpha_digit_ratio": sql_ratio(
        f"length(regexp_replace(t, {quote('[' + C.LETTER + C.DIGIT + ']')}, '', 'g'))", "n"
    ),
    "_digit_ratio": sql_ratio(SQL["_numerical_char_count"], "n"),
    "_uppercase_ratio": sql_ratio(SQL["_char_uppercase_count"], "n"),
    "_elipsis_ratio": sql_ratio(
        "list_sum(list_transform(regexp_extract_all(t, '[.][.][.]|…'), lambda x: length(x)))", "n"
    ),
    "_punctuation_ratio": sql_ratio(SQL["_char_punctuation_count"], "n"),
    "_stop_word_ratio": sql_ratio(f"(CASE lg {_STOP} ELSE 0 END)", "len(w)"),
    "_unique_word_ratio": sql_ratio("len(list_distinct(w))", "len(w)"),
    "_symbol_word_ratio": sql_ratio(SQL["_char_symbol_count"], "len(w)"),
    "_unigram_entropy": "coalesce(list_aggregate(w, 'entropy') * ln(2), 0.0)",
    "_mean_word_length": sql_ratio("list_sum(list_transform(w, lambda x: length(x)))", "len(w)"),
    "_lines_short_char_20_ratio": sql_ratio(SQL["_lines_short_char_20_count"], "len(ln)"),
    "_lines_long_char_10000_ratio": sql_ratio(SQL["_lines_long_char_10000_count"], "len(ln)"),
    "_char_uppercase_ratio": sql_ratio(SQL["_char_uppercase_count"], "n"),
    "_numerical_char_ratio": sql_ratio(SQL["_numerical_char_count"], "n"),
    "_char_symbol_ratio": sql_ratio(SQL["_char_symbol_count"], "n"),
    "_char_punctuation_ratio": sql_ratio(SQL["_char_punctuation_count"], "n"),
    "_char_escape_ratio": sql_ratio(SQL["_char_escape_count"], "n"),
}

STATS_BASE = (
    "SELECT doc_id, text AS t, coalesce(lang, 'en') AS lg, length(text) AS n, "
    f"{sql_tokens('text')} AS w, {sql_lines('text')} AS ln FROM documents"
)


def sql_column(name: str) -> str:
    if name in SQL:
        return f"CAST({SQL[name]} AS BIGINT) AS {name}"
    return f"round({_SQL_RATIO[name]}, 6) AS {name}"


def sql_raw(name: str) -> str:
    """The expression without rounding, for statements that compute further."""
    return f"CAST({SQL[name]} AS BIGINT)" if name in SQL else _SQL_RATIO[name]


def stats_cte(*names: str) -> str:
    """Body of a CTE ``(id, names…)`` over ``documents``."""
    return f"SELECT doc_id AS id, {', '.join(f'{sql_raw(n)} AS {n}' for n in names)} FROM ({STATS_BASE})"


_ROWS = {
    "l01_length": ["_length", "_char_count"],
    "l02_white_space": ["_white_space_ratio"],
    "l03_non_alpha_digit": ["_non_alpha_digit_ratio"],
    "l04_digits": ["_digit_ratio", "_numerical_char_count", "_numerical_char_ratio"],
    "l05_uppercase": ["_uppercase_ratio", "_char_uppercase_count", "_char_uppercase_ratio"],
    "l06_ellipsis": ["_elipsis_ratio"],
    "l07_punctuation": ["_punctuation_ratio", "_char_punctuation_count", "_char_punctuation_ratio"],
    "l08_lines": ["_lines_count"],
    "l09_lines_empty": ["_lines_empty_count"],
    "l10_lines_short": ["_lines_short_char_20_count", "_lines_short_char_20_ratio"],
    "l11_lines_long": ["_lines_long_char_10000_count", "_lines_long_char_10000_ratio"],
    "l12_lines_end_punctuation": ["_lines_end_punctuation_count"],
    "l13_lines_bullet": ["_lines_bulletpoint_start_count"],
    "l14_lines_end_ellipsis": ["_lines_end_ellipsis_count"],
    "l15_words": ["_word_count"],
    "l16_tokens": ["_token_count"],
    "l17_distinct_words": ["_word_distinct_count", "_unique_word_ratio"],
    "l18_no_alpha": ["_no_alpha_count"],
    "l19_javascript": ["_javascript_count"],
    "l20_distinct_chars": ["_char_distinct_count"],
    "l21_symbols": ["_char_symbol_count", "_char_symbol_ratio", "_symbol_word_ratio"],
    "l22_escapes": ["_char_escape_count", "_char_escape_ratio"],
    "l23_stop_words": ["_stop_word_ratio"],
    "l24_entropy": ["_unigram_entropy"],
    "l25_mean_word_length": ["_mean_word_length"],
    "l_all_low_stats": COUNT_COLUMNS + RATIO_COLUMNS,
}

QUERIES = {name: _columns(*columns) for name, columns in _ROWS.items()}
ORACLES = {
    name: f"SELECT doc_id, {', '.join(sql_column(c) for c in columns)} FROM ({STATS_BASE})"
    for name, columns in _ROWS.items()
}


def _missing_language(spark, sf_dir):
    """Records whose language is missing are counted as English."""
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "lang", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("lang"))
    )
    stats = low_level_stats(docs, "text", "doc_id", "lang")
    return stats.select(F.col("id").alias("doc_id"), F.round("_token_count", 6).alias("_token_count"))


QUERIES["l26_language_default"] = _missing_language
ORACLES["l26_language_default"] = (
    "SELECT doc_id, "
    + sql_column("_token_count")
    + f" FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'en' ELSE lang END AS lg, {sql_tokens('text')} AS w FROM documents)"
)


def _entropy_shuffled(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = entropy_by_shuffle(docs, "text", "doc_id")
    return out.select(F.col("id").alias("doc_id"), F.round("_unigram_entropy", 6).alias("_unigram_entropy"))


QUERIES["l24_entropy_by_shuffle"] = _entropy_shuffled
ORACLES["l24_entropy_by_shuffle"] = (
    f"SELECT doc_id, {sql_column('_unigram_entropy')} FROM ({STATS_BASE}) WHERE len(w) > 0"
)
