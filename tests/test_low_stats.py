import math
import re
from collections import Counter

import pytest

from millrace.functions.low_stats import COUNT_COLUMNS, RATIO_COLUMNS, entropy_by_shuffle, low_level_stats

TEXTS = [
    "",
    "   \n\t ",
    "plain words only",
    "One line.\nTwo! \n\n• bullet one\n | bar start\n- dash\nends here...\nalso…  \n",
    "JavaScript javascript Xjavascript javascript2 (JAVASCRIPT) java_script",
    "digits 12 ² ① ٣ and upper Ⅷ Ⓐ É",
    "a\x1cb\x1dc d\x85e\r\nf\rg",
    "sym # $ % & * + = @ ^ \\ / – - ■\ttab\r",
    "the the A a of it's 42 -- the",
    "emoji \U0001f600\U0001f600 café naïve " + "x" * 10001,
    "quote \" ' ` ~ [a] {b} <c> «» １ ″",
]
BULLETS = "•‣▶◀◦–■□▪▫"


def expected(text, lang):
    """The definitions, one character and one token at a time."""
    if not text:
        return {c: 0 for c in COUNT_COLUMNS + RATIO_COLUMNS}
    words, lines, n = text.split(), text.splitlines(), len(text)
    counts = Counter(words)
    stop = {"en": "the a an and or but in on at to for of with by this is".split()}.get(lang, [])
    upper, digits = sum(c.isupper() for c in text), sum(c.isdigit() for c in text)
    symbols = sum(c in "#$%&*+=@^\\/-" + BULLETS for c in text)
    escapes = sum(c in "\n\t\r" for c in text)
    w = len(words) or None
    out = {
        "_length": n, "_char_count": n, "_lines_count": len(lines),
        "_lines_empty_count": sum(not x.strip() for x in lines),
        "_lines_short_char_20_count": sum(len(x) < 20 for x in lines),
        "_lines_long_char_10000_count": sum(len(x) > 10000 for x in lines),
        "_lines_end_punctuation_count": sum(x.strip()[-1:] in tuple(".!?;:") for x in lines),
        "_lines_bulletpoint_start_count": sum(x.lstrip()[:1] in tuple(BULLETS + "|") for x in lines),
        "_lines_end_ellipsis_count": sum(x.strip().endswith(("...", "…")) for x in lines),
        "_word_count": len(words), "_word_distinct_count": len(counts),
        "_no_alpha_count": sum(not any(c.isalpha() for c in x) for x in words),
        "_javascript_count": len(re.findall(r"\bjavascript\b", text, re.I)),
        "_char_distinct_count": len(set(text)), "_char_uppercase_count": upper, "_char_symbol_count": symbols,
        "_char_escape_count": escapes, "_numerical_char_count": digits,
        "_token_count": len(words) * {"en": 1.384, "xx": 1.5}[lang],
        "_white_space_ratio": sum(c.isspace() for c in text) / n,
        "_non_alpha_digit_ratio": sum(not c.isalpha() and not c.isdigit() for c in text) / n,
        "_digit_ratio": digits / n, "_uppercase_ratio": upper / n,
        "_elipsis_ratio": sum(len(x) for x in re.findall(r"\.\.\.|…", text)) / n,
        "_stop_word_ratio": sum(x.lower() in stop for x in words) / w if w else 0,
        "_unique_word_ratio": len(counts) / w if w else 0, "_symbol_word_ratio": symbols / w if w else 0,
        "_unigram_entropy": -sum(c / w * math.log(c / w) for c in counts.values()) if w else 0,
        "_mean_word_length": sum(map(len, words)) / w if w else 0,
        "_lines_short_char_20_ratio": sum(len(x) < 20 for x in lines) / len(lines),
        "_lines_long_char_10000_ratio": sum(len(x) > 10000 for x in lines) / len(lines),
        "_char_uppercase_ratio": upper / n, "_numerical_char_ratio": digits / n,
        "_char_symbol_ratio": symbols / n, "_char_escape_ratio": escapes / n,
    }
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, x, None if i % 2 else "xx") for i, x in enumerate(TEXTS)]
    out = low_level_stats(spark.createDataFrame(data, "id int, text string, _lang string"))
    return {r.id: r.asDict() for r in out.collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_matches_the_definitions(rows, i):
    want = expected(TEXTS[i], "en" if i % 2 else "xx")
    got = rows[i]
    assert {k: got[k] for k in want if k in COUNT_COLUMNS} == {k: v for k, v in want.items() if k in COUNT_COLUMNS}
    for k in RATIO_COLUMNS:
        if k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_punctuation_counts_the_listed_characters(rows):
    assert rows[10]["_char_punctuation_count"] == sum(c in "\"'`~[]{}<>«»１" for c in TEXTS[10])
    assert rows[6]["_char_punctuation_count"] == 5  # control characters other than tab and line feed


def test_null_text_is_an_empty_record(spark):
    out = low_level_stats(spark.createDataFrame([(1, None, "en")], "id int, text string, _lang string")).first()
    assert all(out[c] == 0 for c in COUNT_COLUMNS + RATIO_COLUMNS)


def test_fold_and_shuffle_agree_on_entropy(spark):
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(TEXTS)], "id int, text string, _lang string")
    shuffled = {r.id: r._unigram_entropy for r in entropy_by_shuffle(df).collect()}
    folded = {r.id: r._unigram_entropy for r in low_level_stats(df).collect()}
    for key, value in shuffled.items():
        assert folded[key] == pytest.approx(value, abs=1e-9)


def test_statistics_do_not_shuffle(spark):
    df = spark.range(10).selectExpr("id", "'some text' as text", "'en' as _lang")
    plan = low_level_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
