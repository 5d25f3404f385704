import base64
import collections
import os
import re
import string

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_bands as Q


def base_counts(text):
    w = brute.words(text)
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if brute.words(line):
            duplicates += line in seen
            seen.add(line)
    triples = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered)


@pytest.fixture(scope="module")
def texts():
    rng = brute.seeded(1)
    return [
        None, "", " \t\n", "one", "a b c a b c", "x\n\nx\n x\r\nx", "é# 中文 $%|<>& é#", "same line\n" * 80, "In. " * 400,
        brute.prose(rng, 300), "\n".join(brute.prose(rng, 12) for _ in range(60)), brute.prose(rng, 40_000),
        " ".join(os.urandom(30).hex() for _ in range(60)),
    ]


def test_counts_match_plain_counting(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in Q.with_quality(rows).select("doc_id", "quality.*").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_reject_what_repeats_and_what_does_not_compress(spark):
    rng = brute.seeded(2)
    noise = "".join(chr(rng.randrange(33, 127)) + (" " if rng.random() < 0.1 else "") for _ in range(9000))
    mostly = brute.prose(rng, 500) + " " + " ".join(f"filler{i % 40}" for i in range(9000))
    clean = brute.prose(rng, 2000, 30000)
    rows = [(1, clean), (2, noise), (3, mostly), (4, None)]
    got = {r.doc_id: r.quality for r in Q.with_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].reason is None
    assert got[2].reason == "incompressible" and not got[2].kept
    assert not got[3].kept and not got[4].kept and got[4].whole_ratio is None


def test_filter_keeps_columns_whatever_their_names(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"quality": F.lit(1), "_quality": F.lit(2)})
    kept = Q.keep_good(rows)
    assert kept.columns == rows.columns and {r._quality for r in kept.collect()} == {2}
    assert Q.keep_good(rows.limit(0)).count() == 0
    assert Q.keep_good(rows.unionAll(rows)).count() == 2 * kept.count()


def dump(rng, kind, size, group):
    """Encoded random data in groups separated by spaces."""
    if kind == "base64":
        made = base64.b64encode(rng.randbytes(size)).decode()
    elif kind == "hex":
        made = rng.randbytes(size).hex()
    else:
        made = "".join(rng.choices(string.ascii_lowercase if kind == "letters" else string.ascii_letters + string.digits, k=size))
    return " ".join(made[i : i + group] for i in range(0, size, group))[:size]


def test_encoded_data_is_incompressible_at_every_length(spark):
    rng = brute.seeded(3)
    sizes = [600, 1023, 2000, 2047, 4095, 6000, 8191, 16_383, 20_000, 65_535, 100_000]
    rows = [(kind, size, dump(rng, kind, size, 8)) for kind in ("base64", "alphanumeric", "letters", "hex") for size in sizes]
    got = Q.with_quality(spark.createDataFrame(rows, "kind string, size long, text string")).select("kind", "size", "quality.*").collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    # Letters and hex have the ratios of prose in shorter texts.
    least = {"base64": 0, "alphanumeric": 0, "letters": 1 << 14, "hex": 1 << 16}
    assert [(r.kind, r.size, r.whole_ratio) for r in got if r.size >= least[r.kind] and r.reason != "incompressible"] == []
    mixed = brute.prose(rng, 6000, 30_000) + " " + dump(rng, "base64", 40_000, 64)
    assert Q.with_quality(spark.createDataFrame([(mixed,)], "text string")).first().quality.chunk_outside > 0.3
