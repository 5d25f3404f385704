import hashlib
import math
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import importance_resampling as I

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").translate(UP))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    source, wanted = [0] * s.buckets, [0] * s.buckets
    for counts, texts in ((source, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            for f in grams(t)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1.0) * (sum(source) + s.buckets) / ((c + 1.0) * (sum(wanted) + s.buckets)))) for c, t in zip(source, wanted)]
    rows = []
    for i, t in docs:
        w, f = grams(t)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= s.min_words and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: s.percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def documents():
    rng = brute.seeded(3)
    texts = [brute.prose(rng, rng.choice([5, 19, 20, 40, 300])) for _ in range(150)]
    texts += ["Straße ÄÖ äö Été " * 30, "a" * 70 + " b " + "c" * 100 + " d" * 30, "--  --", "", None, "x", "X.y;Z\n", "\x00a\x7fb" * 40, "long " * 60_000]
    return [*enumerate(texts), (None, brute.prose(rng, 50))]


@pytest.mark.parametrize("slice_bytes", [I.SLICE_BYTES, 200])
@pytest.mark.parametrize("settings", [I.Settings(), I.Settings(buckets=7, percent=60, min_words=1, seed=1)])
def test_matches_brute_force(spark, settings, slice_bytes, monkeypatch):
    monkeypatch.setattr(I, "SLICE_BYTES", slice_bytes)
    docs, target = documents(), [brute.prose(brute.seeded(5), 200, 100), None, "", "w1 w2"]
    df = spark.createDataFrame([(i, t, "r", 2) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    found = I.draw(df, spark.createDataFrame([(t,) for t in target], "text string"), settings=settings)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, target, settings)


def test_features_of_slices(spark):
    texts = pa.array([t for _, t in documents()] * 3)
    whole = [I.features(x, 1000) for x in I.text_slices(texts)]
    small = [I.features(x, 1000) for x in I.text_slices(texts, 100)]
    gain = pa.array(np.arange(1000))
    assert np.concatenate([f.sums(gain) for f in whole]).tolist() == np.concatenate([f.sums(gain) for f in small]).tolist()


def test_ranks_of_many_rows_and_repeated_ones(spark):
    """Ranges are dealt over tasks; a repeated row fills no range and every rank is given once."""
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 0, id) AS doc_id", "30L AS n_words", "59L AS n_features", "0L AS weight", "IF(id % 3 = 0, 5, id % 11) AS score")
    found = I.ranked(rows, 25, 20).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001))
    assert [(-r.score, r.doc_id) for r in found] == sorted((-r.score, r.doc_id) for r in found)
    # 5 ids' scores above 5 come first, then the repeated row.
    assert sum(r.doc_id == 0 for r in found) == 0 or max(r.score for r in found if r.doc_id == 0) == 5


def test_empty_tables_and_drawn_rows(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string").selectExpr("*", "'k' AS `a.b`", "1 AS weight")
    none = spark.createDataFrame([], "text string")
    assert I.draw(df.limit(0), none).count() == 0
    drawn = I.draw(df, none).filter("rank IS NOT NULL")
    kept = I.resampled(df, none)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in drawn.collect())
