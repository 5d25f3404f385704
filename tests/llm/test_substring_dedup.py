import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup as S


def passages(seed, vocabulary):
    rng = brute.seeded(seed)

    def run(n):
        return " ".join(rng.choice("abcdefghijklmnop"[:vocabulary]) for _ in range(n))

    shared = [run(rng.randrange(8, 60)) for _ in range(6)]
    rows = []
    for _ in range(50):
        parts = [rng.choice([run(rng.randrange(30)), rng.choice(shared)]) for _ in range(rng.randrange(12))]
        rows.append((rng.choice([None, *range(40)]), rng.choice([None, "", " \n".join(parts), " \n".join(parts), "x y " * rng.randrange(60)])))
    return rows + rows[:5]


@pytest.mark.parametrize(("length", "seed_words", "vocabulary"), [(35, 10, 9), (12, 4, 4)])
def test_removed_words_match_plain_counting(spark, length, seed_words, vocabulary):
    rows = passages(length, vocabulary)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.removal([t for _, t in rows], length)
    got = S.removal_digest(df, length=length, seed=seed_words)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    plain = [(d, len(brute.words(t)), len(brute.words(t)) - len(k), brute.sha(k)) for (d, t), k in zip(rows, want)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain, key=str)
    cut = S.without_repeats(df, length=length, seed=seed_words).collect()
    assert sorted(((r.doc_id, brute.words(r.text)) for r in cut), key=str) == sorted(((d, k) for (d, _), k in zip(rows, want)), key=str)


def test_unrepeated_texts_stay_as_they_are(spark):
    rng = brute.seeded(4)
    texts = [f" {brute.prose(rng, 300, 10**6)}\t\n", None, "", "short\n\n text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"k1": F.lit(1), "_removed": F.lit(2), "n_words": F.lit(3)})
    out = S.without_repeats(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == dict(enumerate(texts))
    assert S.removal_digest(df).columns == ["doc_id", "k1", "_removed", "n_words", "n_removed", "kept_sha256"]
    assert S.removal_digest(df.limit(0)).count() == 0


def test_a_passage_in_a_third_of_all_rows(spark):
    rng = brute.seeded(5)
    hot = brute.prose(rng, 60, 10**6)
    rows = [(i, f"{brute.prose(rng, 40, 10**6)} {hot if i % 3 == 0 else ''} {brute.prose(rng, 40, 10**6)}") for i in range(600)]
    got = S.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed == (60 if r.doc_id % 3 == 0 else 0) for r in got)
