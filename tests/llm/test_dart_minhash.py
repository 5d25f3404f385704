import collections

import brute
import numpy as np
from pyspark.sql import functions as F

from millrace.llm import dart_minhash as D


def test_classes_are_the_components_of_all_pairs(spark):
    texts = brute.near_copies(brute.seeded(6))
    group = brute.near_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in D.with_classes(rows).collect()}
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    assert [got[i].class_id for i in range(len(texts))] == [least[g] for g in group]
    assert [got[i].class_size for i in range(len(texts))] == [group.count(g) for g in group]
    kept = D.one_per_class(rows.withColumn("_near", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_near"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_signatures_estimate_weighted_similarity():
    rng = brute.seeded(7)
    a = [rng.randrange(60) for _ in range(300)]
    b = a[:220] + [rng.randrange(60, 90) for _ in range(80)]
    bags = [collections.Counter(x) for x in (a, b)]
    want = brute.jaccard(*bags)
    owner = np.repeat([0, 1], 300)
    h = D.W.mix(np.array(a + b, dtype=np.uint64))
    sign, some = D.signatures(*D.cells(owner, h), 2, 4096)
    assert some.all() and abs((sign[0] == sign[1]).mean() - want) < 0.04


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"t{i}" for i in range(100))
    rows = [(None, long), (7, long), (7, long), (None, "other words"), (None, "other words"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in D.with_classes(df).collect()), key=str)
    assert got == sorted([(None, 7, 3), (7, 7, 3), (7, 7, 3), (None, None, 2), (None, None, 2), (None, None, 1), (3, 3, 1)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in D.one_per_class(df).collect()), key=str)
    assert kept == sorted([(7, long), (None, "other words"), (None, None), (3, None)], key=str)
    assert D.with_classes(df.limit(0)).count() == 0 and D.one_per_class(df.limit(0)).count() == 0


def template_group(rng, singles=60, twins=8):
    """Texts of one template that miss the threshold, and pairs of texts that match only each other.
    The single ones are nearer to the template, so they are the hubs."""
    base = [f"b{i}" for i in range(300)]

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(300), n):
            out[i] = f"x{rng.randrange(10**9)}"
        return out

    texts = [changed(base, 6) for _ in range(singles)]
    for _ in range(twins):
        common = changed(base, 6)
        texts += [changed(common, 3), changed(common, 3)]
    rng.shuffle(texts)
    return [" ".join(x) for x in texts]


def test_members_of_a_large_bucket_that_match_no_hub(spark):
    texts = template_group(brute.seeded(8))
    group = brute.near_groups(texts)
    assert len(set(group)) > 55 and sum(group.count(g) > 1 for g in group) >= 12
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    few = {"bands": 4, "rows": 1, "hubs": 4}
    for settings in (D.Settings(**few), D.Settings(**few, block=7)):
        got = {r.doc_id: r.class_id for r in D.with_classes(rows, settings=settings).collect()}
        assert [got[i] for i in range(len(texts))] == [least[g] for g in group]


def test_many_short_texts_are_signed_a_few_at_a_time():
    column = D.pa.array(["a b", None, "c"] * 1000)
    parts = list(D.W.slices(column, D.SIGNED_BYTES, D.SIGNED_TEXTS))
    assert max(len(bounds) - 1 for _, _, bounds in parts) == D.SIGNED_TEXTS
    assert [row for row, _, _ in parts] == list(range(0, 3000, D.SIGNED_TEXTS))
    assert b"".join(data.tobytes() for _, data, _ in parts) == b"a bc" * 1000
