import collections

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pivotal_mix as P


def corpus(seed):
    rng = brute.seeded(seed)
    rows = [(rng.choice([None, *range(300)]), "w " * rng.choice([0, 1, 5, 50, 400]) or None, rng.choice([None, "a", "é", "z", "b"])) for _ in range(500)]
    return rows + [(1, "same text here", "a")] * 60


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_sources_meet_their_targets(spark, block_rows):
    rows = corpus(block_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "_mix": F.lit(2)})
    sizes, largest = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
        largest[s] = max(largest[s], len(brute.words(t)))
    want = brute.targets(dict(sizes))
    plan = P.mix(df, block_rows=block_rows).collect()
    assert len(plan) == len(rows)
    taken = collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        rate = want[r.source] / sizes[r.source]
        assert r["size"] == 0 or int(rate) <= r.copies <= int(rate) + 1
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, P.mix(df.repartition(7), block_rows=block_rows).collect())) == sorted(map(str, plan))
    out = P.mixed(df, block_rows=block_rows)
    assert out.columns == df.columns
    counts = collections.Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert set(counts) <= set(rows)
    assert sum(counts.values()) == sum(r.copies for r in plan)


def test_exchange_keeps_words_and_expectations():
    rng = np.random.default_rng(9)
    size = np.sort(rng.integers(2, 60, 150))[::-1].astype(float)
    start = rng.uniform(0.05, 0.95, 150)
    mean, trials = np.zeros(len(size)), 1500
    for _ in range(trials):
        p = start.copy()
        left = P.exchange(p, size, rng.random(len(p)))
        assert abs((p * size).sum() - (start * size).sum()) <= 4 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        mean += p / trials
    # The smallest rows make up for the others and may be off.
    assert abs(mean - start)[:120].max() < 0.06


@pytest.mark.parametrize("block_rows", [32, 4096])
def test_sources_come_near_their_targets_whatever_their_largest_row(spark, block_rows):
    """One row holds a quarter of its source: it is made up for by the others."""
    rng = brute.seeded(2)
    rows = [(s * 1000 + i, "w " * rng.randrange(1, 60), f"s{s}") for s in range(6) for i in range(400)]
    rows += [(s * 1000 + 999, "w " * 4000, f"s{s}") for s in range(6)]
    plan = P.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=block_rows).collect()
    taken, target = collections.Counter(), {r.source: r.target for r in plan}
    for r in plan:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(6, target[s] / 100) for s in target)


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert P.mix(spark.createDataFrame([], schema)).count() == 0 and P.mixed(spark.createDataFrame([], schema)).count() == 0
    row = P.mix(spark.createDataFrame([(1, None, "a")], schema)).first()
    assert (row["size"], row.target, row.taken) == (0, 0.0, 0)
