import math

import brute
import pytest

from millrace.llm import kd_search as K

LIMIT = 2**63 - 1


def plain(rows, every=50, k=5):
    sound = [(i, [max(min(math.floor(x * 256), LIMIT), -LIMIT - 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        scored = [(-max(min(sum(a * b for a, b in zip(v, w)), LIMIT), -LIMIT), j) for v in {tuple(v) for i, v in sound if i == q} for j, w in sound if j != q]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def vectors():
    rng = brute.seeded(11)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 0.0, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(None, [1.0] * 6), (700, None), (750, [1.0, None, 0.0]), (800, [math.nan] * 6), (850, [math.inf] * 6), (900, []), (901, [9.0])]
    return rows + [(5, rows[5][1])] * 7 + [(i, [1.0] * 6) for i in range(1000, 1100)]


@pytest.mark.parametrize("settings", [K.Settings(), K.Settings(shard_rows=64, leaf_rows=4, query_rows=3)])
@pytest.mark.parametrize("extra", [[], [(2000, [1e12] * 6), (2001, [-1e15] * 6), (2002, [1e30] * 6)]])
def test_matches_brute_force(spark, settings, extra):
    df = spark.createDataFrame(vectors() + extra, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, K.top_k(df, settings=settings).collect())) == plain(rows)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert K.top_k(spark.createDataFrame([], schema)).count() == 0
    few = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert sorted(map(tuple, K.top_k(spark.createDataFrame(few, schema)).collect())) == plain(few)
