import hashlib

import pytest

from millrace.llm import exact_dedup as X

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(i, f"Text {i % 7} É") for i in range(200)] + [(300 + i, "HOT") for i in range(150)] + [(500, "hot"), (501, "É"), (502, "é"), (503, "İ"), (504, "i̇"), (505, "K"), (506, "k")]
ROWS += [(600, None), (601, ""), (602, " "), (None, "hot"), (None, "alone"), (None, "alone"), (700, "twice"), (700, "twice"), (701, "x" * 300_000), (702, "X" * 300_000)]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        first = ids.index(best)
        out += [(i, best, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "d", 1, k, "s") for k, (i, t) in enumerate(rows)], "doc_id long, text string, digest string, number int, kept int, `a.b` string").repartition(parts)


@pytest.mark.parametrize("settings", [X.Settings(), X.Settings(salts=2), X.Settings(digest_chars=1), X.Settings(digest_chars=0)])
def test_matches_brute_force_also_when_digests_clash(spark, settings):
    """With no digest characters all texts clash, so only their content tells them apart."""
    assert sorted(map(tuple, X.decisions(frame(spark, ROWS), settings=settings).collect()), key=str) == plain(ROWS)


def test_kept_rows_keep_their_columns_and_no_text_twice(spark):
    df = frame(spark, ROWS)
    kept = X.deduplicated(df, settings=X.Settings(digest_chars=1))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({(t or "").translate(UP) for _, t in ROWS}) == len({(r.text or "").translate(UP) for r in rows})
    assert set(rows) <= set(df.collect())


def test_empty_table(spark):
    assert X.decisions(frame(spark, ROWS).limit(0)).count() == 0
    assert X.deduplicated(frame(spark, ROWS).limit(0)).count() == 0


def test_hot_text_sends_one_row_per_task_and_no_python(spark):
    rows = X.normalised(spark.range(40_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Same', CAST(id AS STRING)) AS text").repartition(8), "doc_id", "text", X.F.lit(0), X.Settings())
    plan = X.combined(rows, X.Settings())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" not in plan
    # The partial aggregate lies below the exchange on the salt.
    assert plan.index("hashpartitioning(salt") < plan.rindex("partial_max(doc_id")
