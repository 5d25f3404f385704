import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import vector_codes as V


def plain(rows, s, width):
    """Codes, errors and codebooks by comparing every part with every entry in Python integers."""
    per = max(1, -(-width // s.parts))
    kept = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, l, [math.floor(s.scale * x) for x in v] + [0] * (per * s.parts - len(v))) for i, l, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[2][p * per : (p + 1) * per] for r in kept[: s.entries]] for p in range(s.parts)]
    cut = [[r[2][p * per : (p + 1) * per] for r in kept] for p in range(s.parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p: [min((off(v, c), e) for e, c in enumerate(books[p])) for v in cut[p]]
    for _ in range(s.rounds):
        for p in range(s.parts):
            group = {}
            for v, (_, e) in zip(cut[p], nearest(p)):
                group.setdefault(e, []).append(v)
            for e, vs in group.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [nearest(p) for p in range(s.parts)]
    codes = [(r[0], r[1], "".join(f"{found[p][k][1]:02x}" for p in range(s.parts)), min(sum(found[p][k][0] for p in range(s.parts)), 2**63 - 1)) for k, r in enumerate(kept)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(codes, key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(n=600, width=16):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    rows = [(i * 3 % 1000, [x + rng.gauss(0, rng.choice([0, 0.01, 0.3])) for x in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(1001, None, "a"), (1002, [1.0, None] * (width // 2), "b"), (1003, [math.nan] * width, "a"), (1004, [math.inf] * width, None)]
    return rows + [(7, [0.5] * width, "a")] * 200 + [(None, [0.25] * width, None)]


def check(spark, rows, s, width):
    df = spark.createDataFrame([(i, v, l, 1, "c") for i, v, l in rows], "vec_id long, embedding array<double>, label string, error int, code string").repartition(4)
    codes, books = V.compress(df, settings=s)
    want, sha = plain(rows, s, width)
    whole = V.with_label_errors(codes).collect()
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in whole), key=str) == want
    assert V.digest(books) == sha
    by_label = {}
    for r in want:
        by_label[r[1]] = by_label.get(r[1], 0) + r[3]
    assert all(r.label_error == by_label[r.label] for r in whole)


@pytest.mark.parametrize("s", [V.Settings(), V.Settings(block_rows=50, leaf_rows=1), V.Settings(parts=3, entries=5, rounds=2, leaf_rows=4), V.Settings(rounds=0)])
def test_matches_brute_force(spark, s):
    check(spark, vectors(), s, 16)


def test_few_short_and_large_vectors(spark):
    check(spark, [(3, [1.0] * 8, "a"), (1, [2.0] * 5, "a"), (2, [], None)], V.Settings(), 8)
    check(spark, [*vectors(100), (0, [3e5] * 16, "b"), (1, [-3e5] * 16, "b"), (50, [2e5] * 16, "c")], V.Settings(leaf_rows=2), 16)


def test_empty_table_and_bad_settings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    codes, books = V.compress(df)
    assert V.with_label_errors(codes).count() == 0 and all(len(b) == 0 for b in books)
    with pytest.raises(ValueError):
        V.compress(df, settings=V.Settings(entries=257))


@pytest.mark.parametrize("leaf", [1, 10])
def test_tree_covers_and_separates(leaf):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-4000, 4000, (500, 4)), rng.integers(-3, 3, (300, 4))])
    tree = V.Tree.build(points, leaf)
    assert sorted(tree.row.tolist()) == list(range(len(points))) and (tree.points == points[tree.row]).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.end[i]]
        assert np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        kids = range(tree.first[i], tree.first[i] + tree.kids[i])
        if kids:
            assert [tree.start[k] for k in kids] == [tree.start[i], *[tree.end[k] for k in kids][:-1]] and tree.end[kids[-1]] == tree.end[i]
            centres = tree.points[[tree.start[k] for k in kids]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + np.eye(len(centres)) * 1e9
            assert apart.min() > tree.radius[i] / 2 and all(tree.radius[k] <= tree.radius[i] / 2 for k in kids)


def test_whole_subtrees_are_assigned_without_comparing_points():
    rng = np.random.default_rng(2)
    centres = rng.uniform(-5000, 5000, (8, 4))
    points = np.concatenate([c + rng.normal(0, 20, (200, 4)) for c in centres]).astype(int)
    tree = V.Tree.build(points, 16)
    tree.points = tree.points.astype(float)
    sure, left = tree.assign(centres.astype(int).astype(float))
    assert len(left) == 0 and sum(e - s for s, e, _ in sure) == len(points) and len(sure) < 40
