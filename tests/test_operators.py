import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.language import choose_language, detect
from millrace.functions.naming import next_version
from millrace.operators import catalog as K
from millrace.operators import dedup as D
from millrace.operators import lineage as L
from millrace.operators import relate as R
from millrace.operators.profile import column_profile, histogram
from millrace.operators.recipe import training_table
from millrace.operators.sampling import hash_sample
from millrace.operators.standardize import truncate_and_flatten
from millrace.session import broadcast_if_small


def test_percentiles_are_exact_beyond_the_sketch(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20000) ** 3, np.full(15000, 2.5), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "x double, y double").repartition(6)
    rows = {r["column"]: r for r in column_profile(df, ["x", "y"]).collect()}
    assert rows["x"]["count"] == len(values)
    for name, data in (("x", values), ("y", np.arange(len(values), dtype=float))):
        for key, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
            assert rows[name][key] == pytest.approx(np.quantile(data, q), rel=1e-12), (name, key)
    assert rows["y"]["std"] == pytest.approx(np.std(np.arange(len(values)), ddof=1))


def test_histogram_counts_everything(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as x", "7D as same")
    rows = histogram(df, ["x", "same"]).collect()
    assert sum(r["rows"] for r in rows if r["column"] == "x") == 1001
    assert [(r["bin"], r["rows"]) for r in rows if r["column"] == "same"] == [(1, 1001)]
    assert max(r["bin"] for r in rows) == 50


def test_hash_sample_is_stable_and_nested(spark):
    df = spark.range(2000)
    small = {r.id for r in hash_sample(df, "id", 0.2, 3).collect()}
    assert small == {r.id for r in hash_sample(df.repartition(7), "id", 0.2, 3).collect()}
    assert small < {r.id for r in hash_sample(df, "id", 0.5, 3).collect()}
    assert small != {r.id for r in hash_sample(df, "id", 0.2, 4).collect()}
    assert 300 < len(small) < 500


def test_training_table_repeats_and_samples(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("k"))
    mix = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "k string, replica double")
    out = training_table(rows, mix, ["k"], "id")
    counts = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    assert counts["a"] == 1400 and 110 < counts["b"] < 190


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent) if find(x) != x}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(i + 1, i) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    links = [(max(a, b), min(a, b)) for a, b in links if a != b]
    got = {r.node: r.root for r in D.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(links)


def plain_signature(items):
    codes = [int.from_bytes(hashlib.sha1(x.encode()).digest()[:4], "little") for x in items if x is not None]
    return [min([(a * c + b) % 2**64 % (2**61 - 1) & 0xFFFFFFFF for c in codes], default=0xFFFFFFFF) for a, b in D.hash_family(128)]


def test_minhash_in_columns_equals_whole_integers_and_estimates_jaccard(spark):
    base = [f"w{i}" for i in range(400)]
    sets = [base, base[:300] + [f"v{i}" for i in range(100)], base[:100] + [f"u{i}" for i in range(300)], [], None, [""], ["é" * 5000, None, "a"]]
    df = spark.createDataFrame([(i % 6, s, "x") for i, s in enumerate(sets)], "id int, items array<string>, signature string").repartition(3)
    out = D.minhash(df, F.col("items"), ["id"])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.id, r.signature) for r in out.collect())
    assert rows == sorted((i % 6, plain_signature(s or [])) for i, s in enumerate(sets))
    signed = {i: np.array(s) for i, s in enumerate(map(plain_signature, sets[:3]))}
    for i, j in itertools.combinations(range(3), 2):
        exact = len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
        assert abs((signed[i] == signed[j]).mean() - exact) < 3 / 128**0.5


def test_minhash_takes_no_method_of_all_slots_over_the_items(spark):
    """The aggregate that meets every item has few minima (F13); any number of hashes gives the same slots."""
    sets = [["a", "b c", "é", None], [], None, ["x"] * 3]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, items array<string>")
    for count in (5, D.PART_SLOTS, 100, 128, 130):
        out = D.minhash(df, F.col("items"), ["id"], count)
        family = D.hash_family(count)
        codes = [[int.from_bytes(hashlib.sha1(x.encode()).digest()[:4], "little") for x in s or [] if x is not None] for s in sets]
        want = {i: [min([(a * c + b) % 2**64 % (2**61 - 1) & 0xFFFFFFFF for c in cs], default=0xFFFFFFFF) for a, b in family] for i, cs in enumerate(codes)}
        assert {r.id: r.signature for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("min(") <= D.PART_SLOTS for line in plan.splitlines() if "_missing" in line)


def test_links_are_verified_and_second_leaders_found(spark):
    """One band for all: two groups of like records and loners meet in it, only like ones are linked."""
    rng = random.Random(8)
    kinds = [[rng.randrange(2**32) for _ in range(120)] for _ in range(2)]
    rows = [(i, [7] * 8 + kinds[i % 2]) for i in range(0, 400)] + [(i, [7] * 8 + [rng.randrange(2**32) for _ in range(120)]) for i in range(400, 430)]
    links = {(r.a, r.b) for r in D.verified_links(spark.createDataFrame(rows, "id long, signature array<long>"), "id", 0.8).collect()}
    assert links and all(a % 2 == b % 2 and a < 400 for a, b in links)
    assert len(brute_components([tuple(x) for x in links])) == 398
    assert D.verified_links(spark.createDataFrame([], "id long, signature array<long>"), "id", 0.8).count() == 0


def brute_links(rows, threshold):
    """All pairs that share one of the 16 bands and reach the threshold."""
    return [
        (max(a, b), min(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2)
        if any(x[k : k + 8] == y[k : k + 8] for k in range(0, 128, 8)) and sum(map(int.__eq__, x, y)) / 128 >= threshold
    ]


def test_records_that_reached_a_leader_are_linked_to_others_too(spark):
    """0 and 1 are alike, 1 and 2 are, 0 and 2 are not; they share the first band only (F1)."""
    rows, signature = [], list(range(1, 129))
    for step in range(3):
        rows.append((step, list(signature)))
        for place in [*range(8 + 2 * step, 128, 8), *range(9 + 2 * step, 48, 8)]:
            signature[place] += 1000
    assert brute_links(rows, 0.8) == [(1, 0), (2, 1)]
    for more in ([], [(None, rows[0][1]), rows[1]]):
        df = spark.createDataFrame(rows + more, "id long, signature array<long>")
        assert {(r.a, r.b) for r in D.verified_links(df, "id", 0.8).collect()} == {(1, 0), (2, 1)}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_join_all_pairs_that_reach_the_threshold(spark, block, monkeypatch):
    """Chains of edits that share a first band: whole components whatever the size of a block (F1)."""
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for _ in range(6):
        walk = [[7] * 8 + [rng.randrange(2**32) for _ in range(120)]]
        for _ in range(12):
            # A step, from any earlier one, changes up to a quarter of the slots.
            walk.append([x if i < 8 or rng.random() > 0.2 else rng.randrange(2**32) for i, x in enumerate(rng.choice(walk))])
        rows += walk
    rows += [[7] * 8 + [5] * 120 for _ in range(9)]
    rng.shuffle(rows)
    rows = [(f"d{i}", x) for i, x in enumerate(rows)]
    all_links = brute_links(rows, 0.8)
    links = {(r.a, r.b) for r in D.verified_links(spark.createDataFrame(rows, "id string, signature array<long>"), "id", 0.8).collect()}
    assert links <= set(all_links) and brute_components(links) == brute_components(all_links)
    assert len(brute_components(all_links)) > 40


def test_near_duplicates_find_edited_copies(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(900)]
    texts = [" ".join(rng.choices(words, k=250)) for _ in range(12)]
    rows = list(enumerate(texts))
    rows += [(100 + i, t + " tail") for i, t in enumerate(texts[:4])]
    rows += [(200 + i, texts[5]) for i in range(30)] + [(300, texts[6])]
    found = {r.id: r.cluster for r in D.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "t", "id").collect()}
    want = {0: 0, 1: 1, 2: 2, 3: 3, 100: 0, 101: 1, 102: 2, 103: 3, 5: 5, 6: 6, 300: 6, **{200 + i: 5 for i in range(30)}}
    assert found == want


def test_breadth_first_depths_equal_path_depths(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
    df = spark.createDataFrame([("N", str(a), "e", "N", str(b)) for a, b in edges], "source_type string, source_id string, edge_type string, target_type string, target_id string")
    start = spark.createDataFrame([("N", str(min(edges)[0]))], "node_type string, node_id string")
    paths = {r.node_id: r.depth for r in L.min_depth(L.traverse(df, start, 4)).collect()}
    reached = {r.node_id: r.depth for r in L.reach(df, start, 4).collect() if r.depth}
    assert paths == reached


def test_containment_join_equals_nested_loop(spark):
    left, right = ["abcab", "xyz", "b", ""], ["ab", "b", "abcab", "zz", ""]
    a = spark.createDataFrame([(x,) for x in left], "l string")
    b = spark.createDataFrame([(x,) for x in right], "r string")
    got = sorted((r.l, r.r or "-") for r in R.containment_join(a, "l", b, "r").collect())
    want = [(x, y) for x in left for y in right if y and y in x] + [(x, "-") for x in left if not any(y and y in x for y in right)]
    assert got == sorted(want)


def test_fuzzy_match_against_brute_force(spark):
    from difflib import SequenceMatcher

    vocabulary = ["text_generation", "code", "math_reasoning", "question_answering", "translation", "chat"]
    raw = ["Text  Generation", "maths-reasoning", "translatoin", "zzz", "!!!", "question/answer", "c", "codes"]
    out = K.match_vocabulary(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw", spark.createDataFrame([(x,) for x in vocabulary], "code string"))
    for r in out.collect():
        if r.code is None:
            assert r.reason == "failed_normalization" and r.raw == "!!!"
            continue
        best = max(vocabulary, key=lambda v: (SequenceMatcher(None, r.code, v).ratio(), [-ord(c) for c in v]))
        score = SequenceMatcher(None, r.code, best).ratio()
        assert r.matched == (best if score >= K.MATCH_THRESHOLD else None), r
        assert r.reason == ("exact_match" if score == 1 else "similar_match" if score >= K.MATCH_THRESHOLD else "no_match")


def test_upsert_takes_nulls_and_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, K.upsert(old, new, "id").collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_versions(spark):
    cases = {"1.0": "1.0.1", "2.3.9": "2.3.10", "7": "7.0.1", None: "1.0.0", "x.1": "1.0.0", "1.b.2": "1.0.0", "1.2.3.4": "1.2.4", "": "1.0.0"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", next_version(F.col("v")).alias("n")).collect()} == cases


def test_bumped_versions_touch_only_the_named_rows(spark):
    df = spark.createDataFrame([(1, "1.0"), (2, "1.0")], "id int, version string")
    out = K.bump_versions(df, spark.createDataFrame([(2,)], "id int"))
    assert sorted(map(tuple, out.collect())) == [(1, "1.0"), (2, "1.0.1")]


def test_flatten_lets_the_later_name_win(spark):
    df = spark.sql("select named_struct('a', 'inner', 'b', named_struct('c', 'deep')) as s, 'outer' as a, array(named_struct('q', 'longer')) as l")
    row = truncate_and_flatten(df, 4).first()
    assert row.asDict(True) == {"c": "deep", "a": "oute", "l": [{"q": "long"}]}


def test_language_detection_and_rules(spark):
    df = spark.createDataFrame([("the cat and the dog is in the house",), ("le chat et le chien dans la rue est un",), ("",)], "t string")
    rows = df.select(detect(F.col("t")).alias("d"), choose_language(F.col("t"), ["de", "fr"]).alias("c"), choose_language(F.col("t"), []).alias("n")).collect()
    assert [r.d for r in rows] == ["en", "fr", None] and [r.c for r in rows] == ["de", "fr", "de"] and {r.n for r in rows} == {"un"}


def test_broadcast_hint_depends_on_size(spark):
    small = broadcast_if_small(spark.range(10))
    large = broadcast_if_small(spark.range(10**9), limit=1000)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "hint" in plan(small).lower() and "hint" not in plan(large).lower()


def test_files_in_folders_below_a_distribution_count(spark):
    from millrace.operators import catalog as K

    distributions = spark.createDataFrame([(i, f"/d/{i}", True) for i in range(4)], "id int, uri string, materialized boolean")
    listing = spark.createDataFrame([("/d/0/a.jsonl",), ("/d/1/lang=en/subpath=x/b.jsonl",), ("/d/22/c.jsonl",)], "path string")
    assert sorted(r.id for r in K.orphans(distributions, listing).collect()) == [2, 3]


def test_stray_closing_tags_are_left_in_linear_time(spark):
    import time

    from millrace.functions.transforms import remove_tag_content

    rows = spark.createDataFrame([("a" + "</t> x" * 8000,), ("a <t>1</t><t>2</t> b",), (None,)], "t string")
    began = time.time()
    got = [r[0] for r in rows.select(remove_tag_content("t", F.col("t"))).collect()]
    assert len(got[0]) == 48001 and got[1:] == ["a b", None] and time.time() - began < 10


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_forest_lineage_equals_walked_paths(spark, depth):
    rng = random.Random(depth)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.9 else None for i in range(40)}
    nodes = spark.createDataFrame([(str(i), None if p is None else str(p)) for i, p in parent.items()], "node string, parent string")
    edges = spark.createDataFrame([("N", str(i), "e", "N", str(p)) for i, p in parent.items() if p is not None], "source_type string, source_id string, edge_type string, target_type string, target_id string")
    starts = ["0", "7", "39", "12"]
    walked = L.traverse(edges, spark.createDataFrame([("N", s) for s in starts], "node_type string, node_id string"), depth)
    want = sorted((r.start_id, r.depth, r.from_id, r.node_id) for r in walked.collect())
    got = L.forest_lineage(nodes, spark.createDataFrame([(s,) for s in starts], "node string"), depth)
    assert sorted((r.start_id, r.depth, r.from_id, r.node_id) for r in got.collect()) == want


def test_orphans_look_at_folders_of_known_depths_only(spark):
    paths = [("f:/a/b/c.gz",), ("f:/a/x/lang=en/c.gz",), ("f:/s.gz",)]
    listing = spark.createDataFrame(paths, "path string")
    known = [(1, "f:/a/b", True), (2, "f:/a/x", True), (3, "f:/a/y", True), (4, "f:/a", True), (5, None, True), (6, "f:/a/y", False), (7, "f:/a/x/lang=en", True), (8, "f:/a/b", None), (9, "f:/a/y", True)]
    for rows, wanted in ((known, [3, 5, 9]), (known[2:3], [3]), (known[4:6], [5]), (known[5:6], [])):
        got = K.orphans(spark.createDataFrame(rows, "id int, uri string, materialized boolean"), listing)
        assert sorted(r.id for r in got.collect()) == wanted
    parents = listing.select(F.explode(R.ancestors("path", [2])).alias("u"))
    assert sorted(r.u for r in parents.collect()) == ["f:/a", "f:/a"]
