import collections

import brute
import numpy as np

import __spark_entry__ as entry
import corpus_pipeline as C
from millrace.llm import piece_dropout as P
from millrace.llm import wordscan as W


def corpus():
    rng = brute.seeded(20)
    rows, shared = [], brute.prose(rng, 60, 10**6)
    for i in range(60):
        text = brute.prose(rng, rng.choice([20, 200, 400]), 30000)
        if i % 4 == 0:
            text = f"{text} {shared}"
        rows.append([i, text, "en", f"s{i % 3}" if i % 7 else None])
    for i in range(60, 75):  # near copies of earlier rows
        words = rows[i - 60][1].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append([i, " ".join(words), "en", "s0"])
    rows += [[75, None, "en", "s1"], [76, "", None, "s1"], [77, "In. " * 300, "en", "s2"], [2, rows[2][1], "en", "s2"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def test_stages_match_plain_versions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    frames, names = {}, [name for name, _ in C.STAGES]
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = C.stored(stage(spark, docs, ""), name)
        frames[name] = (before, docs.collect())
        assert name == names[-1] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = frames[names[0]]
    # Repetitive text goes and clean text of 50 words or more stays.
    assert {r.doc_id for r in after} == {r.doc_id for r in before if len(brute.words(r.text)) >= 50 and r.doc_id != 77}
    before, after = frames[names[1]]
    group = brute.near_groups([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted({min(r.doc_id for r, h in zip(before, group) if h == g) for g in group})
    assert len(after) == len(set(group))
    before, after = frames[names[2]]
    want = brute.removal([r.text for r in before], 35)
    assert {r.doc_id: brute.words(r.text) for r in after} == {r.doc_id: w for r, w in zip(before, want)}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = frames[names[3]]
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
        largest[r.source] = max(largest[r.source], len(brute.words(r.text)))
    for r in after:
        taken[r.source] += len(brute.words(r.text))
    goal = brute.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 3
    before, after = frames[names[4]]
    model = P.load(P.read_model(P.MODEL_PATH))
    assert sorted(model.decode(np.array(r.pieces)) for r in after) == sorted(r.text for r in before) and all(r.lossless for r in after)


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_hand_out_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, wanted in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(key, given)
            C.STAGES[0][1](spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
            assert spark.conf.get(key) == wanted
    finally:
        spark.conf.set(key, before)


def test_one_table_of_powers_is_kept_for_a_base():
    base = int(W.SEQUENCE_BASES[0])
    long, short = W.powers(base, 1 << 14), W.powers(base, 1 << 10)
    assert np.shares_memory(long[0], short[0]) and len(short[1]) == 1 << 10
    assert int(long[0][5]) == pow(base, 5, 1 << 64) and (long[0] * long[1] == 1).all()
