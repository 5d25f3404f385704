import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
from millrace.llm import piece_dropout as P

TEXTS = [
    "", "a", " a", "  a  b ", "a\n\n b", "中文字 ok", "😀 x\t\ty", "   ", "\n", "aaaaaaaa" * 20, "def f(x):\n    return x  # ok", "𓀀𓀁 ab", "x ▁y ▁",
    "<s> </s> <0x41>", "The quick brown fox.\nL'été, ça va? Größe.", brute.prose(brute.seeded(1), 3000),
]


@pytest.fixture(scope="module")
def model():
    return P.load(P.read_model(P.MODEL_PATH))


def test_no_dropout_gives_the_models_own_pieces(model):
    plain = sentencepiece.SentencePieceProcessor(model_proto=P.read_model(P.MODEL_PATH))
    texts = [t for t in TEXTS if "▁" not in t]
    got = model.encode(texts, np.zeros(len(texts), np.uint64), P.Dropout(0.0))
    assert [g.tolist() for g in got] == [plain.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0 - 2**-20])
def test_rounds_match_the_agenda_of_each_chunk(model, rate):
    text = " ".join(t for t in TEXTS if t)
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(c) + 1 for c in text.split(" ")][:-1])
    begin = np.cumsum(size) - size
    key = P.W.mix(np.arange(len(size), dtype=np.uint64))
    offsets, values = model.segment(chars, begin, size, key, int(rate * 2**64))
    for i, (b, n) in enumerate(zip(begin, size)):
        assert values[offsets[i] : offsets[i + 1]].tolist() == model.agenda_of_chunk(text[b : b + n], int(key[i]), int(rate * 2**64))


def test_round_trip_nulls_and_variation(spark):
    rows = [*enumerate(TEXTS), (100, None), (None, "x"), (5, TEXTS[5]), (200, TEXTS[-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pieces", F.lit(0))
    got = P.encoded_and_decoded(df).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all(r.n_pieces == len(r.pieces or []) for r in got)
    by_id = {r.doc_id: r.pieces for r in got}
    assert by_id[100] is None and by_id[0] == [] and by_id[len(TEXTS) - 1] != by_id[200]
    back = P.with_pieces(df).withColumn("back", P.decode(F.col("pieces")))
    assert back.filter("NOT (back <=> text)").count() == 0
    assert sorted(map(str, P.encoded_and_decoded(df.repartition(5)).collect())) == sorted(map(str, got))
    assert P.encoded_and_decoded(df.limit(0)).count() == 0


def test_every_occurrence_has_its_own_draw(model):
    words = ["transformation", "of", "the", "a" * 40]
    text = " ".join(words * 500)
    plain = {w: model.agenda_of_chunk(" " + w, 0, 0) for w in words}
    (ids,) = model.encode([text], np.array([7], np.uint64), P.Dropout(0.1))
    assert model.decode(ids) == text
    ends = np.cumsum([len(model.bytes_of[i]) for i in ids])
    cuts = np.searchsorted(ends, np.cumsum([len(w) + 1 for w in words * 500])) + 1
    ways = {w: [] for w in words}
    for w, s, e in zip(words * 500, [0, *cuts[:-1]], cuts):
        ways[w].append(tuple(ids[s:e].tolist()))
    assert len(set(ways["transformation"])) > 8 and len(set(ways["a" * 40])) > 8
    # Two merges make " of"; if the first is skipped, another order of merges may still make it.
    share = sum(x == tuple(plain["of"]) for x in ways["of"]) / 500
    assert abs(share - (0.9**2 + 0.1 * 0.9**2)) < 0.05


def test_occurrences_match_their_own_agenda(model, monkeypatch):
    text = " ".join(["transformation of the lexicon"] * 100)
    (shared,) = model.encode([text], np.array([3], np.uint64), P.Dropout(0.2))
    monkeypatch.setattr(P.PieceModel, "skipping", lambda self, chunk, *_: np.ones(len(chunk), bool))
    (single,) = model.encode([text], np.array([3], np.uint64), P.Dropout(0.2))
    assert shared.tolist() == single.tolist()


def test_rate_one_skips_every_merge(model):
    (ids,) = model.encode(["some words, and more words"], np.zeros(1, np.uint64), P.Dropout(1.0))
    assert len(ids) == len(" some words, and more words")


def test_chunks_are_hashed_in_bounded_pieces(monkeypatch):
    texts, salts = ["some words of one text and more\n" * 20, "", "other  words", "x" * 200] * 3, np.arange(12, dtype=np.uint64)
    model, seen = P.load(P.read_model(P.MODEL_PATH)), []
    want = model.encode(texts, salts, P.Dropout(0.3))
    whole = P.W.prefix_hash
    monkeypatch.setattr(P, "HASHED_CHARS", 64)
    monkeypatch.setattr(P.W, "prefix_hash", lambda values, base: seen.append(len(values)) or whole(values, base))
    got = model.encode(texts, salts, P.Dropout(0.3))
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    # A piece goes on to the end of its last chunk.
    assert max(seen) <= 64 + 201


def test_a_batch_is_worked_off_in_small_parts(spark, monkeypatch):
    text = pa.array([None if i % 7 == 3 else TEXTS[i % len(TEXTS)] * (i % 5) for i in range(50)], pa.string())
    salts = np.arange(50, dtype=np.uint64)
    monkeypatch.setattr(P, "BATCH_TEXTS", 8)
    parts = list(P.text_batches(text, salts))
    assert max(len(plain) for plain, _ in parts) == 8 and [t for plain, _ in parts for t in plain] == text.to_pylist()
    assert np.concatenate([own for _, own in parts]).tolist() == salts.tolist()
    assert [plain for plain, _ in P.text_batches(text[:0], salts[:0])] == [[]]
    # More rows than a part holds, through Spark.
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab cd", None, ""] * 700)], "doc_id long, text string").coalesce(1)
    got = P.encoded_and_decoded(df, drop=P.Dropout(0.0)).select("doc_id", "n_pieces", "lossless").collect()
    assert len(got) == 2100 and all(r.lossless for r in got) and len({(r.doc_id % 3, r.n_pieces) for r in got}) == 3
