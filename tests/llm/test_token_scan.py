import collections
import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import token_scan as S


@pytest.mark.parametrize("dtype", ["<u2", ">u4"])
@pytest.mark.parametrize(("block", "fan"), [(3, 2), (16, 4), (100_000, 8)])
def test_documents_across_blocks(spark, tmp_path, dtype, block, fan):
    rng, want = brute.seeded(12), set()
    for f, n in enumerate([0, 1, 500, 1000, 3]):
        tokens = [rng.choice([7, 1, 2, 3, 1, 1, 1]) if f != 3 else (7 if i == 998 else 1) for i in range(n)]
        np.array(tokens, dtype=dtype).tofile(tmp_path / f"f{f}.bin")
        start = doc = 0
        for i, t in enumerate(tokens):
            if t == 7:
                want.add((f, doc, start, i - start, True))
                start, doc = i + 1, doc + 1
        if start < n:
            want.add((f, doc, start, n - start, False))
    got = S.document_tokens(spark, str(tmp_path), S.Layout(dtype, 7, block, fan)).collect()
    assert {(int(os.path.basename(r.path)[1]), r.doc, r.start, r.n_tokens, r.ended) for r in got} == want and len(got) == len(want)


def test_counts_are_the_encoders(spark):
    texts = [None, "", "one", "<|endoftext|> is text", "é 中文 😀\n\n x", brute.prose(brute.seeded(1), 2000)] * 3
    with open(S.VOCABULARY_PATH, "rb") as f:
        encode = S.encoder(f.read())
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, "same id"), (7, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"path": F.lit(1), "name": F.lit("n"), "doc": F.lit(0)})
    got = S.count_tokens(df, layout=S.Layout(block_tokens=100, fan=3)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(encode(t or ""))) for i, t in rows)
    assert all(r.ended for r in got) and S.count_tokens(df.limit(0)).count() == 0


def test_flat_files_by_the_text_writer(spark, tmp_path):
    texts = ["one", "two three", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    S.write_token_files(df, S.token_bytes(F.col("text")), str(tmp_path / "t"))
    got = S.document_tokens(spark, str(tmp_path / "t")).orderBy("doc").collect()
    with open(S.VOCABULARY_PATH, "rb") as f:
        encode = S.encoder(f.read())
    assert [r.n_tokens for r in got] == [len(encode(t or "")) for t in texts] and all(r.ended for r in got)


def test_a_file_of_half_tokens_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        S.document_tokens(spark, str(tmp_path)).collect()
