"""Files written by the round-trip queries: a large table has more of them, with the same rows."""

import glob

import pytest
from pyspark.sql import functions as F

from millrace.plans import round_trip as R


@pytest.mark.parametrize("query, bad", [(R._one_large_array, 4), (R._quoted_breaks, 9)])
def test_no_file_holds_a_quarter_of_a_large_table(spark, tmp_path, monkeypatch, query, bad):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit('a "text", with\nbreaks '), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"),
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found, files = {}, {}
    for name, size in (("one", 1 << 24), ("many", 300)):
        path = f"{tmp_path}/{name}"
        monkeypatch.setattr(R, "scratch", lambda spark, path=path: path)
        found[name] = sorted(map(str, query(spark, str(tmp_path), size).collect()))
        files[name] = len(glob.glob(f"{path}/**/*.txt", recursive=True))
    assert found["one"] == found["many"]
    assert sum("outcome='good'" not in r for r in found["many"]) == bad
    assert files["one"] <= 4 < files["many"]
