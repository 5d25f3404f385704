import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators.standardize import standardize
from millrace.operators.silo_store import Store, join_store, write_store
from millrace.operators.stats_query import join_stats
from millrace.sources import webpages
from millrace.sources import sinks as K
from millrace.sources.listing import check_written, list_files
from millrace.sources.scan import detect_glob, format_of, read_json, read_staged, scan
from millrace.sources.webpages import page_markdown, warc_responses


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_format_of():
    assert [format_of(x) for x in ("*.jsonl.gz", "*.json", "x/*.parquet", "*.arrow", "*.ipc", "*.csv", "*.tsv", "*.warc.gz")] == [
        "json", "json", "parquet", "arrow", "arrow", "csv", "tsv", "warc"]
    with pytest.raises(ValueError):
        format_of("*.xlsx")


def test_json_lines_with_bad_lines(spark, tmp_path):
    write(tmp_path / "sub" / "a.jsonl.gz", gzip.compress(b'{"a": 1}\n\n{"a": 2\n[{"a": 3}, {"a": 4}]\n'))
    assert detect_glob(spark, str(tmp_path)) == "*.jsonl.gz"
    good, bad = read_json(spark, str(tmp_path), "*.jsonl.gz")
    assert sorted(r.a for r in good.collect()) == [1, 3, 4]
    assert bad.count() == 1
    assert scan(spark, str(tmp_path), partitions=3).rdd.getNumPartitions() == 3


def test_every_json_file_has_its_own_shape(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2, "b": {"c": [1, {"d": null}]}}\nbroken\n[{"a": 3}, 7]\n')
    write(tmp_path / "b.json", "\n" + json.dumps([{"a": 10}, 8, {"a": 11}], indent=2) + "\n" + " " * 500)
    write(tmp_path / "c.json", '[{"a": 20}]')
    good, bad = read_json(spark, str(tmp_path), "*.json*")
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 10, 11, 20]
    assert sorted(r.value for r in bad.collect()) == ["7", "8", "broken"]
    spark.createDataFrame([(30,)], "a long").write.parquet(str(tmp_path / "p"))
    assert sorted(r.a for r in scan(spark, str(tmp_path)).collect()) == [1, 2, 3, 10, 11, 20, 30]


def test_json_array_over_lines(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert sorted(r.a for r in scan(spark, str(tmp_path)).collect()) == [1, 2]


def test_delimited_files_by_encoding(spark, tmp_path):
    write(tmp_path / "a.csv", 'text,n\n"caffè, sì",1\n" ",2\n"two\nlines",3\n')
    write(tmp_path / "b.csv", "text,n\ncaffè,4\n".encode("latin-1"))
    write(tmp_path / "t" / "c.tsv", "text\tn\nx,y\t5\n")
    rows = {r.n: r.text for r in scan(spark, str(tmp_path), "*.csv").collect()}
    assert rows == {"1": "caffè, sì", "3": "two\nlines", "4": "caffè"}
    assert scan(spark, str(tmp_path), "*.tsv").first().text == "x,y"


def test_pattern_names_a_folder(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/docs.parquet")
    spark.range(4).repartition(2).write.json(f"{tmp_path}/lines.json")
    assert sorted(r.id for r in scan(spark, str(tmp_path), "docs.parquet", path_col="file").collect()) == list(range(10))
    assert sorted(r.id for r in scan(spark, str(tmp_path), "lines.json").collect()) == list(range(4))
    # Files that match by themselves are read once.
    assert scan(spark, str(tmp_path), "*.parquet").count() == 10
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/in/x")
    next((tmp_path / "in" / "x").glob("*.parquet")).rename(tmp_path / "in" / "docs.parquet")
    assert scan(spark, str(tmp_path), "docs.parquet").count() == 12


def test_arrow_files(spark, tmp_path):
    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    other = pa.table({"a": pa.array([3], pa.int32()), "c": [1.5]})
    with pa.OSFile(str(tmp_path / "z.arrow"), "wb") as sink, pa.ipc.new_file(sink, other.schema) as out:
        out.write_table(other)
    rows = sorted((r.a, r.b or "", r.c) for r in scan(spark, str(tmp_path), "*.arrow").collect())
    assert rows == [(1, "x", None), (1, "x", None), (2, "", None), (2, "", None), (3, "", 1.5)]


def warc(url, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + url + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nWARC\r\n\r\n"
    data = info + warc(b"http://a", b"<p>one</p>") + warc(b"http://b", "<p>zwölf WARC/1.0</p>".encode())
    assert [u for u, _ in warc_responses(data)] == ["http://a", "http://b"]
    write(tmp_path / "x.warc.gz", gzip.compress(data))
    rows = {r.url: r.html for r in scan(spark, str(tmp_path), "*.warc.gz").collect()}
    assert rows["http://b"] == "<p>zwölf WARC/1.0</p>"


def test_markdown():
    page = "<html><head><title>t</title><script>x()</script></head><body><h2>Head</h2><p>a <b>bold</b>\n <a href='/u'>link</a></p><ul><li>one<li>two</ul><pre>x  y\n z</pre><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert page_markdown(page) == "## Head\n\na **bold** [link](/u)\n\n* one\n* two\n\n```\nx  y\n z\n```\n\n| 1 | 2 |"


def test_staged_hub_dataset(spark, tmp_path):
    for config in ("c1", "c2"):
        for split in ("train", "test"):
            write(tmp_path / "org" / "set" / config / split / "a.jsonl", json.dumps({"text": f"{config} {split}", "kind": 7}) + "\n")
    rows = read_staged(spark, str(tmp_path), "org/set", distribution_key="kind").collect()
    assert sorted((r._dataset_name, r.text, r._split, r._distribution) for r in rows) == [
        ("org/set/c1", "c1 train", "train", "7"), ("org/set/c2", "c2 train", "train", "7")]


def records(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("it").alias("lang"))


def test_processed_layer_round_trip(spark, tmp_path):
    standard = standardize(records(spark), ["en", "it"], "set", "/data/raw/set", F.lit("/data/raw/set/x/f.jsonl"), F.col("lang"), exclude=("lang",))
    target = str(tmp_path / "out")
    K.write_processed(standard.drop("_full_text", "lang"), target, "dist")
    listed = list_files(spark, target, "*.json.gz")
    check_written(listed)
    assert {p.path.split("/")[-2] for p in listed.collect()} == {"lang=en", "lang=it"}
    back = scan(spark, target, "*.json.gz")
    assert back.count() == 40 and back.filter("_lang = 'it' and _dataset_name = 'processed__set' and _filename = 'f_processed'").count() == 20
    with pytest.raises(Exception, match="(?i)exist"):
        K.write_processed(standard, target, "dist")


def test_check_written_needs_files(spark):
    with pytest.raises(ValueError):
        check_written(spark.createDataFrame([], "path string, length long"))


def test_query_result_chunks(spark, tmp_path):
    df = records(spark, 300)
    rows, size = K.measure(df)
    path = str(tmp_path / "q")
    assert K.write_query_result(df, path, chunk=size // 3) == 3
    back = spark.read.json(path)
    assert back.count() == 300 and back.select("_filename").distinct().count() == 3
    assert K.write_query_result(df.limit(0), str(tmp_path / "none")) == 0
    assert [K.chunk_count(x, 100) for x in (10, 120, 160, 260)] == [1, 1, 2, 3]


def test_rolling_files_and_formats(spark, tmp_path):
    df = records(spark, 400).coalesce(1)
    _, size = K.measure(df)
    K.write_rolling(df, str(tmp_path / "r"), file_bytes=size // 4)
    assert len(list((tmp_path / "r").glob("*.parquet"))) in (4, 5)
    with pytest.raises(ValueError):
        K.write_records(df, str(tmp_path / "x"), ".xml")


def test_bucketed_tables_join_without_moving_data(spark):
    data = records(spark).select(F.sha2("text", 256).alias("_id_hash"), "text")
    silo = data.select(F.col("_id_hash").alias("id"), F.length("text").alias("_length"))
    K.write_bucketed(data, "bucketed_data", "_id_hash", 4, "overwrite")
    K.write_bucketed(silo, "bucketed_silo", "id", 4, "overwrite")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_stats(spark.table("bucketed_data"), spark.table("bucketed_silo"), filters=[("_length", ">", 6)])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stored_silo_moves_no_text_and_splits_hot_ids(spark, tmp_path):
    """A third of the records share one id: they lie in plain splits, the others in buckets."""
    data = spark.range(900).selectExpr("sha2(cast(if(id % 3 = 0, 0, id) as string), 256) as _id_hash", "concat('text ', id) as text", "'d' as _subpath")
    silo = data.select(F.col("_id_hash").alias("id")).distinct().select("id", F.length("id").alias("_length"), (F.crc32("id") % 100 - 30).alias("_word_count"))
    store = Store("tried")
    write_store(store, str(tmp_path), data, silo, buckets=4)
    assert store.exists(spark) and spark.table("tried_data_hot").count() == 300 and spark.table("tried_data").count() == 600
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_store(spark, store, [("_word_count", ">", 0)], folder="x", keep=["_length"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "PushedFilters: [IsNotNull(_word_count), GreaterThan(_word_count,0)" in plan
        want = join_stats(data, silo, filters=[("_word_count", ">", 0)], folder="x", keep=["_length"])
        assert sorted(map(str, joined.collect())) == sorted(map(str, want.select(*joined.columns).collect())) and joined.count() > 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_json_safe_nested(spark):
    df = spark.sql("select array(cast('nan' as double), 1.5D) as a, named_struct('d', date'2024-01-02', 'n', 1.50) as s, map(1, X'41') as m")
    row = K.json_safe(df).first()
    assert row.a == [None, 1.5] and row.s.d == "2024-01-02" and row.s.n == 1.5 and row.m == {"1": "A"}


def test_down_sampled_copy_is_written_once(spark, tmp_path):
    df = records(spark, 500)
    path = str(tmp_path / "sample")
    assert K.materialize_sample(df, path, "text", 0.5, 1) is True
    kept = spark.read.parquet(path).count()
    assert 200 < kept < 300
    assert K.materialize_sample(df, path, "text", 0.9, 1) is False
    assert spark.read.parquet(path).count() == kept


def test_export_formats(spark, tmp_path):
    K.write_export(records(spark, 3), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["text", "lang"]
    with pytest.raises(ValueError):
        K.write_export(records(spark, 3), str(tmp_path / "y"), "yml")


def test_record_compressed_warc():
    data = b"".join(gzip.compress(warc(f"http://{i}".encode(), b"<p>page</p>")) for i in range(5))
    assert [u for u, _ in warc_responses(data)] == [f"http://{i}" for i in range(5)]


def test_stored_silo_is_pruned_and_filtered_at_the_scan(spark, tmp_path):
    silo = spark.range(50).selectExpr("cast(id as string) as id", "id as _word_count", "id as _length", "id as _lines_count")
    silo.write.parquet(str(tmp_path / "silo"))
    data = spark.range(50).selectExpr("cast(id as string) as _id_hash", "'t' as text")
    joined = join_stats(data, spark.read.parquet(str(tmp_path / "silo")), filters=[("_word_count", ">", 40)])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(_word_count,40)" in plan and "_lines_count" not in plan
    assert joined.count() == 9


def test_pages_are_opened_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(webpages, "PAGES_AT_ONCE", 3)
    plain = webpages.html_to_markdown.func
    pages = pa.array([f"<p>page {i}</p>" if i % 4 else None for i in range(10)])
    assert plain(pages).to_pylist() == [f"page {i}" if i % 4 else None for i in range(10)]
    assert plain(pages.slice(0, 0)).to_pylist() == []
