"""Large files are cut by splits: results must not depend on where a split falls."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import stitch as S
from millrace.sources.scan import json_schema, read_delimited, read_json, scan_checked, spark_type


@pytest.fixture(params=[64, 300, 5000, 1 << 20])
def split(spark, request):
    """Splits of a few bytes, so that one file is many tasks."""
    conf = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return rng.choice(['a "quoted" , ] } text', "back\\slash\\", 'end\\"', "é,[", 7, 1.5, None, True, "x" * 200, ""])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["k", "[", "a,b"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}


def test_arrays_over_many_lines(spark, tmp_path, split):
    rng = random.Random(split)
    wanted = {}
    for name, indent in (("a", 1), ("b", None), ("c", 0)):
        rows = [{"n": i, "v": value(rng), "w": [value(rng)]} for i in range(60)] + [3, "text, with ] comma", [1, 2]]
        body = json.dumps(rows, indent=indent, ensure_ascii=False) if indent is not None else "[\n" + ",\n".join(map(json.dumps, rows)) + "]\n"
        (tmp_path / f"{name}.json").write_text(body)
        wanted[name] = rows
    lines = S.text_lines(spark, str(tmp_path), "*.json")
    if split == 64:
        assert lines.rdd.getNumPartitions() > 30
    found = {}
    for r in S.array_items(lines).collect():
        found.setdefault(r.file[-6], []).append((r.item, json.loads(r.value)))
    assert {k: [v for _, v in sorted(rows, key=lambda x: x[0])] for k, rows in found.items()} == wanted
    good, bad = read_json(spark, str(tmp_path), "*.json")
    assert good.count() == 180 and bad.count() == 9


def test_quoted_fields_with_breaks(spark, tmp_path, split):
    rng = random.Random(split)
    wanted = []
    for name in "abc":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["n", "text", "more"])
        for i in range(80):
            row = [f"{name}{i}", rng.choice(['say "x", y', "two\nlines\n\nthree", 'ends "', "plain", '"', "é\n", ",\n,", "x" * 150]), rng.choice(["m", "q\nr"])]
            writer.writerow(row)
            wanted.append(tuple(row))
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
    good, bad = read_delimited(spark, str(tmp_path), "*.csv")
    assert bad.count() == 0
    assert sorted(map(tuple, good.collect())) == sorted(wanted)


def test_delimited_quarantine_headers_and_encodings(spark, tmp_path, split):
    (tmp_path / "a.tsv").write_text('﻿text\tn\nok\t1\n  \t2\ntoo\tmany\tfields\nfew\n\nin"ner\t3\n')
    (tmp_path / "b.tsv").write_bytes("n\ttext\textra\n4\tcaf\xe9 \x80\tz\n".encode("latin-1"))
    (tmp_path / "c.tsv").write_text("text\tn\n")
    good, bad = scan_checked(spark, str(tmp_path), "*.tsv", path_col="of")
    assert sorted((r.text, r.n, r.extra, r.of[-5]) for r in good.collect()) == [("caf\xe9 \x80", "4", "z", "b"), ('in"ner', "3", None, "a"), ("ok", "1", None, "a")]
    assert sorted(r.value for r in bad.collect()) == ["  \t2", "few", "too\tmany\tfields"]


def test_quarantine_of_a_folder_with_all_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": \n')
    (tmp_path / "b.csv").write_text("x\n2\n3,4\n")
    good, bad = scan_checked(spark, str(tmp_path))
    assert sorted(str(r.x) for r in good.select(F.col("x").cast("string")).collect()) == ["1", "2"]
    assert sorted(r.value for r in bad.collect()) == ["3,4", '{"x": ']


def test_schema_of_json_text(spark):
    texts = ['{"a": 1, "b": {"c": [1, 2.5]}, "x y": true}', ' {"a": 2.5, "b": {"d": "s"}, "e": {}}', '{"a": null, "f": [], "g": [{"h": 1}, {"i": "z"}], "m": 1}', '{"m": "t"}', "[1]", "7", "{broken", None]
    df = spark.createDataFrame([(x,) for x in texts], "value string")
    assert json_schema(df) == spark_type("OBJECT<a: DOUBLE, b: OBJECT<c: ARRAY<DOUBLE>, d: STRING>, e: VOID, f: ARRAY<VOID>, g: ARRAY<OBJECT<h: BIGINT, i: STRING>>, m: VARIANT, `x y`: BOOLEAN>")
    plan = df.agg(F.schema_of_variant_agg(F.try_parse_json("value")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert json_schema(df.limit(0)).fields == []


def test_scanner_states():
    scanner = S.QuoteScanner(",")
    for line, outside, inside in [(b"a,b", False, True), (b'a,"b', True, False), (b'a"b', False, False), (b'"a","b"', False, False), (b'x","y', True, True), (b'""', False, True), (b'"""', True, False)]:
        assert (scanner.ends_inside(line, False), scanner.ends_inside(line, True)) == (outside, inside), line
