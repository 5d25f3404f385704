import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import transforms as X
from millrace.operators.mapping import Mapping, json_schema_paths, parse_path, run_mapping, schema_paths
from millrace.operators.validate import infer_json_schema, presence, with_violations
from millrace.sources.sinks import write_with_quarantine

HASH = "a" * 64


@pytest.fixture(scope="module")
def questions(spark):
    schema = "id string, question string, text array<string>, answerKey string, _lang string, _id_hash string"
    return spark.createDataFrame([("1", "Which?", ["x", "y", "z"], "B", "en", HASH), ("2", "Bad", ["x"], "", "english", "no")], schema)


# An invented record: a riddle with its choices becomes a talk of two turns.
RIDDLE = "nr string, riddle string, choices array<string>, solution string, tongue string, level int"
SPEC = {
    "kind": ["quiz"], "tongue": ["tongue"], "level": ["level"], "note": [None],
    "talk[0].by": ["asker"], "talk[0].says": ["ARC_simple_chat", "riddle", "choices"],
    "talk[1].by": ["solver"], "talk[1].says": ["solution"],
}
TARGET = {
    "type": "object", "required": ["talk", "tongue"], "additionalProperties": False,
    "properties": {
        "kind": {"type": "string"}, "note": {"type": ["string", "null"]}, "level": {"type": "integer"},
        "tongue": {"type": "string", "maxLength": 3, "pattern": "^[a-z]+$"},
        "talk": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["by", "says"], "properties": {
            "by": {"enum": ["asker", "solver"]}, "says": {"type": "string", "minLength": 1}}}},
    },
}


@pytest.fixture(scope="module")
def riddles(spark):
    return spark.createDataFrame([("7", "What has keys?", ["a piano", "a cloud"], "A", "en", 2), ("8", "Why?", ["so"], "", "Dutch", 1)], RIDDLE)


def test_worked_example(riddles):
    good, bad = run_mapping(riddles, Mapping(SPEC, riddles.schema, target=TARGET), ["nr"])
    row = good.first()
    assert good.count() == 1 and (row.kind, row.tongue, row.level, row.note) == ("quiz", "en", 2, None)
    assert [(m.by, m.says) for m in row.talk] == [("asker", "What has keys?\nA: a piano\nB: a cloud"), ("solver", "A")]
    assert set(bad.first().errors) == {"tongue: is too long", "tongue: does not match the pattern", "talk[].says: is too short"}


def test_identity_mapping_is_identity(questions):
    mapping = Mapping({c: [c] for c in questions.columns}, questions.schema)
    assert sorted(mapping.apply(questions).drop("errors").collect()) == sorted(questions.collect())


def test_paths():
    assert parse_path("a[2].b[].c") == [("a", 2), ("b", "*"), ("c", None)]
    schema = {"properties": {"a": {"items": {"properties": {"b": {}}}}, "c": {"anyOf": [{"properties": {"d": {}}}, {"type": "null"}]}, "e": {"type": "array"}}}
    assert json_schema_paths(schema) == ["a", "a[]", "a[].b", "c", "c.d", "e", "e[]"]
    with pytest.raises(ValueError):
        parse_path("a..b")


def test_schema_paths(questions):
    assert "text[]" in schema_paths(questions.schema)


def test_literals_and_paths(questions):
    mapping = Mapping({"a": [{"lit": "question"}], "b": ["question"], "c": ["text[1]"], "d": ["nothing"]}, questions.schema)
    row = mapping.apply(questions).filter("b = 'Which?'").first()
    assert (row.a, row.b, row.c, row.d) == ("question", "Which?", "y", "nothing")


def test_list_where_one_value_is_needed(questions):
    out = Mapping({"a": ["remove_strings", "text[]", ["x"]]}, questions.schema).apply(questions, ["id"])
    by_id = {r.id: r for r in out.collect()}
    assert by_id["1"].errors == ["a: remove_strings takes one value"] and by_id["2"].errors == []


def test_single_literal_list_stays_a_list(questions):
    row = Mapping({"a": ["remove_strings", "question", ["Wh"]]}, questions.schema).apply(questions).first()
    assert row.a == "ich?"


def removed(text):
    """Delete the first opening to the next closing tag until there is no such pair."""
    pattern = re.compile(r"<\s*x\s*>.*?</\s*x\s*>", re.S | re.I)
    while pattern.search(text):
        text = pattern.sub(" ", text)
    return " ".join(text.split())


@pytest.mark.parametrize(
    "text",
    [
        "no tags", "a <x>b</x> c", "a <x><x>b</x></x> c", "<<x>q</x>x>z</x> left", "<<<x>1</x>x>2</x>x>3</x>", "</x> <x> open",
        "<x>1</x> <X >2</ x> \n <x>\n3</x>",
    ],
)
def test_tags_are_removed_until_none_is_left(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.remove_tag_content("x", F.col("t")).alias("o")).first().o == removed(text)


def test_transforms(spark):
    df = spark.createDataFrame([("a <T>\n one </t> b <t>two</t>", "say:  hi say: you")], "t string, p string")
    row = df.select(
        X.extract_tag_content("t", F.col("t")).alias("tag"), X.remove_prefix("say:", F.col("p")).alias("rest"),
        X.remove_prefix("zzz", F.col("p")).alias("same"), X.remove_regex_strings(F.col("p"), ["S.Y:"]).alias("re"),
        X.map_enum(F.lit("u"), {"u": "USER"}).alias("m"), X.map_enum(F.lit("q"), {"u": "USER"}).alias("miss"),
        X.concat(F.lit("a"), "", None, F.lit(3)).alias("c"),
    ).first()
    assert row.tag == "[one]" and row.rest == "hi say: you" and row.same == "say:  hi say: you"
    assert row.re == "hi you" and row.m == "USER" and row.miss is None and row.c == "a 3"


def test_inferred_schema_requires_what_all_records_have(spark):
    df = spark.createDataFrame([(1, "x", [(1, "p")]), (2, None, [(2, None)])], "a int, b string, c array<struct<d:int,e:string>>")
    schema = infer_json_schema(df)
    assert schema["required"] == ["a", "c"] and schema["properties"]["c"]["items"]["required"] == ["d"]
    assert schema["properties"]["a"] == {"type": "integer"}


def test_presence_in_nested_lists(spark):
    df = spark.sql(
        "select named_struct('l', array(named_struct('x', 1, 'm', array(named_struct('y', 'a'), named_struct('y', null))), "
        "named_struct('x', null, 'm', null))) as s"
    )
    rows = {r.path: (r.present, r.total) for r in presence(df).collect()}
    assert rows == {"s": (1, 1), "s.l": (1, 1), "s.l[].x": (1, 2), "s.l[].m": (1, 2), "s.l[].m[].y": (1, 2)}


def test_mapped_and_quarantined_rows_in_one_job(spark, riddles, tmp_path):
    applied = Mapping(SPEC, riddles.schema, target=TARGET).apply(riddles, ["nr"])
    assert write_with_quarantine(applied, str(tmp_path / "m")) == {"read": 2, "mapped": 1, "skipped": 1}
    back = spark.read.json(str(tmp_path / "m"))
    assert {r.outcome: r.nr for r in back.collect()} == {"mapped": "7", "quarantined": "8"}


def test_validation_of_types_and_alternatives(spark):
    df = spark.createDataFrame([(1, "x", None), (None, "yy", 2.0)], "a int, b string, c double")
    schema = {"required": ["a", "z"], "properties": {"a": {"type": "integer"}, "b": {"anyOf": [{"type": "string", "minLength": 2}, {"type": "number"}]}, "c": {"type": "integer"}}}
    rows = with_violations(df, schema).collect()
    assert rows[0].errors == ["record: z is required", "b: no alternative matches"]
    assert rows[1].errors == ["record: z is required", "a: is null", "c: is not of type integer"]
