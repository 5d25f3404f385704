"""JSON-Schema checks compiled to predicates, and schema inference over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

NO_ERRORS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_ERRORS)


def json_types(kind: t.DataType) -> set[str]:
    if isinstance(kind, (t.StringType, t.DateType, t.TimestampType)):
        return {"string"}
    if isinstance(kind, t.BooleanType):
        return {"boolean"}
    if isinstance(kind, t.IntegralType):
        return {"integer", "number"}
    if isinstance(kind, t.NumericType):
        return {"number"}
    if isinstance(kind, t.ArrayType):
        return {"array"}
    if isinstance(kind, (t.StructType, t.MapType)):
        return {"object"}
    return {"null"}


def _one(test: Column, message: str) -> Column:
    """A one-element list of the message where the test fails."""
    return F.when(F.coalesce(test, F.lit(False)), _empty()).otherwise(F.array(F.lit(message)))


def violations(schema: dict, column: Column | None, kind: t.DataType, path: str) -> Column:
    """Error strings of one value. ``column`` None stands for the row itself.

    A null in an optional field counts as an absent field.
    """
    place = path or "record"
    if "anyOf" in schema:
        alternatives = [violations(s, column, kind, path) for s in schema["anyOf"]]
        ok = F.lit(False)
        for found in alternatives:
            ok = ok | (F.size(found) == 0)
        rest = {k: v for k, v in schema.items() if k != "anyOf"}
        own = _one(ok, f"{place}: no alternative matches")
        return F.concat(own, violations(rest, column, kind, path)) if rest else own

    allowed = schema.get("type")
    allowed = [allowed] if isinstance(allowed, str) else allowed
    checks: list[Column] = []
    if allowed and not (set(allowed) & json_types(kind)):
        checks.append(F.array(F.lit(f"{place}: is not of type {', '.join(allowed)}")))
    if "enum" in schema and column is not None:
        values = [v for v in schema["enum"] if v is not None]
        checks.append(_one(column.isin(values), f"{place}: is not one of the listed values"))
    if isinstance(kind, t.StringType) and column is not None:
        if "minLength" in schema:
            checks.append(_one(F.length(column) >= schema["minLength"], f"{place}: is too short"))
        if "maxLength" in schema:
            checks.append(_one(F.length(column) <= schema["maxLength"], f"{place}: is too long"))
        if "pattern" in schema:
            checks.append(_one(F.rlike(column, F.lit(schema["pattern"])), f"{place}: does not match the pattern"))
    if isinstance(kind, t.ArrayType):
        if "minItems" in schema:
            checks.append(_one(F.size(column) >= schema["minItems"], f"{place}: has too few items"))
        if isinstance(schema.get("items"), dict):
            item_schema, item_kind = schema["items"], kind.elementType
            checks.append(
                F.flatten(F.transform(column, lambda x: violations(item_schema, x, item_kind, f"{place}[]")))
            )
    if isinstance(kind, t.StructType):
        checks.extend(_object_checks(schema, column, kind, path, place))

    found = F.concat(*checks) if checks else _empty()
    if column is None:
        return found
    null_allowed = not allowed or "null" in allowed
    if "enum" in schema and None not in schema["enum"]:
        null_allowed = False
    on_null = _empty() if null_allowed else F.array(F.lit(f"{place}: is null"))
    return F.when(column.isNull(), on_null).otherwise(found)


def _object_checks(schema: dict, column: Column | None, kind: t.StructType, path: str, place: str) -> list[Column]:
    checks = []
    required = set(schema.get("required", []))
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        if name not in kind.names:
            checks.append(F.array(F.lit(f"{place}: {name} is required")))
    for name, child in properties.items():
        if name not in kind.names:
            continue
        value = F.col(f"`{name}`") if column is None else column[name]
        found = violations(child, value, kind[name].dataType, f"{path}.{name}" if path else name)
        checks.append(found if name in required else F.when(value.isNull(), _empty()).otherwise(found))
    if schema.get("additionalProperties") is False:
        for name in kind.names:
            if name not in properties:
                value = F.col(f"`{name}`") if column is None else column[name]
                checks.append(_one(value.isNull(), f"{place}: {name} is not allowed"))
    return checks


def with_violations(df: DataFrame, schema: dict, name: str = "errors") -> DataFrame:
    return df.withColumn(name, violations(schema, None, df.schema, ""))


def validate_first(df: DataFrame, schema: dict) -> DataFrame:
    """The check of a single sample record."""
    return with_violations(df.limit(1), schema)


def _label(kind: t.DataType) -> str:
    return "array" if isinstance(kind, t.ArrayType) else sorted(json_types(kind))[0]


def _is_object_list(kind: t.DataType) -> bool:
    return isinstance(kind, t.ArrayType) and isinstance(kind.elementType, t.StructType)


def _measure_fields(struct: t.StructType, value: Column | None, prefix: str, here: Column) -> list[tuple]:
    """``(path, type, present, total)`` of the fields of a record or of a nested object."""
    out = []
    for f in struct.fields:
        column = F.col(f"`{f.name}`") if value is None else value[f.name]
        path = f"{prefix}.{f.name}" if prefix else f.name
        present = F.when(column.isNotNull(), 1).otherwise(0)
        out.append((path, _label(f.dataType), present, here))
        if isinstance(f.dataType, t.StructType):
            out += _measure_fields(f.dataType, column, path, present)
        elif _is_object_list(f.dataType):
            out += _measure_items(f.dataType.elementType, column, f"{path}[]", F.coalesce(F.size(column), F.lit(0)), lambda x: x)
    return out


def _measure_items(struct: t.StructType, items: Column, prefix: str, here: Column, parent) -> list[tuple]:
    """The same for the objects of a list; ``parent`` leads from an item to the object."""
    out = []
    for f in struct.fields:
        def field(x: Column, name: str = f.name) -> Column:
            return parent(x)[name]

        path = f"{prefix}.{f.name}"
        present = F.coalesce(F.size(F.filter(items, _filled_by(field))), F.lit(0))
        out.append((path, _label(f.dataType), present, here))
        if isinstance(f.dataType, t.StructType):
            out += _measure_items(f.dataType, items, path, present, field)
        elif _is_object_list(f.dataType):
            inner = F.flatten(F.transform(items, _only_item(field)))
            out += _measure_items(f.dataType.elementType, inner, f"{path}[]", F.coalesce(F.size(inner), F.lit(0)), lambda x: x)
    return out


def _filled_by(field):
    return lambda x: field(x).isNotNull()


def _only_item(field):
    # A missing inner list must not void the flattened list.
    return lambda x: F.coalesce(field(x), F.array())


def presence(df: DataFrame) -> DataFrame:
    """``(path, type, present, total, required)`` of every field at any depth, from one pass over all rows."""
    measures = _measure_fields(df.schema, None, "", F.lit(1))
    aggregated = df.agg(
        *[F.sum(m[2]).alias(f"p{i}") for i, m in enumerate(measures)],
        *[F.sum(m[3]).alias(f"t{i}") for i, m in enumerate(measures)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(path).alias("path"), F.lit(label).alias("type"),
                F.col(f"p{i}").alias("present"), F.col(f"t{i}").alias("total"),
            )
            for i, (path, label, _, _) in enumerate(measures)
        ]
    )
    return aggregated.select(F.explode(rows).alias("r")).select(
        "r.*", (F.col("r.present") == F.col("r.total")).alias("required")
    )


def infer_json_schema(df: DataFrame) -> dict:
    """JSON Schema of the records; ``required`` holds what every record carries."""
    required = {r["path"] for r in presence(df).filter("required").select("path").collect()}

    def describe(kind: t.DataType, path: str) -> dict:
        if isinstance(kind, t.StructType):
            names = [f.name for f in kind.fields]
            full = {n: f"{path}.{n}" if path else n for n in names}
            node = {"type": "object", "properties": {f.name: describe(f.dataType, full[f.name]) for f in kind.fields}}
            needed = sorted(n for n in names if full[n] in required)
            return {**node, "required": needed} if needed else node
        if isinstance(kind, t.ArrayType):
            return {"type": "array", "items": describe(kind.elementType, f"{path}[]")}
        return {"type": sorted(json_types(kind))[0]}

    return describe(df.schema, "")
