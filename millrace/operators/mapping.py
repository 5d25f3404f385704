"""The declarative mapping language compiled to column expressions.

A mapping is ``{destination path: [operation, argument, ...]}``. Paths are resolved
against the schema once, when the plan is built; running the mapping is a projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from millrace.functions import text as T
from millrace.functions import transforms as X
from millrace.operators.validate import violations

SEGMENT = re.compile(r"(\w+)(?:\[(\d*)\])?$")


@dataclass(frozen=True)
class Values:
    """Values a path or a function yields: one column, or an array of values when ``many``.

    ``active`` tells, inside a list, at which positions the value is written at all.
    """

    column: Column
    many: bool = False
    type: t.DataType | None = None
    active: Column | None = None


def parse_path(path: str) -> list[tuple[str, int | str | None]]:
    """``a[2].b[]`` becomes ``[("a", 2), ("b", "*")]``."""
    out = []
    for part in path.split("."):
        match = SEGMENT.match(part)
        if not match:
            raise ValueError(f"malformed path {path!r}")
        index = None
        if part.endswith("]"):
            index = int(match.group(2)) if match.group(2) else "*"
        out.append((match.group(1), index))
    return out


def schema_paths(schema: t.StructType, prefix: str = "") -> list[str]:
    """Every addressable path of a schema in document order; arrays appear bare and with ``[]``."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out.append(path)
        kind = f.dataType
        while isinstance(kind, t.ArrayType):
            path += "[]"
            out.append(path)
            kind = kind.elementType
        if isinstance(kind, t.StructType):
            out.extend(schema_paths(kind, path))
    return out


def json_schema_paths(schema: dict) -> list[str]:
    """Addressable paths declared by a JSON Schema, through properties, items and alternatives."""
    out: list[str] = []

    def walk(node, path):
        if not isinstance(node, dict):
            return
        if "properties" in node:
            for name, child in node["properties"].items():
                here = f"{path}.{name}" if path else name
                out.append(here)
                walk(child, here)
        elif "items" in node:
            out.append(f"{path}[]")
            walk(node["items"], f"{path}[]")
        elif node.get("type") == "array":
            out.append(f"{path}[]")
        for word in ("anyOf", "oneOf", "allOf"):
            for child in node.get(word, []):
                walk(child, path)

    walk(schema, "")
    return list(dict.fromkeys(p for p in out if p))


class Mapping:
    """A mapping bound to a source schema; ``declared`` is an optional JSON Schema of the source."""

    def __init__(
        self,
        spec: dict[str, list],
        source: t.StructType,
        declared: dict | None = None,
        target: dict | None = None,
        functions: dict | None = None,
    ):
        self.spec = spec
        self.source = source
        self.target = target
        self.actual = schema_paths(source)
        self.valid = set(json_schema_paths(declared) if declared else self.actual)
        self.functions = {**X.FUNCTIONS, **(functions or {})}

    # ---- reading ---------------------------------------------------------------------
    def is_path(self, argument) -> bool:
        if not isinstance(argument, str):
            return False
        return argument in self.valid or re.sub(r"\[\d+\]", "[]", argument) in self.valid

    def read(self, path: str) -> Values:
        """Direct path, else the shortest declared path ending in that name, else every
        field of that name at any depth."""
        direct = self._direct(path)
        nested = [p for p in sorted(self.actual, key=len) if p.endswith(f".{path}")]
        shortest = self._direct(nested[0]) if nested else None
        if direct is not None:
            if shortest is not None and not direct.many and not shortest.many and direct.type == shortest.type:
                return Values(F.coalesce(direct.column, shortest.column), False, direct.type)
            return direct
        if shortest is not None and (nested[0] in self.valid or len(nested) == 1):
            return shortest
        found = [v for v in (self._direct(p) for p in self.actual if p.split(".")[-1] == path) if v is not None]
        if not found:
            return Values(F.lit(None).cast("string"), False, t.StringType())
        lists = [self._as_list(v) for v in found]
        return Values(F.flatten(F.array(*lists)), True, found[0].type)

    @staticmethod
    def _as_list(values: Values) -> Column:
        if values.many:
            return values.column
        if isinstance(values.type, t.ArrayType):
            return F.coalesce(values.column, F.array().cast(values.type))
        empty = F.array().cast(t.ArrayType(values.type))
        return F.when(values.column.isNotNull(), F.array(values.column)).otherwise(empty)

    def _direct(self, path: str) -> Values | None:
        column, kind, many = None, self.source, False
        for name, index in parse_path(path):
            if not isinstance(kind, t.StructType) or name not in kind.names:
                return None
            field_type = kind[name].dataType
            if column is None:
                column = F.col(f"`{name}`")
            elif many:
                column = F.transform(column, _getter(name))
            else:
                column = column[name]
            kind = field_type
            if index is None:
                continue
            if not isinstance(kind, t.ArrayType):
                if index not in (0, "*"):
                    return Values(F.lit(None).cast(kind), False, kind)
                if index == "*" and not many:
                    column, many = F.when(column.isNotNull(), F.array(column)), True
                continue
            inner = kind.elementType
            if index == "*":
                column, many = (F.flatten(column) if many else column), True
            elif many:
                column = F.transform(column, _element(index))
            else:
                column = F.get(column, F.lit(index))
            kind = inner
        return Values(column, many, kind)

    # ---- operations ------------------------------------------------------------------
    def argument(self, value):
        """A path becomes its values, ``{"lit": x}`` and everything else stays a literal."""
        if isinstance(value, dict) and set(value) == {"lit"}:
            return value["lit"]
        return self.read(value) if self.is_path(value) else value

    def evaluate(self, operation: list) -> tuple[Values, list[Column]]:
        """Values of an operation and the conditions under which it fails for a row."""
        if not operation:
            return Values(F.lit(None).cast("string"), False, t.StringType()), []
        head, raw = operation[0], operation[1:]
        if isinstance(head, str) and head in self.functions:
            return self._call(head, raw)
        if isinstance(head, dict) and set(head) == {"lit"}:
            return Values(_literal(head["lit"])), []
        if self.is_path(head):
            return self.read(head), []
        return Values(_literal(head)), []

    def _call(self, name: str, raw: list) -> tuple[Values, list[Column]]:
        failures, arguments, lifted = [], [], None
        for value in (self.argument(v) for v in raw):
            if not isinstance(value, Values):
                arguments.append(value)
            elif not value.many or name in X.WHOLE_LIST:
                arguments.append(value.column)
            elif name in X.ELEMENTWISE:
                lifted = (len(arguments), value.column)
                arguments.append(None)
            else:
                # A list stands for its only element; more than one is an error of the row.
                failures.append(F.size(value.column) > 1)
                arguments.append(F.get(value.column, F.lit(0)))
        function = self.functions[name]
        if lifted is None:
            return Values(function(*arguments)), failures
        position, items = lifted

        def one(x: Column) -> Column:
            return function(*[x if i == position else a for i, a in enumerate(arguments)])

        return Values(F.transform(items, one), True), failures

    # ---- writing ---------------------------------------------------------------------
    def columns(self) -> tuple[dict[str, Column], Column]:
        """Destination columns by name and the array of rule errors of a row."""
        entries, errors = [], []
        for path, operation in self.spec.items():
            values, failures = self.evaluate(operation)
            entries.append((parse_path(path), values))
            for failed in failures:
                errors.append(F.when(failed, F.lit(f"{path}: {operation[0]} takes one value")))
        return _build(entries), _error_array(errors)

    def apply(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Mapped columns plus ``errors``: rule errors and violations of the target schema."""
        mapped, rule_errors = self.columns()
        kept = [F.col(k).alias(f"_kept_{k}") for k in keep]
        out = df.select(*kept, *[c.alias(n) for n, c in mapped.items()], rule_errors.alias("errors"))
        if self.target is not None:
            struct = t.StructType([f for f in out.schema.fields if f.name in mapped])
            found = violations(self.target, None, struct, "")
            out = out.withColumn("errors", F.concat("errors", found))
        return out.withColumnsRenamed({f"_kept_{k}": k for k in keep if k not in mapped})


def _getter(name: str):
    return lambda x: x[name]


def _element(index: int):
    return lambda x: F.get(x, F.lit(index))


def _literal(value) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(value)


def _error_array(errors: list[Column]) -> Column:
    if not errors:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*errors))


def _scalar(values: Values) -> Column:
    """First value of many; an empty list becomes null."""
    if values.many:
        return F.get(values.column, F.lit(0))
    if isinstance(values.type, t.ArrayType):
        return F.when(F.size(values.column) > 0, values.column)
    return values.column


def _build(entries: list[tuple[list, Values]]) -> dict[str, Column]:
    """Columns of an object from ``(segments, values)`` entries."""
    grouped: dict[str, list] = {}
    for segments, values in entries:
        grouped.setdefault(segments[0][0], []).append((segments, values))
    out = {}
    for name, group in grouped.items():
        indexes = {segments[0][1] for segments, _ in group}
        if indexes == {None}:
            leaves = [v for segments, v in group if len(segments) == 1]
            out[name] = _scalar(leaves[-1]) if leaves else _nested([(s[1:], v) for s, v in group])
        elif None in indexes:
            raise ValueError(f"{name!r} is written both as a list and as a value")
        else:
            out[name] = _list(group)
    return out


def _struct(entries) -> Column:
    return F.struct(*[c.alias(n) for n, c in _build(entries).items()])


def _nested(entries) -> Column:
    """An object inside another; within a list it is null where no rule writes to it."""
    written = [v.active for _, v in entries]
    if any(a is None for a in written):
        return _struct(entries)
    return F.when(reduce(lambda a, b: a | b, written), _struct(entries))


def _list(group) -> Column:
    """A list from fixed positions, from whole value lists, or from both merged by position."""
    fixed = [s[0][1] for s, _ in group if s[0][1] != "*"]
    spread = any(s[0][1] == "*" for s, _ in group)
    least = max(fixed) + 1 if fixed else 0

    def item(i: Column, columns: Column | None = None) -> Column:
        here = []
        for n, (segments, values) in enumerate(group):
            index = segments[0][1]
            if index == "*":
                column = columns[f"v{n}"]
                value = F.get(column, i) if values.many else F.when(i == 0, column)
                active = i < F.coalesce(F.size(column), F.lit(0)) if values.many else i == 0
            else:
                value, active = F.when(i == index, _scalar(values)), i == index
            here.append((segments[1:], Values(value, False, values.type if index == "*" else None, active)))
        leaves = [v for segments, v in here if not segments]
        if leaves:
            return F.coalesce(*[v.column for v in leaves])
        return _merge(here)

    if not spread:
        return F.array(*[item(F.lit(i)) for i in range(least)])

    def items(columns: Column) -> Column:
        length = F.lit(least)
        for n, (segments, values) in enumerate(group):
            if segments[0][1] == "*":
                size = F.coalesce(F.size(columns[f"v{n}"]), F.lit(0)) if values.many else F.lit(1)
                length = F.greatest(length, size)
        return F.transform(F.filter(F.sequence(F.lit(0), length), lambda i: i < length), lambda i: item(i, columns))

    # The value lists are computed once, not once per element.
    return T.let(F.struct(*[v.column.alias(f"v{n}") for n, (s, v) in enumerate(group) if s[0][1] == "*"]), items)


def _merge(entries) -> Column:
    """An element whose fields may be written by several rules for different positions."""
    merged: dict[tuple, list] = {}
    for segments, values in entries:
        merged.setdefault(tuple(segments), []).append(values)
    flat = []
    for segments, group in merged.items():
        column = group[0].column if len(group) == 1 else F.coalesce(*[v.column for v in group])
        flat.append((list(segments), Values(column, active=reduce(lambda a, b: a | b, [v.active for v in group]))))
    return _struct(flat)


def run_mapping(df: DataFrame, mapping: Mapping, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mapped rows and the quarantine of the rows with errors; nothing aborts the job."""
    out = mapping.apply(df, keep)
    return out.filter(F.size("errors") == 0).drop("errors"), out.filter(F.size("errors") > 0)


def mapping_counts(applied: DataFrame) -> DataFrame:
    return applied.agg(
        F.count("*").alias("read"),
        F.count(F.when(F.size("errors") == 0, 1)).alias("mapped"),
        F.count(F.when(F.size("errors") > 0, 1)).alias("skipped"),
    )
