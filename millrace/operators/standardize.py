"""From raw records to standard records: cleaning, identity, language and core fields.

Everything here is a projection of the scanned row; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from millrace import constants as C
from millrace.functions import text as T
from millrace.functions.language import choose_language


def _data_fields(df: DataFrame, exclude=()) -> list[t.StructField]:
    return [f for f in df.schema.fields if f.name not in exclude]


def as_text(field: t.StructField, column: Column | None = None) -> Column:
    """A value as text: strings and numbers by cast, nested values as JSON."""
    value = F.col(f"`{field.name}`") if column is None else column
    if isinstance(field.dataType, t.StringType):
        return value
    if isinstance(field.dataType, (t.StructType, t.ArrayType, t.MapType, t.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def clean(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Strip strings; a string that strips to nothing becomes null."""
    strings = [f.name for f in _data_fields(df, exclude) if isinstance(f.dataType, t.StringType)]
    return df.withColumns({n: F.nullif(T.strip(F.col(f"`{n}`")), F.lit("")) for n in strings})


def full_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All values concatenated in field-name order, nulls skipped, no separator."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.concat_ws("", *[as_text(f) for f in sorted(fields, key=lambda f: f.name)])


def id_hash(text: Column) -> Column:
    """SHA-256 of the text; null for an empty text, which has no identity."""
    return F.when(F.length(text) > 0, F.sha2(text, 256))


def split_identified(df: DataFrame, hash_col: str = "_id_hash") -> tuple[DataFrame, DataFrame]:
    """Rows with an identity and the quarantine of those without."""
    return df.filter(F.col(hash_col).isNotNull()), df.filter(F.col(hash_col).isNull())


def lang_sample(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The first longer sentence-like string in field order, else all values joined."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    sentences = []
    for f in fields:
        if isinstance(f.dataType, t.StringType):
            value = T.strip(F.col(f"`{f.name}`"))
            sentence_like = (F.length(value) > C.LANG_SAMPLE_MIN_CHARS) & F.contains(value, F.lit(" "))
            sentences.append(F.when(sentence_like, value))
    truthy = []
    for f in fields:
        value = as_text(f)
        if isinstance(f.dataType, t.NumericType):
            value = F.when(F.col(f"`{f.name}`") != 0, value)
        elif isinstance(f.dataType, t.BooleanType):
            value = F.when(F.col(f"`{f.name}`"), value)
        else:
            value = F.nullif(value, F.lit(""))
        truthy.append(value)
    joined = F.concat_ws(" ", *truthy)
    return F.coalesce(*sentences, joined) if sentences else joined


def subpath_of(path: Column, dataset_path: Column) -> Column:
    """Directory of ``path`` relative to the dataset directory, '' when outside or at its root."""
    folder = F.regexp_replace(path, r"/?[^/]*\z", "")
    root = F.rtrim(dataset_path, F.lit("/"))
    inside = F.startswith(folder, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(folder, F.length(root) + 2)).otherwise("")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """The name up to its first dot."""
    return F.substring_index(name, ".", 1)


def standardize(
    df: DataFrame,
    langs: list[str],
    dataset_name: Column | str = C.DEFAULT_DATASET_NAME,
    dataset_path: Column | str = "",
    file_path: Column | None = None,
    detected: Column | None = None,
    exclude: tuple[str, ...] = (),
    min_lang_chars: int = 0,
) -> DataFrame:
    """Cleaned record plus ``text`` = full text and the six core fields.

    ``exclude`` names columns that are not record data, such as the one ``file_path``
    or ``detected`` is built from.
    """
    data = [f.name for f in _data_fields(df, exclude)]
    cleaned = clean(df, exclude)

    def constant(value):
        return F.lit(value) if isinstance(value, str) else value

    path = F.lit("") if file_path is None else file_path
    with_text = cleaned.withColumn("_full_text", full_text(cleaned, data))
    core = {
        "_dataset_name": F.coalesce(constant(dataset_name), F.lit(C.DEFAULT_DATASET_NAME)),
        "_dataset_path": F.coalesce(constant(dataset_path), F.lit("")),
        "_subpath": subpath_of(path, F.coalesce(constant(dataset_path), F.lit(""))),
        "_filename": file_name(path),
        "_lang": choose_language(lang_sample(cleaned, data), langs, detected, min_lang_chars),
        "_id_hash": id_hash(F.col("_full_text")),
    }
    return with_text.withColumns(core)


def reread(df: DataFrame) -> DataFrame:
    """Adapter for standard records read back: ``text`` joins every non-core value with a
    trailing space each, ``id`` is the stored hash or the hash of that text."""
    fields = _data_fields(df, C.CORE_COLUMNS)
    pieces = [F.coalesce(as_text(f), F.lit("None")) for f in fields]
    text = F.concat(F.concat_ws(" ", *pieces), F.lit(" ")) if pieces else F.lit("")
    stored = F.col("_id_hash") if "_id_hash" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("_reread_text", text)
    return out.withColumn("_reread_id", F.coalesce(stored, F.sha2(F.col("_reread_text"), 256)))


def truncate_value(value: Column, data_type: t.DataType, limit: int | None) -> Column:
    if isinstance(data_type, t.StringType):
        return value if limit is None else F.substring(value, 1, limit)
    if isinstance(data_type, t.ArrayType):
        inner = data_type.elementType
        return F.transform(value, lambda x: truncate_value(x, inner, limit))
    if isinstance(data_type, t.StructType):
        flat = _flat_fields(value, data_type, limit)
        return F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c in flat.items()]))
    return value


def _flat_fields(value: Column | None, struct: t.StructType, limit: int | None) -> dict[str, Column]:
    """Fields of a struct with nested structs spliced in; a later name replaces an earlier one."""
    out: dict[str, Column] = {}
    for f in struct.fields:
        item = F.col(f"`{f.name}`") if value is None else value[f.name]
        if isinstance(f.dataType, t.StructType):
            for name, column in _flat_fields(item, f.dataType, limit).items():
                out.pop(name, None)
                out[name] = column
        else:
            out[f.name] = truncate_value(item, f.dataType, limit)
    return out


def truncate_and_flatten(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Nested objects spliced into columns; strings are cut only if a limit is given."""
    return df.select(*[c.alias(n) for n, c in _flat_fields(None, df.schema, limit).items()])


def rebase_path(path: Column, prefixes: list[tuple[str, str]], scheme: str = "file://") -> Column:
    """Swap the first matching layer prefix; a leading scheme is kept.

    The last pair is the base path and is also replaced when it occurs further inside.
    """
    had_scheme = F.startswith(path, F.lit(scheme))
    bare = F.when(had_scheme, F.substr(path, F.lit(len(scheme) + 1))).otherwise(path)
    result = F.lit(None).cast("string")
    for source, target in reversed(prefixes):
        swapped = F.concat(F.lit(target), F.substr(bare, F.lit(len(source) + 1)))
        result = F.when(F.startswith(bare, F.lit(source)), swapped).otherwise(result)
    base_source, base_target = prefixes[-1]
    result = F.coalesce(result, F.replace(bare, F.lit(base_source), F.lit(base_target)))
    return F.when(had_scheme, F.concat(F.lit(scheme), result)).otherwise(result)


def step_from_uri(uri: Column, prefixes: list[tuple[str, int]], current: Column) -> Column:
    """Step of the first configured prefix the URI contains, else the current step."""
    step = current
    for prefix, value in reversed(prefixes):
        step = F.when(F.contains(uri, F.lit(prefix)), F.lit(value)).otherwise(step)
    return step


def rewrite_subpath(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """``append`` keeps the first segment and adds the folder; ``replace`` sets the folder.
    A record without the field gets it."""
    folder = folder.strip()
    if mode == "append" and "_subpath" in df.columns:
        value = F.concat(F.split_part(F.col("_subpath"), F.lit("/"), F.lit(1)), F.lit(f"/{folder}"))
    else:
        value = F.lit(folder)
    return df.withColumn("_subpath", value)
