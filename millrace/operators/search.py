"""Searches over catalog frames. Empty criteria do not restrict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*tests: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def mentions(term: str | None, *columns: str) -> Column | None:
    """The term occurs in one of the columns, ignoring case."""
    if not term:
        return None
    tests = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def one_of(column: str, values: list | None) -> Column | None:
    return F.col(column).isin(values) if values else None


def overlaps(column: str, values: list[str] | None) -> Column | None:
    if not values:
        return None
    wanted = F.array(*[F.lit(v) for v in values])
    return F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), wanted)


def search_distributions(df, term=None, langs=None, licenses=None, splits=None) -> DataFrame:
    return df.filter(
        every(mentions(term, "name", "description", "uri"), one_of("lang", langs), one_of("license", licenses), one_of("split", splits))
    )


def search_datasets(df, term=None, langs=None, licenses=None, types=None) -> DataFrame:
    return df.filter(
        every(mentions(term, "name", "description", "uri"), overlaps("languages", langs), one_of("license", licenses), one_of("dataset_type", types))
    )


def search_cards(
    cards: DataFrame,
    composition: DataFrame,
    datasets: DataFrame | None = None,
    term: str | None = None,
    overlap: dict[str, list[str]] | None = None,
    licenses: list[str] | None = None,
    source_type: str | None = None,
    materialized: bool | None = None,
) -> DataFrame:
    """Cards named by the term or holding a child card named by it, and the other criteria."""
    tests = every(
        *[overlaps(c, v) for c, v in (overlap or {}).items()],
        one_of("license", licenses),
        F.col("source_type") == source_type if source_type else None,
    )
    found = cards.filter(tests)
    if term:
        parents = (
            composition.filter(mentions(term, "child_card_name"))
            .select(F.col("parent_card_name").alias("dataset_name")).distinct().withColumn("_by_child", F.lit(True))
        )
        found = found.join(parents, "dataset_name", "left").filter(
            mentions(term, "dataset_name") | F.coalesce("_by_child", F.lit(False))
        ).drop("_by_child")
    if materialized is not None:
        owned = datasets.select(F.col("derived_card").alias("id"))
        found = found.join(owned, "id", "left_semi" if materialized else "left_anti")
    return found


def by_prefix_or_step(df, prefix: str, step: int, materialized: bool | None = None) -> DataFrame:
    test = F.startswith(F.col("uri"), F.lit(prefix)) | (F.col("step") == step)
    return df.filter(every(test, None if materialized is None else F.col("materialized") == materialized))


def search_recipes(df, term=None) -> DataFrame:
    return df.filter(every(mentions(term, "name", "description")))


def admin_search(df, term=None, text=("name", "description"), step=None, lang=None, lang_column="lang") -> DataFrame:
    language = None
    if lang:
        is_list = dict(df.dtypes)[lang_column].startswith("array")
        language = F.array_contains(lang_column, lang) if is_list else F.col(lang_column) == lang
    return df.filter(every(mentions(term, *text), None if step is None else F.col("step") == step, language))


def eligible_for_mix(df, mapped_prefix: str, term=None) -> DataFrame:
    """Distributions a training mix may use: mapped by location or by step."""
    return by_prefix_or_step(df, mapped_prefix, 3).filter(every(mentions(term, "name", "uri")))


def prompt_length() -> Column:
    return F.coalesce(F.nullif(F.col("length"), F.lit(0)), F.length(F.coalesce("prompt", F.lit(""))))


def search_prompts(df, langs=None, term=None, length_range: tuple[int, int] | None = None) -> DataFrame:
    """Language or text when both are given, either alone otherwise; then the length bounds."""
    language, text = one_of("_lang", langs), mentions(term, "name", "description", "prompt")
    if language is not None and text is not None:
        choice = language | text
    else:
        choice = language if language is not None else text
    bounds = prompt_length().between(*length_range) if length_range else None
    return df.filter(every(choice, bounds))


def vocabulary_lookup(df, code=None, description_like=None, term=None) -> DataFrame:
    return df.filter(
        every(
            None if code is None else F.col("code") == code,
            None if description_like is None else F.col("description").ilike(description_like),
            mentions(term, "code", "description"),
        )
    ).orderBy("code")


def active_prompts(df) -> DataFrame:
    return df.filter(~F.col("deleted")).orderBy("name")
