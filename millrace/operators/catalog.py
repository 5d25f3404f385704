"""Catalog integrity as violation queries, and catalog changes as new snapshots."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.naming import entity_name, match_code, next_version
from millrace.functions import text as T
from millrace.operators.relate import ancestors
from millrace.operators.standardize import rebase_path


# ---- keyed snapshots -------------------------------------------------------------------
def upsert(existing: DataFrame, incoming: DataFrame, key: str | list[str]) -> DataFrame:
    """Insert new keys and replace every other column of known ones.

    ``incoming`` holds one row per key and any subset of the columns.
    """
    keys = [key] if isinstance(key, str) else key
    given = [c for c in incoming.columns if c not in keys]
    marked = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given]).withColumn("_given", F.lit(True))
    joined = existing.join(marked, keys, "full_outer")
    taken = F.coalesce("_given", F.lit(False))
    return joined.select(
        *[
            c if c in keys or c not in given else F.when(taken, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            for c in existing.columns
        ]
    )


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the row of every key with the smallest ``order`` values.

    ``min_by`` over the whole row combines map-side, so a key holding a third of the
    rows costs one row per task; no key is sorted in one place.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def changes(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """History rows holding the old values: UPDATE where a tracked column differs, null-safe,
    and DELETE where the key is gone."""
    after = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in tracked]).withColumn("_kept", F.lit(True))
    joined = old.select(key, *tracked).join(after, key, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in tracked])
    gone = F.col("_kept").isNull()
    return joined.filter(gone | differs).select(
        key, *tracked, F.when(gone, "DELETE").otherwise("UPDATE").alias("operation_type")
    )


def soft_delete(df: DataFrame, keys: DataFrame, key: str = "id", flag: str = "deleted") -> DataFrame:
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn(flag, F.coalesce("_gone", flag)).drop("_gone").select(*df.columns)


def bump_versions(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    touched = keys.select(key).distinct().withColumn("_touched", F.lit(True))
    version = F.when(F.col("_touched"), next_version(F.col("version"))).otherwise(F.col("version"))
    return df.join(touched, key, "left").withColumn("version", version).drop("_touched").select(*df.columns)


# ---- violations -------------------------------------------------------------------------
def unknown_codes(df: DataFrame, id_col: str, codes: str, vocabulary: DataFrame, code_col: str = "code") -> DataFrame:
    """Array elements missing from the vocabulary, one row each."""
    listed = df.select(id_col, F.explode(codes).alias("code"))
    return listed.join(vocabulary.select(F.col(code_col).alias("code")), "code", "left_anti").select(id_col, "code")


def incoherent_skills(cards: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Skills of a card that no chosen task admits; ``mix`` on either side passes."""
    none = F.array().cast("array<string>")
    skills, tasks = F.coalesce("core_skills", none), F.coalesce("tasks", none)
    checked = cards.filter((F.size(skills) > 0) & ~F.array_contains(skills, "mix") & ~F.array_contains(tasks, "mix"))
    untasked = checked.filter(F.size(tasks) == 0).select("id", F.explode("core_skills").alias("skill_code"), F.lit("no task").alias("reason"))
    pairs = checked.filter(F.size(tasks) > 0).select("id", F.explode("core_skills").alias("skill_code"), "tasks")
    offered = pairs.select("id", "skill_code", F.explode("tasks").alias("task_code"))
    admitted = offered.join(taxonomy.select("task_code", "skill_code"), ["task_code", "skill_code"], "left_semi")
    refused = pairs.select("id", "skill_code").join(admitted.select("id", "skill_code"), ["id", "skill_code"], "left_anti")
    return untasked.unionByName(refused.withColumn("reason", F.lit("not admissible")))


def step_regressions(df: DataFrame, parent_col: str) -> DataFrame:
    """Rows whose step is below their parent's."""
    parents = df.select(F.col("id").alias(parent_col), F.col("step").alias("parent_step"))
    return df.select("id", parent_col, "step").join(parents, parent_col).filter("step < parent_step")


def misaligned_distributions(distributions: DataFrame, datasets: DataFrame) -> DataFrame:
    owners = datasets.select(F.col("id").alias("dataset_id"), F.col("step").alias("dataset_step"))
    off = distributions.join(owners, "dataset_id").filter("step <> dataset_step").select("id", F.lit("dataset step").alias("reason"))
    return off.unionByName(step_regressions(distributions, "derived_from").select("id", F.lit("parent step").alias("reason")))


def ineligible_strategies(strategies: DataFrame, distributions: DataFrame) -> DataFrame:
    """Strategies on distributions that are not mapped."""
    steps = distributions.filter("step <> 3").select(F.col("id").alias("distribution_id"))
    return strategies.join(steps, "distribution_id", "left_semi")


def protected_cards(cards: DataFrame, datasets: DataFrame) -> DataFrame:
    """Cards that must not be deleted because datasets depend on them."""
    return cards.join(datasets.select(F.col("derived_card").alias("id")), "id", "left_semi")


def delete_impact(ids: DataFrame, references: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """Rows touched by deleting ``ids``; references are ``(table, rows, id, foreign key, action)``."""
    wanted = ids.select(F.col("id").alias("deleted_id"))
    parts = [
        rows.select(F.lit(table).alias("table"), F.col(row_id).alias("id"), F.col(foreign).alias("deleted_id"), F.lit(action).alias("action"))
        .join(wanted, "deleted_id", "left_semi")
        for table, rows, row_id, foreign, action in references
    ]
    return reduce(DataFrame.unionByName, parts).select("table", "id", "deleted_id", "action")


def failed_checks(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """``(id, check)`` of every declared check that a row fails; a null result passes."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()]))
    return df.select(F.col(id_col).alias("id"), F.explode(failed).alias("check"))


# --- Fixed values: patterns of the declared checks ---------------------------------------
URI_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
URL_PATTERN = r"^https?://"
VERSION_PATTERN = r"^[0-9]+\.[0-9]+(\.[0-9]+)?$"


def url_ok(column: str) -> Column:
    return (F.col(column) == "") | F.rlike(column, F.lit(URL_PATTERN))


def card_checks() -> dict[str, Column]:
    return {
        "source_url": url_ok("source_url"),
        "quality": F.col("quality").between(1, 5),
        "languages": F.size("languages") >= 1,
        "core_skills": F.when(F.col("core_skills").isNotNull(), F.size("core_skills") <= 1),
        "tasks": F.when(F.col("tasks").isNotNull(), F.size("tasks") <= 1),
    }


def dataset_checks() -> dict[str, Column]:
    return {
        "uri": F.rlike("uri", F.lit(URI_PATTERN)),
        "version": F.rlike("version", F.lit(VERSION_PATTERN)),
        "step": F.col("step").between(1, 3),
        "languages": F.size("languages") >= 1,
    }


def composition_checks() -> dict[str, Column]:
    return {
        "weight": F.col("weight").between(0, 1),
        "self": F.col("parent_card_name") != F.col("child_card_name"),
    }


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of a unique key that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).filter("rows > 1")


def dangling(df: DataFrame, id_col: str, foreign: str, target: DataFrame, target_key: str = "id") -> DataFrame:
    """Rows whose foreign key points nowhere."""
    keys = target.select(F.col(target_key).alias(foreign))
    return df.filter(F.col(foreign).isNotNull()).join(keys, foreign, "left_anti").select(F.col(id_col).alias("id"), foreign)


# ---- seeding ----------------------------------------------------------------------------
def seed_distributions(df: DataFrame, order: list) -> DataFrame:
    """Seed rows ``(NAME, LANG, QUALITY SCORE, DIR INPUT, dataset_id)`` as mapped distributions.

    A base id that occurs at several locations gets the last path segment in its name.
    """
    code = F.substring(F.lower(F.col("LANG")), 1, 2)
    rows = df.filter(F.coalesce(T.strip(F.col("DIR INPUT")), F.lit("")) != "").select(
        F.col("NAME").alias("title"),
        F.when(code.isin("na", "no") | code.isNull(), F.lit("un")).otherwise(code).alias("iso"),
        F.coalesce(F.col("QUALITY SCORE").cast("string").try_cast("double").cast("int"), F.lit(1)).alias("quality"),
        F.col("DIR INPUT").alias("uri"),
        F.coalesce("dataset_id", "NAME").alias("base"),
        F.struct(*order).alias("_order"),
    )
    kept = first_per_key(rows, ["base", "uri"], ["_order"])
    # A count per base, joined back, instead of a window that sorts a hot base in one task.
    sizes = kept.groupBy("base").agg(F.count("*").alias("locations"))
    leaf = F.element_at(F.split(F.rtrim(F.col("uri"), F.lit("/")), "/"), -1)
    suffix = F.when(F.col("locations") > 1, leaf)
    name = entity_name(F.concat_ws(" ", "iso", "title", suffix))
    identity = entity_name(F.concat_ws(" ", "iso", "base", suffix))
    return kept.join(sizes, "base").select(
        name.alias("name"), "quality", identity.alias("dataset_id"), name.alias("dataset"), "uri", F.lit(3).alias("step"), F.col("iso").alias("lang")
    )


def language_list(raw: Column) -> Column:
    """Two-letter codes or ``multi`` of a comma list, first occurrences kept in order."""
    codes = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: T.strip(F.lower(x)))
    return F.array_distinct(F.filter(codes, lambda x: (x == "multi") | F.rlike(x, F.lit(r"\A[a-z]{2}\z"))))


def first_item(raw: Column) -> Column:
    items = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), T.strip), lambda x: x != "")
    return F.slice(items, 1, 1)


def seed_cards(df: DataFrame, order: list) -> DataFrame:
    """Card seeds cleaned, named and reduced to the first row per id."""
    named = df.withColumns({"dataset_id": entity_name(F.col("dataset_id")), "dataset_name": entity_name(F.col("dataset name"))})
    kept = first_per_key(named.filter("dataset_id <> '' AND dataset_name <> ''"), ["dataset_id"], order)
    return kept.select(
        "dataset_id", "dataset_name",
        (F.coalesce(T.strip(F.col("Reasoning field")), F.lit("")) != "").alias("has_reasoning"),
        language_list(F.col("languages")).alias("languages"),
        F.coalesce(F.nullif(T.strip(F.col("licence")), F.lit("")), F.lit("unknown")).alias("license"),
        first_item(F.col("core skill / capability")).alias("core_skills"),
        first_item(F.col("tasks")).alias("tasks"),
        F.lit("text").alias("modality"),
        F.lit("unknown").alias("source_type"),
    )


def triplet_inserts(incoming: DataFrame, cards: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose card, and whose dataset with distribution, are still to be inserted."""
    new_cards = incoming.join(cards.select(F.col("dataset_id").alias("card_id")), "card_id", "left_anti")
    new_cards = new_cards.join(cards.select(F.col("dataset_name").alias("card_name")), "card_name", "left_anti")
    new_datasets = incoming.join(datasets.select(F.col("name").alias("name")), "name", "left_anti")
    return new_cards, new_datasets


def register_layer(datasets: DataFrame, languages: list[str], layer: str, step: int, extension: str) -> DataFrame:
    """One distribution per dataset and language of a new layer."""
    return datasets.select(
        F.concat(F.lit(f"{layer}__"), "name").alias("dataset"),
        F.concat_ws("/", F.regexp_replace("uri", r"/data/[a-z]+/", f"/data/{layer}/")).alias("dataset_uri"),
        F.explode(F.array(*[F.lit(code) for code in languages])).alias("lang"),
    ).select(
        "dataset",
        F.concat_ws("__", "dataset", "lang").alias("name"),
        F.concat_ws("/", "dataset_uri", "lang").alias("uri"),
        "lang",
        F.lit(f"*{extension}").alias("glob"),
        F.lit(step).alias("step"),
    )


def repair_alignment(distributions: DataFrame, orphans: DataFrame, drop: bool = False) -> DataFrame:
    """Orphans removed, or kept and marked as not materialised."""
    keys = orphans.select("id").distinct()
    if drop:
        return distributions.join(keys, "id", "left_anti")
    marked = keys.withColumn("_orphan", F.lit(True))
    state = F.when(F.col("_orphan"), F.lit(False)).otherwise(F.col("materialized"))
    return distributions.join(marked, "id", "left").withColumn("materialized", state).select(*distributions.columns)


def orphans(distributions: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Materialised distributions without any listed file below their address, at any depth."""
    wanted = distributions.filter("materialized")
    # Only folders as deep as some address can be one; never more depths than the longest address has steps.
    depths = wanted.agg(F.collect_set(F.size(F.split("uri", "/")))).first()[0]
    folders = listing.select(F.explode(ancestors(path_col, depths)).alias("uri")).distinct()
    return wanted.join(folders, "uri", "left_anti")


def upsert_by_address(base: DataFrame, existing: DataFrame, own: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The snapshot with the rows of ``base`` upserted by ``uri`` first and by ``name`` second, and the
    conflicts ``(uri, name, reason)`` of rows that could not be registered. Columns that ``base``
    lacks stay as they are, or null in new rows; a known address keeps its ``own`` columns.

    A known address takes all other columns, the name included. A new address with a known name takes
    over that row, its address included. Names and addresses stay unique: a row is refused with

    * ``repeated``: an earlier row (by address, then name) of the same batch has its address or name,
    * ``name_taken``: its name belongs to another row, or to several, and
    * ``row_taken``: another row of the batch was registered as the row it would take over.
    """
    given = [c for c in existing.columns if c in base.columns]
    # The first row of an address and of a name; both keep one row per key and task.
    first = F.struct("uri", "name", F.xxhash64(*given).alias("h"))
    by_uri = base.groupBy("uri").agg(F.min(first).alias("_first_uri"))
    by_name = base.groupBy("name").agg(F.min(first).alias("_first_name"))
    ranked = base.join(by_uri, "uri").join(by_name, "name").withColumn("_self", first)
    fresh = (F.col("_self") == F.col("_first_uri")) & (F.col("_self") == F.col("_first_name"))
    known = existing.select(F.col("uri").alias("_uri"), F.lit(True).alias("_known")).distinct()
    owners = existing.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_owners"), F.min("uri").alias("_owner"))
    placed = ranked.join(known, F.col("uri") == F.col("_uri"), "left").join(owners, F.col("name") == F.col("_name"), "left")
    alone = F.coalesce(F.col("_owners"), F.lit(0)) == 0
    only = F.coalesce(F.col("_owners"), F.lit(0)) == 1
    at_home = F.col("_known") & (alone | (only & (F.col("_owner") == F.col("uri"))))
    reason = F.when(~fresh, "repeated").when(F.col("_known").isNotNull() & ~F.coalesce(at_home, F.lit(False)), "name_taken")
    reason = reason.when(F.col("_known").isNull() & ~alone & ~only, "name_taken")
    target = F.when(F.col("_known").isNotNull(), F.col("uri")).when(only, F.col("_owner"))
    decided = placed.select(*given, reason.alias("reason"), target.alias("_target"))
    # A row that is updated by its address cannot be taken over by its old name as well.
    taken = decided.filter("reason IS NULL AND _target = uri").select(F.col("_target").alias("_held")).distinct()
    decided = decided.join(taken, (F.col("_target") == F.col("_held")) & (F.col("_target") != F.col("uri")), "left")
    decided = decided.withColumn("reason", F.coalesce("reason", F.when(F.col("_held").isNotNull(), F.lit("row_taken"))))
    accepted = decided.filter("reason IS NULL")
    updates = accepted.filter("_target IS NOT NULL").select(F.col("_target").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = existing.join(updates, F.col("uri") == F.col("_at"), "left")
    hit = F.col("_at").isNotNull()

    def value(c: str) -> Column:
        new = F.when(F.col("_new_uri") == F.col("_at"), F.col(c)).otherwise(F.col(f"_new_{c}")) if c in own else F.col(f"_new_{c}")
        return F.when(hit, new).otherwise(F.col(c)).alias(c)

    kept = joined.select(*[value(c) if c in given else F.col(c) for c in existing.columns])
    inserts = accepted.filter("_target IS NULL").select(*given)
    return kept.unionByName(inserts, allowMissingColumns=True), decided.filter("reason IS NOT NULL").select("uri", "name", "reason")


def register_raw(
    incoming: DataFrame, existing: DataFrame, prefixes: list[tuple[str, str]] = (), globs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw datasets registered by :func:`upsert_by_address`. Addresses are rebased by ``prefixes``
    first, languages default to English, the step is 1. ``globs(uri, globs)`` are the patterns found
    below an address; a known address keeps its own."""
    base = incoming.withColumn("uri", rebase_path(F.col("uri"), list(prefixes)) if prefixes else F.col("uri"))
    base = base.withColumns(
        {"languages": F.coalesce(F.when(F.size("languages") > 0, F.col("languages")), F.array(F.lit("en"))), "step": F.lit(1)}
    )
    if globs is not None:
        base = base.drop("globs").join(globs.select("uri", F.col("globs").alias("_found")), "uri", "left")
        base = base.withColumn("globs", F.coalesce("_found", F.array().cast("array<string>"))).drop("_found")
    return upsert_by_address(base, existing, ("globs",))


def mapped_layer(distributions: DataFrame, datasets: DataFrame, extension: str = ".jsonl.gz") -> tuple[DataFrame, DataFrame]:
    """The datasets and distributions that a mapping of ``distributions`` leaves behind, step 3: named
    after their sources, below the mapped folder, derived from them, with the languages, versions,
    splits and licenses of the sources or what stands for missing ones. Both go through
    :func:`upsert_by_address`, so a mapping that is run again updates what it made before."""
    def moved(uri: Column) -> Column:
        return F.regexp_replace(uri, r"/data/[a-z]+/", "/data/mapped/")

    sources = datasets.join(distributions.select(F.col("dataset_id").alias("id")).distinct(), "id", "left_semi")
    new_datasets = sources.select(
        moved(F.col("uri")).alias("uri"), F.concat(F.lit("mapped__"), "name").alias("name"),
        F.coalesce(F.when(F.size("languages") > 0, F.col("languages")), F.array(F.lit("un"))).alias("languages"),
        "derived_card", F.col("id").alias("derived_dataset"), F.concat(F.lit("Mapped version of "), "name").alias("description"),
        F.coalesce("version", F.lit("1.0")).alias("version"), F.coalesce("license", F.lit("unknown")).alias("license"), F.lit(3).alias("step"),
    )
    new_distributions = distributions.select(
        moved(F.col("uri")).alias("uri"), F.concat(F.lit("mapped__"), "name").alias("name"), F.lit(f"*{extension}").alias("glob"),
        F.coalesce("split", F.lit("unknown")).alias("split"), F.coalesce("license", F.lit("unknown")).alias("license"),
        F.coalesce("lang", F.lit("un")).alias("lang"), F.col("id").alias("derived_from"), F.lit(True).alias("materialized"), F.lit(3).alias("step"),
    )
    return new_datasets, new_distributions


# ---- fuzzy vocabulary match ---------------------------------------------------------------
MATCH_THRESHOLD = 0.65


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def match_vocabulary(raw: DataFrame, raw_col: str, vocabulary: DataFrame, code_col: str = "code") -> DataFrame:
    """``(raw, code, matched, score, reason)`` of every distinct raw label.

    Labels are reduced to distinct codes first; only codes without an exact entry are
    scored, against vocabulary entries whose length allows the threshold at all, which
    is an equi-join on candidate lengths and exact: the ratio never exceeds
    2 * shorter / (a + b).
    """
    labels = raw.select(F.col(raw_col).alias("raw")).distinct().withColumn("code", match_code(F.col("raw")))
    words = vocabulary.select(F.col(code_col).alias("matched")).distinct()
    exact = labels.join(words.select(F.col("matched").alias("code"), F.lit(True).alias("_hit")), "code", "left")
    open_codes = exact.filter("_hit is null and code is not null").select("code").distinct()
    share = MATCH_THRESHOLD / (2 - MATCH_THRESHOLD)
    size = F.length("code")
    reach = F.sequence(F.ceil(size * share).cast("int"), F.floor(size / share).cast("int"))
    reachable = open_codes.select("code", F.explode(reach).alias("_n"))
    pairs = reachable.join(words.withColumn("_n", F.length("matched")), "_n").drop("_n")
    scored = pairs.withColumn("score", match_ratio("code", "matched"))
    # The best score wins; among equals the alphabetically first code.
    best = scored.groupBy("code").agg(F.min(F.struct((-F.col("score")).alias("minus"), "matched")).alias("top")).select(
        "code", F.col("top.matched").alias("matched"), (-F.col("top.minus")).alias("score")
    )
    joined = exact.join(best, "code", "left")
    near = F.coalesce(F.col("score") >= MATCH_THRESHOLD, F.lit(False))
    return joined.select(
        "raw", "code",
        F.when(F.col("_hit"), F.col("code")).when(near, F.col("matched")).alias("matched"),
        F.when(F.col("_hit"), F.lit(1.0)).when(near, F.col("score")).alias("score"),
        F.when(F.col("code").isNull(), "failed_normalization").when(F.col("_hit"), "exact_match")
        .when(near, "similar_match").otherwise("no_match").alias("reason"),
    )


def known_license(column: Column, vocabulary: DataFrame, df: DataFrame) -> DataFrame:
    """License codes outside the vocabulary become ``unknown``."""
    words = vocabulary.select(F.col("code").alias("_known")).distinct()
    return df.join(words, column == F.col("_known"), "left").withColumn("license", F.coalesce("_known", F.lit("unknown"))).drop("_known")
