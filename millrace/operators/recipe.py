"""Training mixes: replica splitting, down-sampling, contracts and the training table.

An entry has ``dist_id, uri, name, replica, samples, tokens, words, chat_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.catalog import upsert
from millrace.operators.profile import scaled_totals
from millrace.operators.relate import ancestors
from millrace.operators.sampling import hash_number, sampled
from millrace.session import broadcast_if_small

COUNTS = ("samples", "tokens", "words")


def _whole(column: Column, factor: Column) -> Column:
    """Floating product truncated, as contracts have always been counted."""
    return (column.cast("double") * factor.cast("double")).cast("long")


def split_replicas(entries: DataFrame) -> DataFrame:
    """An integer part and a fractional part per entry; absent parts give no row.

    Counts describe the source; ``scaled_*`` multiplies them by the part's replica and truncates.
    """
    replica = F.col("replica").cast("decimal(10,4)")
    whole = F.floor(replica)
    fraction = F.round(replica - whole, 2)
    parts = F.array_compact(
        F.array(
            F.when(whole >= 1, F.struct(F.lit("integer").alias("part"), whole.cast("decimal(10,4)").alias("replica"))),
            F.when(replica % 1 != 0, F.struct(F.lit("fraction").alias("part"), F.when(replica < 1, replica).otherwise(fraction).cast("decimal(10,4)").alias("replica"))),
        )
    )
    out = entries.withColumn("_p", F.explode(parts)).withColumns({"part": F.col("_p.part"), "replica": F.col("_p.replica")}).drop("_p")
    return out.withColumns({f"scaled_{c}": _whole(F.col(c), F.col("replica")) for c in COUNTS})


def unit_counts(entries: DataFrame) -> DataFrame:
    """Counts of a single replica again."""
    replica = F.col("replica").cast("double")
    unit = {c: F.when(replica > 0, F.try_divide(F.col(c).cast("double"), replica).cast("long")).otherwise(F.col(c)) for c in COUNTS}
    return entries.withColumns(unit)


def _rate_text(rate: Column) -> Column:
    return rate.cast("double").cast("string")


def sample_target(uri: Column, rate: Column) -> Column:
    """Folder of the down-sampled copy, next to its source."""
    leaf = F.element_at(F.split(uri, "/"), -1)
    parent = F.regexp_replace(uri, r"/[^/]*\z", "")
    return F.concat(parent, F.lit("/downsampled__"), _rate_text(rate), F.lit("__"), leaf)


def downsample_plan(fractions: DataFrame, catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do for each fractional entry: write files, register them, or nothing."""
    planned = fractions.select(
        F.col("dist_id").alias("derived_from"),
        sample_target(F.col("uri"), F.col("replica")).alias("uri"),
        F.concat(F.lit("downsampled__"), F.format_string("%.2f", F.col("replica").cast("double")), F.lit("__"), F.col("name")).alias("name"),
        F.col("replica").alias("rate"),
    )
    known = catalog.select("uri").distinct().withColumn("_known", F.lit(True))
    present = listing.select(F.explode(ancestors("path")).alias("uri")).distinct().withColumn("_present", F.lit(True))
    action = (
        F.when(F.col("_present") & F.col("_known"), "skip").when(F.col("_present"), "register").otherwise("materialize")
    )
    return planned.join(known, "uri", "left").join(present, "uri", "left").withColumn("action", action).drop("_known", "_present")


def merge_parts(integers: DataFrame, materialized: DataFrame, key: str = "dist_id") -> DataFrame:
    """Union by key in which the materialised entry replaces the integer one."""
    left = integers.join(materialized.select(key), key, "left_anti")
    return left.unionByName(materialized, allowMissingColumns=True)


def export_entries(entries: DataFrame) -> DataFrame:
    """``(uri, entry)`` with the contract of each entry as JSON, counts per single replica."""
    unit = unit_counts(entries)
    fields = [c for c in ("dist_id", "name", "chat_type", "replica", *COUNTS) if c in unit.columns]
    columns = [F.col(c).cast("double").alias(c) if c == "replica" else F.col(c) for c in fields]
    return unit.select("uri", F.to_json(F.struct(*columns)).alias("entry"))


def entry_errors(entries: DataFrame) -> DataFrame:
    """Errors of an uploaded contract: missing fields and prompt lists of unequal length."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("dist_id", "chat_type", "replica")]
    sizes = F.coalesce(F.size("system_prompt"), F.lit(0)) != F.coalesce(F.size("system_prompt_name"), F.lit(0))
    checks.append(F.when(sizes, F.lit("prompt lists differ in length")))
    return entries.withColumn("errors", F.array_compact(F.array(*checks)))


def strategy_rows(entries: DataFrame, recipe_id: Column) -> DataFrame:
    """Stored form of the entries of a recipe."""
    return entries.select(
        F.sha2(F.concat_ws("|", recipe_id, "dist_id"), 256).alias("id"), recipe_id.alias("recipe_id"),
        F.col("dist_id").alias("distribution_id"), F.col("replica").alias("replication_factor"), F.col("chat_type").alias("template_strategy"),
    )


def prompt_links(entries: DataFrame, recipe_id: Column) -> DataFrame:
    named = entries.select(F.sha2(F.concat_ws("|", recipe_id, "dist_id"), 256).alias("strategy_id"), F.explode("system_prompt_name").alias("system_prompt_name"))
    return named.distinct()


def import_decisions(incoming: DataFrame, recipes: DataFrame) -> DataFrame:
    """How each uploaded recipe enters the catalog.

    A known id makes a derived recipe, with a suffix when its name is taken; a known name
    without id updates; anything else is new.
    """
    by_id = recipes.select("id").withColumn("_by_id", F.lit(True))
    by_name = recipes.select("name", F.col("id").alias("_name_id"))
    joined = incoming.join(by_id, "id", "left").join(by_name, "name", "left")
    known, taken = F.coalesce("_by_id", F.lit(False)), F.col("_name_id").isNotNull()
    action = F.when(known, "derive").when(taken & F.col("id").isNull(), "update").otherwise("insert")
    suffixed = F.concat_ws("_", "name", F.substring(F.sha2("name", 256), 1, 6))
    return joined.select(
        "id", F.when(known & taken, suffixed).otherwise(F.col("name")).alias("name"), action.alias("action"),
        F.when(known, F.col("id")).alias("derived_from"), F.when(action == "update", F.col("_name_id")).alias("target_id"),
    )


def unresolved_entries(entries: DataFrame, distributions: DataFrame) -> DataFrame:
    """Entries that name a distribution the catalog does not have."""
    return entries.join(distributions.select(F.col("id").alias("dist_id")), "dist_id", "left_anti")


def missing_prompts(entries: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts to create: named by an entry and unknown so far, the first text per name."""
    pairs = entries.select(F.explode(F.arrays_zip("system_prompt_name", "system_prompt")).alias("p")).select(
        F.col("p.system_prompt_name").alias("name"), F.col("p.system_prompt").alias("prompt")
    )
    fresh = pairs.join(prompts.select("name"), "name", "left_anti").groupBy("name").agg(F.min("prompt").alias("prompt"))
    return fresh.withColumns({"length": F.length("prompt"), "_lang": F.lit("un")})


def edit_strategies(strategies: DataFrame, edits: DataFrame, removed: DataFrame) -> DataFrame:
    """New snapshot with changed factors and types and without the removed rows."""
    kept = strategies.join(removed.select("id"), "id", "left_anti")
    return upsert(kept, edits.join(kept.select("id"), "id", "left_semi"), "id")


def replace_links(links: DataFrame, edited: DataFrame, new_links: DataFrame) -> DataFrame:
    return links.join(edited.select(F.col("id").alias("strategy_id")), "strategy_id", "left_anti").unionByName(new_links)


def derive_recipes(recipes: DataFrame, convention: str = "derived") -> DataFrame:
    """New recipes that derive from given ones: marked name and description, scope and tasks kept,
    the convention added to the tags unless it is among them."""
    tags, tasks = (F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "tasks"))
    label = F.concat(F.lit(f"[{convention.upper()}] "), F.coalesce("description", F.lit("None")))
    return recipes.select(
        F.concat(F.lit(f"{convention}__"), "name").alias("name"), label.alias("description"), "scope", tasks.alias("tasks"),
        F.when(F.array_contains(tags, convention), tags).otherwise(F.array_append(tags, F.lit(convention))).alias("tags"),
        F.col("id").alias("derived_from"),
    )


def recipe_bag(strategies: DataFrame, distributions: DataFrame, datasets: DataFrame, cards: DataFrame) -> DataFrame:
    """Strategies with their distribution, dataset and card; the card by id, else by name."""
    dist = distributions.select(F.col("id").alias("distribution_id"), F.col("uri").alias("dist_uri"), "dataset_id", "lang")
    owner = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "derived_card")
    by_id = cards.select(F.col("id").alias("derived_card"), F.col("dataset_name").alias("_card_by_id"))
    by_name = cards.select(F.col("dataset_name").alias("dataset_name")).withColumn("_card_by_name", F.col("dataset_name"))
    joined = strategies.join(dist, "distribution_id").join(owner, "dataset_id")
    joined = joined.join(by_id, "derived_card", "left").join(by_name, "dataset_name", "left")
    card = F.when(F.col("derived_card").isNotNull(), F.col("_card_by_id")).otherwise(F.col("_card_by_name"))
    return joined.withColumn("card_name", card).drop("_card_by_id", "_card_by_name")


def prefilled(bag: DataFrame) -> DataFrame:
    """``(recipe_id, dist_uri, replication_factor, template_strategy)``: what the entries of a recipe
    are filled with when it is taken up again."""
    return bag.select("recipe_id", "dist_uri", "replication_factor", F.col("chat_type").alias("template_strategy")).distinct()


def bag_prompts(bag: DataFrame, links: DataFrame) -> DataFrame:
    """``(recipe_id, dist_uri, system_prompt_name)`` from the prompt links of the bag's strategies."""
    return bag.select(F.col("id").alias("strategy_id"), "recipe_id", "dist_uri").join(links, "strategy_id").select("recipe_id", "dist_uri", "system_prompt_name")


def bag_children(bag: DataFrame, composition: DataFrame) -> DataFrame:
    """``(recipe_id, dataset_name, card_name, child_card_name)``: the cards that the cards of a
    recipe's datasets are composed of. Cards of a recipe are reduced to distinct ones before the join,
    so a card with many distributions costs one row."""
    cards = bag.filter("card_name IS NOT NULL").select("recipe_id", "dataset_name", "card_name").distinct()
    return cards.join(composition.select(F.col("parent_card_name").alias("card_name"), "child_card_name"), "card_name")


def store_recipe(recipes: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipes by name or new: the catalog with the ``incoming`` ones whose name it does not have, and
    ``(name, recipe_id)`` of all incoming names. A known recipe is left as it is; among equal new
    names the one with the smallest description is inserted."""
    known = recipes.select("name", F.col("id").alias("_known"))
    first = incoming.groupBy("name").agg(F.min(F.struct(*[c for c in ("description", "scope") if c in incoming.columns])).alias("_row"))
    placed = first.join(known, "name", "left").withColumn("recipe_id", F.coalesce("_known", F.concat(F.lit("rec-"), F.substring(F.sha2("name", 256), 1, 16))))
    fresh = placed.filter("_known IS NULL").select(F.col("recipe_id").alias("id"), "name", "_row.*")
    return recipes.unionByName(fresh, allowMissingColumns=True), placed.select("name", "recipe_id")


def export_totals(entries: DataFrame) -> DataFrame:
    """One row with the entries of a recipe and its samples, tokens and words, replicas counted."""
    scaled = scaled_totals(unit_counts(entries).withColumn("all", F.lit(1)), ["all"])
    return scaled.join(entries.agg(F.count("*").alias("entries"))).drop("all")


def training_table(
    records: DataFrame,
    entries: DataFrame,
    by: list[str],
    key: str = "_id_hash",
    seed: int | str = 0,
    prompts: str | None = None,
) -> DataFrame:
    """Execute a mix: whole copies by repetition, the fractional part by hash sample, one of
    the entry's prompts per record. One pass over the records; the entries are broadcast
    while they are small."""
    columns = [*by, "replica"] + ([prompts] if prompts else [])
    joined = records.join(broadcast_if_small(entries.select(*columns)), by)
    replica = F.col("replica").cast("decimal(10,4)")
    whole = F.floor(replica).cast("int")
    extra = F.when(sampled(key, replica - whole, seed), 1).otherwise(0)
    counted = joined.withColumn("_copies", whole + extra).filter("_copies > 0")
    if prompts:
        pick = (hash_number(key, f"{seed}/prompt") % F.greatest(F.size(prompts), F.lit(1))).cast("int")
        counted = counted.withColumn("system_prompt", F.get(prompts, pick)).drop(prompts)
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "replica")
