"""Training mixes over the derived catalog and over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.naming import compact_sql
from millrace.operators import recipe as R
from millrace.operators.profile import scaled_totals
from millrace.operators.sampling import hash_sample
from millrace.plans.catalog import STRATEGY, strategies
from millrace.plans.catalog_frames import cte, frame
from millrace.session import read_table
from millrace.plans.round_trip import scratch
from millrace.sources.sinks import derived_distribution, write_export

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def entries(spark, sf_dir):
    """Mapped distributions as entries of a mix."""
    return frame(spark, sf_dir, "distribution").filter("step = 3").select(
        F.col("id").alias("dist_id"), "uri", "name", F.col("factor").alias("replica"), "samples", "tokens", "words", "chat_type", "dataset_id", "lang", "part",
    )


_ENTRIES = cte("distribution") + (
    ", entries AS (SELECT id AS dist_id, uri, name, CAST(factor AS DECIMAL(10,4)) AS replica, samples, tokens, words, chat_type, dataset_id, lang, part FROM distribution WHERE step = 3)"
)
_PARTS = (
    "parts AS (SELECT *, 'integer' AS part_kind, CAST(floor(replica) AS DECIMAL(10,4)) AS r FROM entries WHERE replica >= 1 UNION ALL "
    "SELECT *, 'fraction', CAST(CASE WHEN replica < 1 THEN replica ELSE round(replica - floor(replica), 2) END AS DECIMAL(10,4)) FROM entries WHERE replica % 1 <> 0)"
)


def _split(spark, sf_dir):
    out = R.split_replicas(entries(spark, sf_dir))
    return out.select("dist_id", "part", F.col("replica").cast("double").alias("replica"), "samples", "scaled_samples", "scaled_tokens", "scaled_words")


_register(
    "r01_split_replicas", lambda s, d: _split(s, d),
    f"WITH {_ENTRIES}, {_PARTS} SELECT dist_id, part_kind AS part, CAST(r AS DOUBLE) AS replica, samples, CAST(trunc(CAST(samples AS DOUBLE) * CAST(r AS DOUBLE)) AS BIGINT) AS scaled_samples, "
    "CAST(trunc(CAST(tokens AS DOUBLE) * CAST(r AS DOUBLE)) AS BIGINT) AS scaled_tokens, CAST(trunc(CAST(words AS DOUBLE) * CAST(r AS DOUBLE)) AS BIGINT) AS scaled_words FROM parts",
)
_register(
    "r02_unit_counts", lambda s, d: R.unit_counts(entries(s, d)).select("dist_id", "samples", "tokens", "words"),
    f"WITH {_ENTRIES} SELECT dist_id, CAST(trunc(CAST(samples AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS samples, "
    "CAST(trunc(CAST(tokens AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS tokens, CAST(trunc(CAST(words AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS words FROM entries",
)


def _plan(spark, sf_dir):
    parts = R.split_replicas(entries(spark, sf_dir)).filter("part = 'fraction'")
    source = entries(spark, sf_dir).select("dist_id", F.col("part").alias("k")).join(parts.drop("part"), "dist_id")
    targets = source.select(R.sample_target(F.col("uri"), F.col("replica")).alias("uri"), "k")
    catalog = targets.filter("k % 3 = 0")
    listing = targets.filter("k % 2 = 0").select(F.concat("uri", F.lit("/downsampled__data_0.parquet")).alias("path"))
    out = R.downsample_plan(parts, catalog, listing)
    return out.select("derived_from", "uri", "name", F.col("rate").cast("double").alias("rate"), "action")


_register(
    "r03_downsample_plan", _plan,
    f"WITH {_ENTRIES}, {_PARTS} SELECT dist_id AS derived_from, regexp_replace(uri, '/[^/]*$', '') || '/downsampled__' || CAST(CAST(r AS DOUBLE) AS VARCHAR) || '__' || "
    "string_split(uri, '/')[-1] AS uri, 'downsampled__' || printf('%.2f', CAST(r AS DOUBLE)) || '__' || name AS name, CAST(r AS DOUBLE) AS rate, "
    "CASE WHEN part % 6 = 0 THEN 'skip' WHEN part % 2 = 0 THEN 'register' ELSE 'materialize' END AS action FROM parts WHERE part_kind = 'fraction'",
)


def _merged(spark, sf_dir):
    parts = R.split_replicas(entries(spark, sf_dir))
    whole = parts.filter("part = 'integer'").select("dist_id", "part", "scaled_samples")
    sampled = parts.filter("part = 'fraction'").select("dist_id", "part", "scaled_samples")
    return R.merge_parts(whole, sampled)


_register(
    "u02_recipe_merge", _merged,
    f"WITH {_ENTRIES}, {_PARTS} SELECT dist_id, part_kind AS part, CAST(trunc(CAST(samples AS DOUBLE) * CAST(r AS DOUBLE)) AS BIGINT) AS scaled_samples FROM parts "
    "QUALIFY row_number() OVER (PARTITION BY dist_id ORDER BY part_kind) = 1",
)


def _exported(spark, sf_dir):
    return R.export_entries(entries(spark, sf_dir))


_register(
    "r04_export", lambda s, d: _exported(s, d).select(
        "uri", F.get_json_object("entry", "$.dist_id").alias("dist_id"), F.get_json_object("entry", "$.samples").cast("long").alias("samples"),
        F.get_json_object("entry", "$.chat_type").alias("chat_type"), F.get_json_object("entry", "$.replica").cast("double").alias("replica"),
    ),
    f"WITH {_ENTRIES} SELECT uri, dist_id, CAST(trunc(CAST(samples AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS samples, chat_type, CAST(replica AS DOUBLE) AS replica FROM entries",
)


def _with_prompts(spark, sf_dir):
    k = F.col("part")
    names = F.when(k % 2 == 0, F.array(F.concat(F.lit("p"), (k % 5).cast("string")), F.concat(F.lit("q"), (k % 3).cast("string"))))
    texts = F.when(k % 2 == 0, F.when(k % 7 == 0, F.array(F.lit("only one"))).otherwise(F.array(F.lit("be brief"), F.concat(F.lit("be "), "lang"))))
    return entries(spark, sf_dir).withColumns({"system_prompt_name": names, "system_prompt": texts})


def _stored(spark, sf_dir):
    rows = _with_prompts(spark, sf_dir)
    recipe = F.lit("rec-new")
    stored = R.strategy_rows(rows, recipe).select("id", "distribution_id", F.col("replication_factor").cast("double").alias("replication_factor"), "template_strategy")
    links = R.prompt_links(rows, recipe).groupBy(F.col("strategy_id").alias("id")).agg(F.count("*").alias("prompts"))
    return stored.join(links, "id", "left").select("distribution_id", "replication_factor", "template_strategy", F.coalesce("prompts", F.lit(0)).alias("prompts"))


_register(
    "r05_recipe_store", _stored,
    f"WITH {_ENTRIES} SELECT dist_id AS distribution_id, CAST(replica AS DOUBLE) AS replication_factor, chat_type AS template_strategy, CASE WHEN part % 2 = 0 THEN 2 ELSE 0 END AS prompts FROM entries",
)


def _uploads(spark, sf_dir):
    recipes = frame(spark, sf_dir, "recipe").withColumn("k", F.expr("CAST(substring(id, 5) AS BIGINT)"))
    return recipes.selectExpr(
        "CASE k % 4 WHEN 0 THEN id WHEN 1 THEN 'rec-unknown-' || id WHEN 2 THEN NULL ELSE id END AS id",
        "CASE k % 4 WHEN 3 THEN name || ' fresh' ELSE CASE WHEN k % 8 = 2 THEN name || ' brand new' ELSE name END END AS name",
    )


_register(
    "r06_import_decisions", lambda s, d: R.import_decisions(_uploads(s, d), frame(s, d, "recipe")),
    f"WITH {cte('recipe')}, u AS (SELECT *, CAST(substring(id, 5) AS BIGINT) AS k FROM recipe) SELECT CASE k % 4 WHEN 0 THEN id WHEN 1 THEN 'rec-unknown-' || id WHEN 3 THEN id END AS id, "
    "CASE k % 4 WHEN 0 THEN name || '_' || substring(sha256(name), 1, 6) WHEN 3 THEN name || ' fresh' ELSE CASE WHEN k % 8 = 2 THEN name || ' brand new' ELSE name END END AS name, "
    "CASE WHEN k % 4 IN (0, 3) THEN 'derive' WHEN k % 8 = 6 THEN 'update' ELSE 'insert' END AS action, CASE WHEN k % 4 IN (0, 3) THEN id END AS derived_from, "
    "CASE WHEN k % 8 = 6 THEN id END AS target_id FROM u",
)


def _import_problems(spark, sf_dir):
    rows = _with_prompts(spark, sf_dir)
    lost = R.unresolved_entries(rows, frame(spark, sf_dir, "distribution").filter("part % 9 <> 0")).select(F.lit("distribution").alias("kind"), F.col("dist_id").alias("name"))
    fresh = R.missing_prompts(rows, spark_names(spark, sf_dir)).select(F.lit("prompt").alias("kind"), "name")
    return lost.unionByName(fresh)


def spark_names(spark, sf_dir):
    """Known prompt names: one per fifth part."""
    return read_table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("name")).distinct()


_register(
    "r06_import_problems", _import_problems,
    f"WITH {_ENTRIES} SELECT 'distribution' AS kind, dist_id AS name FROM entries WHERE part % 9 = 0 UNION ALL "
    "SELECT DISTINCT 'prompt', name FROM (SELECT 'p' || CAST(part % 5 AS STRING) AS name FROM entries WHERE part % 2 = 0 UNION SELECT 'q' || CAST(part % 3 AS STRING) FROM entries WHERE part % 2 = 0) "
    "WHERE name NOT IN (SELECT 'p' || CAST(p_partkey % 3 AS STRING) FROM part)",
)


def _contract_errors(spark, sf_dir):
    rows = R.entry_errors(_with_prompts(spark, sf_dir))
    return rows.select("dist_id", F.array_join("errors", ";").alias("errors"))


_register(
    "v04_contract_errors", _contract_errors,
    f"WITH {_ENTRIES} SELECT dist_id, concat_ws(';', CASE WHEN chat_type IS NULL THEN 'chat_type is missing' END, CASE WHEN part % 14 = 0 THEN 'prompt lists differ in length' END) AS errors FROM entries",
)


def _edited(spark, sf_dir):
    rows = strategies(spark, sf_dir)
    edits = rows.filter("part % 5 = 0").select("id", (F.col("replication_factor") + 1).cast("decimal(6,2)").alias("replication_factor"), F.lit("think_chat").alias("chat_type"))
    out = R.edit_strategies(rows, edits, rows.filter("part % 7 = 0"))
    return out.select("id", "distribution_id", F.col("replication_factor").cast("double").alias("replication_factor"), "chat_type")


_register(
    "r07_recipe_edit", _edited,
    f"WITH {cte('distribution')}, {STRATEGY} SELECT id, distribution_id, CAST(replication_factor + CASE WHEN part % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS replication_factor, "
    "CASE WHEN part % 5 = 0 THEN 'think_chat' ELSE chat_type END AS chat_type FROM strategy WHERE part % 7 <> 0",
)
def _derived(spark, sf_dir):
    """Half of the recipes carry the tag already, as after an earlier derivation; one scope has no tasks."""
    sft = F.col("scope") == "sft"
    recipes = frame(spark, sf_dir, "recipe").withColumns({
        "tags": F.when(sft, F.array_append("tags", F.lit("derived"))).otherwise(F.col("tags")),
        "tasks": F.when(sft, F.array(F.lit("qa"), F.lit("chat"))),
    })
    out = R.derive_recipes(recipes)
    return out.withColumns({c: F.array_join(c, ",") for c in ("tags", "tasks")})


_register(
    "r08_derive_recipe", _derived,
    f"WITH {cte('recipe')} SELECT 'derived__' || name AS name, '[DERIVED] ' || description AS description, scope, "
    "CASE WHEN scope = 'sft' THEN 'qa,chat' ELSE '' END AS tasks, array_to_string(tags, ',') || ',derived' AS tags, id AS derived_from FROM recipe",
)


def _bag(spark, sf_dir):
    datasets = frame(spark, sf_dir, "dataset").withColumn("derived_card", F.when(F.col("step") != 1, F.col("derived_card")))
    cards = frame(spark, sf_dir, "card")
    out = R.recipe_bag(strategies(spark, sf_dir), frame(spark, sf_dir, "distribution"), datasets, cards)
    return out.select("recipe_id", "id", "distribution_id", "dataset_id", "card_name")


_register(
    "j12_recipe_bag", _bag,
    f"WITH {cte('distribution', 'dataset', 'card')}, {STRATEGY}, ds AS (SELECT id, name, CASE WHEN step <> 1 THEN derived_card END AS derived_card FROM dataset) "
    "SELECT s.recipe_id, s.id, s.distribution_id, x.dataset_id, CASE WHEN ds.derived_card IS NOT NULL THEN c.dataset_name ELSE n.dataset_name END AS card_name FROM strategy s "
    "JOIN distribution x ON x.id = s.distribution_id JOIN ds ON ds.id = x.dataset_id LEFT JOIN card c ON c.id = ds.derived_card LEFT JOIN card n ON n.dataset_name = ds.name",
)


def _task_mix(spark, sf_dir):
    """Samples by the first task of the card behind each entry."""
    dataset = frame(spark, sf_dir, "dataset").select(F.col("id").alias("dataset_id"), F.col("derived_card").alias("card_id"))
    tasks = frame(spark, sf_dir, "card").select(F.col("id").alias("card_id"), F.get("tasks", F.lit(0)).alias("task"))
    joined = entries(spark, sf_dir).join(dataset, "dataset_id").join(tasks, "card_id").filter("task is not null")
    return scaled_totals(joined, ["task"], truncate=False).select("task", F.round(F.col("samples").cast("double"), 2).alias("samples"))


_register(
    "a07_task_mix", _task_mix,
    f"WITH {_ENTRIES}, {cte('dataset', 'card')} SELECT c.tasks[1] AS task, round(CAST(sum(samples * replica) AS DOUBLE), 2) AS samples FROM entries e JOIN dataset d ON d.id = e.dataset_id "
    "JOIN card c ON c.id = d.derived_card WHERE c.tasks IS NOT NULL GROUP BY 1",
)
_RATE_HASH = "('0x' || substr(sha256(CAST({0} AS VARCHAR) || '|{1}'), 1, 8))::BIGINT"
_register(
    "w09_hash_sample", lambda s, d: hash_sample(read_table(s, d, "documents"), "doc_id", 0.3, 7).select("doc_id", "source"),
    f"SELECT doc_id, source FROM documents WHERE {_RATE_HASH.format('doc_id', 7)} < 0.3 * 4294967296",
)


def _training(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("chars"))
    mix = docs.select("source", "lang").distinct().withColumns({
        "replica": F.expr("CAST((length(source) + length(lang)) * 0.35 AS DECIMAL(10,4))"),
        "prompts": F.expr("CASE WHEN lang = 'en' THEN split('be brief,be kind,be exact', ',') WHEN lang = 'fr' THEN split('soyez bref', ',') END"),
    })
    return R.training_table(docs, mix, ["source", "lang"], "doc_id", 11, "prompts")


_REP = "CAST((length(source) + length(lang)) * 0.35 AS DECIMAL(10,4))"
_PICK = _RATE_HASH.format("doc_id", "11/prompt")
_register(
    "r09_training_table", _training,
    f"WITH c AS (SELECT doc_id, source, lang, length(text) AS chars, CAST(floor({_REP}) AS INT) + CASE WHEN {_RATE_HASH.format('doc_id', 11)} < CAST({_REP} - floor({_REP}) AS DOUBLE) * 4294967296 THEN 1 ELSE 0 END AS n, "
    f"CASE WHEN lang = 'en' THEN ['be brief', 'be kind', 'be exact'][1 + {_PICK} % 3] WHEN lang = 'fr' THEN 'soyez bref' END AS system_prompt FROM documents) "
    "SELECT doc_id, source, lang, chars, system_prompt, CAST(unnest(range(1, n + 1)) AS INT) AS _copy FROM c",
)


def _query_rows(spark, sf_dir):
    """Registered results of saved queries: inherited fields, compact text, and a new dataset outside the parent."""
    dist = frame(spark, sf_dir, "distribution").join(
        frame(spark, sf_dir, "dataset").select(F.col("id").alias("dataset_id"), F.col("uri").alias("dataset_uri")), "dataset_id"
    )
    target = F.concat(F.regexp_replace("uri", r"/[^/]*$", ""), F.lit("/picked"))
    query = F.concat(F.lit("SELECT *\n  FROM\t'"), "uri", F.lit("'\n WHERE  x > 1 "))
    rows = dist.withColumns({"target_uri": target, "executed": compact_sql(query)})
    return derived_distribution(rows, "picked").select("name", "uri", "derived_from", "query", "lang", "license", F.array_join("tags", ",").alias("tags"), "new_dataset")


_register(
    "k09_derived_registration", _query_rows,
    f"WITH {cte('distribution', 'dataset')} SELECT 'query__picked__' || x.name AS name, regexp_replace(x.uri, '/[^/]*$', '') || '/picked' AS uri, x.id AS derived_from, "
    "'SELECT * FROM ''' || x.uri || ''' WHERE x > 1' AS query, x.lang, x.license, array_to_string(x.tags, ',') || ',query' AS tags, "
    "d.uri = x.uri OR NOT starts_with(regexp_replace(x.uri, '/[^/]*$', '') || '/picked', d.uri) AS new_dataset FROM distribution x JOIN dataset d ON d.id = x.dataset_id",
)


# ---- the whole bag, recipes by name, prompt links ------------------------------------------------
def _prompt_links(spark, sf_dir):
    """Links of every strategy of an even part to two prompts."""
    k = F.col("part")
    names = F.array(F.concat(F.lit("p"), (k % 5).cast("string")), F.concat(F.lit("q"), (k % 3).cast("string")))
    return strategies(spark, sf_dir).filter("part % 2 = 0").select(F.col("id").alias("strategy_id"), F.explode(names).alias("system_prompt_name"))


_LINKS = (
    "links AS (SELECT id AS strategy_id, unnest(['p' || CAST(part % 5 AS STRING), 'q' || CAST(part % 3 AS STRING)]) AS system_prompt_name FROM strategy WHERE part % 2 = 0)"
)


def _whole_bag(spark, sf_dir):
    datasets = frame(spark, sf_dir, "dataset").withColumn("derived_card", F.when(F.col("step") != 1, F.col("derived_card")))
    return R.recipe_bag(strategies(spark, sf_dir), frame(spark, sf_dir, "distribution"), datasets, frame(spark, sf_dir, "card"))


_BAG = (
    f"{cte('distribution', 'dataset', 'card', 'composition')}, {STRATEGY}, {_LINKS}, ds AS (SELECT id, name, CASE WHEN step <> 1 THEN derived_card END AS derived_card FROM dataset), "
    "bag AS (SELECT s.*, x.uri AS dist_uri, ds.name AS dataset_name, CASE WHEN ds.derived_card IS NOT NULL THEN c.dataset_name ELSE n.dataset_name END AS card_name FROM strategy s "
    "JOIN distribution x ON x.id = s.distribution_id JOIN ds ON ds.id = x.dataset_id LEFT JOIN card c ON c.id = ds.derived_card LEFT JOIN card n ON n.dataset_name = ds.name)"
)
_register(
    "j12_bag_prompts", lambda s, d: R.bag_prompts(_whole_bag(s, d), _prompt_links(s, d)),
    f"WITH {_BAG} SELECT recipe_id, dist_uri, system_prompt_name FROM bag JOIN links ON strategy_id = id",
)
_register(
    "j12_bag_children", lambda s, d: R.bag_children(_whole_bag(s, d), frame(s, d, "composition")),
    f"WITH {_BAG} SELECT DISTINCT recipe_id, dataset_name, card_name, child_card_name FROM bag JOIN composition ON parent_card_name = card_name",
)
_register(
    "j12_prefilled", lambda s, d: R.prefilled(_whole_bag(s, d)).withColumn("replication_factor", F.col("replication_factor").cast("double")),
    f"WITH {_BAG} SELECT DISTINCT recipe_id, dist_uri, CAST(replication_factor AS DOUBLE) AS replication_factor, chat_type AS template_strategy FROM bag",
)


def _by_name(spark, sf_dir):
    """Every order names a recipe: its customer's number picks a known one or is new."""
    k = F.col("o_custkey")
    orders = read_table(spark, sf_dir, "orders")
    incoming = orders.select(F.concat(F.lit("supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("name"), F.col("o_orderpriority").alias("description"), F.lower("o_orderstatus").alias("scope"))
    catalog, ids = R.store_recipe(frame(spark, sf_dir, "recipe").select("id", "name", "description", "scope"), incoming)
    return catalog.join(ids.withColumn("used", F.lit(True)).withColumnRenamed("recipe_id", "id").drop("name"), "id", "left").select("id", "name", "description", "scope", F.coalesce("used", F.lit(False)).alias("used"))


_register(
    "r05_recipe_by_name", _by_name,
    f"WITH {cte('recipe')}, i AS (SELECT 'supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, o_orderpriority AS description, lower(o_orderstatus) AS scope FROM orders), "
    "f AS (SELECT name, min({'d': description, 's': scope}) AS r FROM i GROUP BY name) "
    "SELECT id, recipe.name, description, scope, f.name IS NOT NULL AS used FROM recipe LEFT JOIN f ON f.name = recipe.name UNION ALL "
    "SELECT 'rec-' || substring(sha256(name), 1, 16), name, r.d, r.s, true FROM f WHERE name NOT IN (SELECT name FROM recipe)",
)


def _relinked(spark, sf_dir):
    """Edited strategies lose their prompts and get new ones; those of removed strategies go."""
    rows, links = strategies(spark, sf_dir), _prompt_links(spark, sf_dir)
    edited = rows.filter("part % 5 = 0")
    fresh = edited.filter("part % 3 = 0").select(F.col("id").alias("strategy_id"), F.concat(F.lit("new "), F.col("part").cast("string")).alias("system_prompt_name"))
    kept = links.join(rows.filter("part % 7 = 0").select(F.col("id").alias("strategy_id")), "strategy_id", "left_anti")
    return R.replace_links(kept, edited, fresh)


_register(
    "r07_prompt_links", _relinked,
    f"WITH {cte('distribution')}, {STRATEGY}, {_LINKS} SELECT strategy_id, system_prompt_name FROM links JOIN strategy ON id = strategy_id WHERE part % 7 <> 0 AND part % 5 <> 0 UNION ALL "
    "SELECT id, 'new ' || CAST(part AS STRING) FROM strategy WHERE part % 5 = 0 AND part % 3 = 0",
)


def _export_totals(spark, sf_dir):
    """The entries written as JSON, read back, beside the totals of the recipe."""
    rows = entries(spark, sf_dir).filter("replica > 0")
    path = scratch(spark)
    write_export(R.export_entries(rows), path)
    back = spark.read.json(path).agg(F.count("*").alias("written"), F.sum(F.get_json_object("entry", "$.samples").cast("long")).alias("unit_samples"))
    return R.export_totals(rows).join(back)


_register(
    "r04_export_totals", _export_totals,
    f"WITH {_ENTRIES}, u AS (SELECT replica, CAST(trunc(CAST(samples AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS samples, CAST(trunc(CAST(tokens AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS tokens, "
    "CAST(trunc(CAST(words AS DOUBLE) / CAST(replica AS DOUBLE)) AS BIGINT) AS words FROM entries WHERE replica > 0) "
    "SELECT CAST(sum(trunc(samples::DOUBLE * replica::DOUBLE)::BIGINT) AS BIGINT) AS samples, CAST(sum(trunc(tokens::DOUBLE * replica::DOUBLE)::BIGINT) AS BIGINT) AS tokens, "
    "CAST(sum(trunc(words::DOUBLE * replica::DOUBLE)::BIGINT) AS BIGINT) AS words, count(*) AS entries, count(*) AS written, CAST(sum(samples) AS BIGINT) AS unit_samples FROM u",
)
