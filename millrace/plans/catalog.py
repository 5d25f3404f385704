"""Catalog searches, joins, audits and snapshots over frames derived from the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import naming as N
from millrace.operators import catalog as K
from millrace.operators import relate as R
from millrace.operators import search as S
from millrace.operators.adhoc import run_sql
from millrace.plans.catalog_frames import cte, frame
from millrace.plans.sql_text import quote
from millrace.session import read_table

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _with(*names):
    return f"WITH {cte(*names)} "


# ---- searches ------------------------------------------------------------------------------
_register(
    "f06_search_distributions",
    lambda s, d: S.search_distributions(frame(s, d, "distribution"), "A SLICE", ["en", "fr"], ["mit"], ["train", "test"]).select("id"),
    _with("distribution") + "SELECT id FROM distribution WHERE (contains(lower(name), 'a slice') OR contains(lower(description), 'a slice') "
    "OR contains(lower(uri), 'a slice')) AND lang IN ('en', 'fr') AND license IN ('mit') AND split IN ('train', 'test')",
)
_register(
    "f07_search_datasets",
    lambda s, d: S.search_datasets(frame(s, d, "dataset"), "high", ["fr", "de"], ["mit"], ["o", "f"]).select("id"),
    _with("dataset") + "SELECT id FROM dataset WHERE (contains(lower(name), 'high') OR contains(description, 'high') OR contains(lower(uri), 'high')) "
    "AND list_has_any(languages, ['fr', 'de']) AND license = 'mit' AND dataset_type IN ('o', 'f')",
)


def _cards(materialized):
    def run(spark, sf_dir):
        found = S.search_cards(
            frame(spark, sf_dir, "card"), frame(spark, sf_dir, "composition"), frame(spark, sf_dir, "dataset"), "00012",
            {"languages": ["en", "de", "es"], "sources": ["src_1", "src_2", "src_3", "src_0"]}, ["mit", "cc_by", "unknown"], None, materialized,
        )
        return found.select("id", "dataset_name")

    return run


def _cards_sql(extra):
    return _with("card", "composition", "dataset") + (
        "SELECT id, dataset_name FROM card WHERE (contains(dataset_name, '00012') OR EXISTS (SELECT 1 FROM composition c "
        "WHERE c.parent_card_name = card.dataset_name AND contains(c.child_card_name, '00012'))) AND list_has_any(languages, ['en', 'de', 'es']) "
        f"AND list_has_any(sources, ['src_1', 'src_2', 'src_3', 'src_0']) AND license IN ('mit', 'cc_by', 'unknown'){extra}"
    )


_register("f08_search_cards", _cards(None), _cards_sql(""))
_register("f08_cards_materialized", _cards(True), _cards_sql(" AND EXISTS (SELECT 1 FROM dataset d WHERE d.derived_card = card.id)"))
_register(
    "f08_cards_without_data",
    lambda s, d: S.search_cards(
        frame(s, d, "card"), frame(s, d, "composition"), frame(s, d, "dataset").filter("step = 3"), source_type="human", materialized=False,
    ).select("id"),
    _with("card", "dataset") + "SELECT id FROM card WHERE source_type = 'human' AND NOT EXISTS (SELECT 1 FROM dataset d WHERE d.derived_card = card.id AND d.step = 3)",
)
_register(
    "f09_prefix_or_step",
    lambda s, d: S.by_prefix_or_step(frame(s, d, "distribution"), "file:///data/mapped", 2, True).select("id"),
    _with("distribution") + "SELECT id FROM distribution WHERE (uri LIKE 'file:///data/mapped%' OR step = 2) AND materialized",
)
_register(
    "f10_search_recipes", lambda s, d: S.search_recipes(frame(s, d, "recipe"), "Nation 1").select("id", "name"),
    _with("recipe") + "SELECT id, name FROM recipe WHERE contains(name, 'nation 1') OR contains(description, 'nation 1')",
)


def _admin(spark, sf_dir):
    a = S.admin_search(frame(spark, sf_dir, "dataset"), "low", step=2, lang="en", lang_column="languages")
    b = S.admin_search(frame(spark, sf_dir, "distribution"), "n slice", step=2, lang="de")
    return a.select("id").unionByName(b.select("id"))


_register(
    "f11_admin_search", _admin,
    _with("dataset", "distribution") + "SELECT id FROM dataset WHERE (contains(name, 'low') OR contains(description, 'low')) AND step = 2 "
    "AND list_contains(languages, 'en') UNION ALL SELECT id FROM distribution WHERE (contains(name, 'n slice') OR contains(description, 'n slice')) AND step = 2 AND lang = 'de'",
)
_register(
    "f12_mix_eligibility", lambda s, d: S.eligible_for_mix(frame(s, d, "distribution"), "file:///data/mapped", "d12").select("id"),
    _with("distribution") + "SELECT id FROM distribution WHERE (starts_with(uri, 'file:///data/mapped') OR step = 3) AND (contains(name, 'd12') OR contains(uri, 'd12'))",
)


def _prompts(spark, sf_dir):
    prompts = frame(spark, sf_dir, "prompt")
    parts = [
        S.search_prompts(prompts, ["it"], "BRAND#2", (20, 34)).select("id", F.lit("both").alias("kind")),
        S.search_prompts(prompts, ["it"], None, (25, 40)).select("id", F.lit("lang").alias("kind")),
        S.search_prompts(prompts, None, "promo", None).select("id", F.lit("text").alias("kind")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PLEN = "coalesce(nullif(length, 0), length(prompt))"
_register(
    "f13_search_prompts", _prompts,
    _with("prompt") + "SELECT id, 'both' AS kind FROM prompt WHERE (_lang = 'it' OR contains(lower(name), 'brand#2') "
    "OR contains(description, 'brand#2') OR contains(lower(prompt.prompt), 'brand#2')) AND coalesce(nullif(prompt.length, 0), length(prompt.prompt)) BETWEEN 20 AND 34 UNION ALL "
    "SELECT id, 'lang' FROM prompt WHERE _lang = 'it' AND coalesce(nullif(prompt.length, 0), length(prompt.prompt)) BETWEEN 25 AND 40 UNION ALL "
    "SELECT id, 'text' FROM prompt WHERE contains(lower(name), 'promo') OR contains(description, 'promo') OR contains(lower(prompt.prompt), 'promo')",
)


def _vocabulary(spark, sf_dir):
    words = frame(spark, sf_dir, "vocab_skill")
    a = S.vocabulary_lookup(words, description_like="%NUMBER _").select("code", F.lit("like").alias("kind"))
    b = S.vocabulary_lookup(words, code="skill_3").select("code", F.lit("code").alias("kind"))
    c = S.vocabulary_lookup(words, term="Number 2").select("code", F.lit("term").alias("kind"))
    return a.unionByName(b).unionByName(c)


_register(
    "f14_vocabulary_lookup", _vocabulary,
    _with("vocab_skill") + "SELECT code, 'like' AS kind FROM vocab_skill WHERE description ILIKE '%NUMBER _' UNION ALL "
    "SELECT code, 'code' FROM vocab_skill WHERE code = 'skill_3' UNION ALL SELECT code, 'term' FROM vocab_skill WHERE contains(lower(description), 'number 2')",
)
_register(
    "f14_active_prompts", lambda s, d: S.active_prompts(frame(s, d, "prompt")).select("id", "name"),
    _with("prompt") + "SELECT id, name FROM prompt WHERE NOT deleted",
)


# ---- joins -------------------------------------------------------------------------------------
def _listed(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", F.concat(F.lit("fr__ds-"), F.col("o_custkey").cast("string"), F.lit("__"), F.col("o_orderstatus")).alias("listed_id")
    )


_LISTED = "listed AS (SELECT o_orderkey, 'fr__ds-' || CAST(o_custkey AS STRING) || '__' || o_orderstatus AS listed_id FROM orders)"


def _containment(spark, sf_dir):
    cards = frame(spark, sf_dir, "card").select("id", "dataset_id")
    return R.containment_join(_listed(spark, sf_dir), "listed_id", cards, "dataset_id").select("o_orderkey", "listed_id", F.col("id").alias("card_id"))


_register(
    "j05_containment_join", _containment,
    _with("card") + f", {_LISTED} SELECT o_orderkey, listed_id, card.id AS card_id FROM listed LEFT JOIN card ON position(card.dataset_id IN listed_id) > 0",
)


def _matched(spark, sf_dir):
    listed = _listed(spark, sf_dir).withColumn("listed_id", F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).otherwise(F.col("listed_id")))
    joined = R.containment_join(listed, "listed_id", frame(spark, sf_dir, "card").select("id", "dataset_id"), "dataset_id")
    matched = joined.filter("id is not null").select("o_orderkey").distinct().withColumn("side", F.lit("matched"))
    return matched.unionByName(joined.filter("id is null").select("o_orderkey", F.lit("unmatched").alias("side")))


_register(
    "j06_matched_unmatched", _matched,
    _with("card") + ", listed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'fr__ds-' || CAST(o_custkey AS STRING) || '__' || o_orderstatus END AS listed_id FROM orders) "
    "SELECT o_orderkey, CASE WHEN max(card.id) IS NULL THEN 'unmatched' ELSE 'matched' END AS side FROM listed LEFT JOIN card "
    "ON position(card.dataset_id IN listed_id) > 0 GROUP BY o_orderkey",
)
_register(
    "j08_anti_join", lambda s, d: K.unknown_codes(frame(s, d, "dataset"), "id", "languages", frame(s, d, "vocab_language")),
    _with("dataset", "vocab_language") + "SELECT id, code FROM (SELECT id, unnest(languages) AS code FROM dataset) WHERE code NOT IN (SELECT code FROM vocab_language)",
)


def _admissible(spark, sf_dir):
    cards = frame(spark, sf_dir, "card").select("id", F.explode("tasks").alias("task_code"), F.col("core_skills")[0].alias("skill_code"))
    return cards.join(frame(spark, sf_dir, "taxonomy"), ["task_code", "skill_code"], "left_semi").select("id", "task_code", "skill_code")


_register(
    "j09_semi_join", _admissible,
    _with("card", "taxonomy") + "SELECT id, task_code, skill_code FROM (SELECT id, unnest(tasks) AS task_code, core_skills[1] AS skill_code FROM card) c "
    "WHERE EXISTS (SELECT 1 FROM taxonomy t WHERE t.task_code = c.task_code AND t.skill_code = c.skill_code)",
)


def _self_join(spark, sf_dir):
    dist = frame(spark, sf_dir, "distribution")
    parents = dist.select(F.col("id").alias("derived_from"), F.col("step").alias("parent_step"))
    joined = dist.select("id", "derived_from", "step").join(parents, "derived_from")
    kind = F.when(F.col("step") > F.col("parent_step"), "processed").when(F.col("step") == F.col("parent_step"), "refined")
    return joined.withColumn("kind", kind).filter("kind is not null").select("id", "derived_from", "kind")


_register(
    "j10_non_equi_self_join", _self_join,
    _with("distribution") + "SELECT a.id, a.derived_from, CASE WHEN a.step > b.step THEN 'processed' ELSE 'refined' END AS kind "
    "FROM distribution a JOIN distribution b ON a.derived_from = b.id AND a.step >= b.step",
)


def _paths(spark, sf_dir):
    return frame(spark, sf_dir, "dataset").select("id", F.col("uri").alias("path"))


_register(
    "j13_nearest_ancestor", lambda s, d: R.nearest_ancestor(_paths(s, d), "path", frame(s, d, "dataset")),
    _with("dataset") + "SELECT id, uri AS path, (SELECT max_by(p.uri, length(p.uri)) FROM dataset p WHERE starts_with(dataset.uri, p.uri || '/')) AS parent_uri FROM dataset",
)
_register(
    "j13_has_descendant", lambda s, d: R.has_descendant(_paths(s, d), "path", frame(s, d, "dataset")),
    _with("dataset") + "SELECT id, uri AS path, EXISTS (SELECT 1 FROM dataset c WHERE starts_with(c.uri, dataset.uri || '/')) AS has_child FROM dataset",
)

# ---- aggregates, windows and set operations ---------------------------------------------------------
_register(
    "a10_composition_weights",
    lambda s, d: frame(s, d, "composition").groupBy("parent_card_name").agg(
        F.count("*").alias("children"), F.sum("weight").cast("double").alias("weight"),
        F.count(F.when(~F.col("weight").between(0, 1), 1)).alias("out_of_range"),
    ),
    _with("composition") + "SELECT parent_card_name, count(*) AS children, CAST(sum(weight) AS DOUBLE) AS weight, "
    "count(*) FILTER (weight NOT BETWEEN 0 AND 1) AS out_of_range FROM composition GROUP BY 1",
)
_register(
    "a12_distinct_skills",
    lambda s, d: frame(s, d, "taxonomy").filter(F.col("task_code").isin("task_1", "task_4", "task_7")).select("skill_code").distinct(),
    _with("taxonomy") + "SELECT DISTINCT skill_code FROM taxonomy WHERE task_code IN ('task_1', 'task_4', 'task_7')",
)


def _family(spark, sf_dir):
    """Both directions of the composition as rows, so a parent of very many cards is no single value."""
    composition = frame(spark, sf_dir, "composition")
    up = composition.select(F.col("child_card_name").alias("name"), F.col("parent_card_name").alias("related"), F.lit("parent").alias("side"))
    down = composition.select(F.col("parent_card_name").alias("name"), F.col("child_card_name").alias("related"), F.lit("child").alias("side"))
    return up.unionByName(down)


_register(
    "a13_parents_children", _family,
    _with("composition") + "SELECT child_card_name AS name, parent_card_name AS related, 'parent' AS side FROM composition "
    "UNION ALL SELECT parent_card_name, child_card_name, 'child' FROM composition",
)


def _partition_count(spark, sf_dir):
    """Rows with the size of their group, by a count joined back rather than a sorted window."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sizes = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("counts"))
    return lines.join(sizes, ["l_orderkey", "l_linenumber"])


_register(
    "w01_partition_count", _partition_count,
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS counts FROM lineitem",
)
_register(
    "w02_keep_first",
    lambda s, d: K.first_per_key(
        read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"],
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1",
)
_register(
    "w06_quality_sort",
    lambda s, d: frame(s, d, "card").orderBy(F.coalesce("quality", F.lit(0)).desc(), F.col("created_at").desc(), "id").select("id", "quality"),
    _with("card") + "SELECT id, quality FROM card ORDER BY coalesce(quality, 0) DESC, created_at DESC, id",
)
_register(
    "w07_display_limit",
    lambda s, d: run_sql(
        s, {"shown_orders": read_table(s, d, "orders")},
        "SELECT o_orderkey, o_totalprice FROM shown_orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey", display_limit=500,
    ),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500",
)


def _orphan_listing(spark, sf_dir):
    return frame(spark, sf_dir, "distribution").filter(F.col("part") % 4 != 0).select(
        F.concat("uri", F.when(F.col("part") % 4 == 1, F.lit("/lang=en/subpath=a/b.jsonl.gz")).otherwise(F.lit("/a.jsonl.gz"))).alias("path")
    )


_register(
    "u03_orphans", lambda s, d: K.orphans(frame(s, d, "distribution"), _orphan_listing(s, d)).select("id", "uri"),
    _with("distribution") + "SELECT id, uri FROM distribution WHERE materialized AND uri NOT IN (SELECT uri FROM distribution WHERE part % 4 <> 0)",
)
_register(
    "u04_ordered_distinct",
    lambda s, d: read_table(s, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), "|").alias("codes")),
    "SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), '|') AS codes "
    "FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
)


# ---- audits and snapshots ---------------------------------------------------------------------------
def _incoming(spark, sf_dir):
    base = frame(spark, sf_dir, "dataset")
    changed = base.filter(F.substring("id", -1, 1) == "3").select("uri", F.upper("name").alias("name"), F.lit("gpl_3").alias("license"))
    fresh = base.filter(F.substring("id", -1, 1) == "4").select(F.concat("uri", F.lit("/new")).alias("uri"), F.concat("name", F.lit("_new")).alias("name"), F.lit("mit").alias("license"))
    return changed.unionByName(fresh)


_register(
    "i01_upsert",
    lambda s, d: K.upsert(frame(s, d, "dataset").select("uri", "name", "license", "step"), _incoming(s, d), "uri"),
    _with("dataset") + ", inc AS (SELECT uri, upper(name) AS name, 'gpl_3' AS license FROM dataset WHERE right(id, 1) = '3' UNION ALL "
    "SELECT uri || '/new', name || '_new', 'mit' FROM dataset WHERE right(id, 1) = '4') SELECT coalesce(inc.uri, d.uri) AS uri, "
    "CASE WHEN inc.uri IS NOT NULL THEN inc.name ELSE d.name END AS name, CASE WHEN inc.uri IS NOT NULL THEN inc.license ELSE d.license END AS license, d.step "
    "FROM dataset d FULL JOIN inc ON d.uri = inc.uri",
)
_RAWCODE = "'  ' || p_name || ' -- ' || p_brand || '!' || p_type || CASE WHEN p_partkey % 9 = 0 THEN 'é' ELSE '' END || ' '"
_register(
    "i02_normalise_code",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey", f"{_RAWCODE} AS raw").select("p_partkey", N.vocabulary_code(F.col("raw")).alias("code")),
    f"SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(trim({_RAWCODE})), '[-\\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '') AS code FROM part",
)


def _invalid_codes(spark, sf_dir):
    cards = frame(spark, sf_dir, "card")
    a = K.unknown_codes(cards, "id", "languages", frame(spark, sf_dir, "vocab_language")).withColumn("kind", F.lit("language"))
    b = K.unknown_codes(cards, "id", "core_skills", frame(spark, sf_dir, "vocab_skill")).withColumn("kind", F.lit("skill"))
    c = K.unknown_codes(cards, "id", "tasks", frame(spark, sf_dir, "taxonomy"), "task_code").withColumn("kind", F.lit("task"))
    return a.unionByName(b).unionByName(c)


_register(
    "i03_invalid_codes", _invalid_codes,
    _with("card", "vocab_language", "vocab_skill", "taxonomy")
    + "SELECT id, code, 'language' AS kind FROM (SELECT id, unnest(languages) AS code FROM card) WHERE code NOT IN (SELECT code FROM vocab_language) UNION ALL "
    "SELECT id, code, 'skill' FROM (SELECT id, unnest(core_skills) AS code FROM card) WHERE code NOT IN (SELECT code FROM vocab_skill) UNION ALL "
    "SELECT id, code, 'task' FROM (SELECT id, unnest(tasks) AS code FROM card) WHERE code NOT IN (SELECT task_code FROM taxonomy)",
)
_register(
    "i04_skill_task_coherence", lambda s, d: K.incoherent_skills(frame(s, d, "card"), frame(s, d, "taxonomy")),
    _with("card", "taxonomy") + ", c AS (SELECT id, tasks, unnest(core_skills) AS skill_code FROM card WHERE NOT list_contains(core_skills, 'mix') "
    "AND NOT coalesce(list_contains(tasks, 'mix'), false)) SELECT id, skill_code, CASE WHEN tasks IS NULL THEN 'no task' ELSE 'not admissible' END AS reason FROM c "
    "WHERE tasks IS NULL OR NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.skill_code = c.skill_code AND list_contains(c.tasks, t.task_code))",
)
_register(
    "i05_step_lineage", lambda s, d: K.step_regressions(frame(s, d, "dataset"), "derived_dataset").select("id", "derived_dataset", "step", "parent_step"),
    _with("dataset") + "SELECT a.id, a.derived_dataset, a.step, b.step AS parent_step FROM dataset a JOIN dataset b ON a.derived_dataset = b.id WHERE a.step < b.step",
)
_register(
    "i06_distribution_alignment", lambda s, d: K.misaligned_distributions(frame(s, d, "distribution"), frame(s, d, "dataset")),
    _with("distribution", "dataset") + "SELECT a.id, 'dataset step' AS reason FROM distribution a JOIN dataset b ON a.dataset_id = b.id WHERE a.step <> b.step UNION ALL "
    "SELECT a.id, 'parent step' FROM distribution a JOIN distribution b ON a.derived_from = b.id WHERE a.step < b.step",
)


def strategies(spark, sf_dir):
    dist = frame(spark, sf_dir, "distribution")
    return dist.select(
        F.concat(F.lit("st-"), "id").alias("id"), F.concat(F.lit("rec-"), F.col("supplier").cast("string")).alias("recipe_id"),
        F.col("id").alias("distribution_id"), F.col("factor").alias("replication_factor"), "chat_type", "part",
    )


STRATEGY = (
    "strategy AS (SELECT 'st-' || id AS id, 'rec-' || CAST(supplier AS STRING) AS recipe_id, id AS distribution_id, "
    "factor AS replication_factor, chat_type, part FROM distribution)"
)
_register(
    "i07_strategy_eligibility", lambda s, d: K.ineligible_strategies(strategies(s, d), frame(s, d, "distribution")).select("id", "distribution_id"),
    _with("distribution") + f", {STRATEGY} SELECT s.id, s.distribution_id FROM strategy s JOIN distribution d ON s.distribution_id = d.id WHERE d.step <> 3",
)


def _impact(spark, sf_dir):
    doomed = frame(spark, sf_dir, "dataset").filter("step = 1").select("id")
    dist = frame(spark, sf_dir, "distribution")
    cascaded = dist.join(doomed.withColumnRenamed("id", "dataset_id"), "dataset_id", "left_semi").select("id")
    first = K.delete_impact(doomed, [
        ("distribution", dist, "id", "dataset_id", "CASCADE"),
        ("dataset", frame(spark, sf_dir, "dataset"), "id", "derived_dataset", "SET NULL"),
    ])
    second = K.delete_impact(cascaded, [
        ("strategy", strategies(spark, sf_dir), "id", "distribution_id", "RESTRICT"),
        ("distribution", dist, "id", "derived_from", "SET NULL"),
    ])
    return first.unionByName(second)


_register(
    "i08_delete_impact", _impact,
    _with("dataset", "distribution") + f", {STRATEGY}, x AS (SELECT id FROM dataset WHERE step = 1), y AS (SELECT id FROM distribution WHERE dataset_id IN (SELECT id FROM x)) "
    "SELECT 'distribution' AS \"table\", id, dataset_id AS deleted_id, 'CASCADE' AS action FROM distribution WHERE dataset_id IN (SELECT id FROM x) UNION ALL "
    "SELECT 'dataset', id, derived_dataset, 'SET NULL' FROM dataset WHERE derived_dataset IN (SELECT id FROM x) UNION ALL "
    "SELECT 'strategy', id, distribution_id, 'RESTRICT' FROM strategy WHERE distribution_id IN (SELECT id FROM y) UNION ALL "
    "SELECT 'distribution', id, derived_from, 'SET NULL' FROM distribution WHERE derived_from IN (SELECT id FROM y)",
)
_register(
    "i08_protected_cards", lambda s, d: K.protected_cards(frame(s, d, "card"), frame(s, d, "dataset").filter("step = 3")).select("id"),
    _with("card", "dataset") + "SELECT id FROM card WHERE id IN (SELECT derived_card FROM dataset WHERE step = 3)",
)
_register(
    "i09_version_bump", lambda s, d: frame(s, d, "dataset").select("id", N.next_version(F.col("version")).alias("version")),
    _with("dataset") + "SELECT id, CASE version WHEN '1.0' THEN '1.0.1' WHEN '1.0.3' THEN '1.0.4' WHEN '2' THEN '2.0.1' ELSE '1.0.0' END AS version FROM dataset",
)


def _history(spark, sf_dir):
    old = strategies(spark, sf_dir)
    new = old.filter(F.col("part") % 11 != 0).withColumn(
        "replication_factor", F.when(F.col("part") % 7 == 0, F.col("replication_factor") + 1).otherwise(F.col("replication_factor"))
    ).withColumn("chat_type", F.when(F.col("part") % 13 == 0, F.lit("fc_chat")).otherwise(F.col("chat_type")))
    out = K.changes(old, new, "id", ["replication_factor", "chat_type", "distribution_id"])
    return out.withColumn("replication_factor", F.col("replication_factor").cast("double"))


_register(
    "i10_change_history", _history,
    _with("distribution") + f", {STRATEGY} SELECT id, CAST(replication_factor AS DOUBLE) AS replication_factor, chat_type, distribution_id, "
    "CASE WHEN part % 11 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation_type FROM strategy WHERE part % 11 = 0 OR part % 7 = 0 OR part % 13 = 0",
)
_register(
    "i11_soft_delete", lambda s, d: K.soft_delete(frame(s, d, "prompt"), frame(s, d, "prompt").filter("_lang = 'it'")).select("id", "deleted"),
    _with("prompt") + "SELECT id, deleted OR _lang = 'it' AS deleted FROM prompt",
)


def _checks(spark, sf_dir):
    a = K.failed_checks(frame(spark, sf_dir, "card"), "id", K.card_checks())
    b = K.failed_checks(frame(spark, sf_dir, "dataset"), "id", K.dataset_checks())
    c = K.failed_checks(frame(spark, sf_dir, "composition"), "child_card_name", K.composition_checks())
    return a.unionByName(b).unionByName(c)


_register(
    "i12_declared_checks", _checks,
    _with("card", "dataset", "composition")
    + "SELECT id, 'source_url' AS \"check\" FROM card WHERE NOT (source_url = '' OR regexp_matches(source_url, '^https?://')) UNION ALL "
    "SELECT id, 'quality' FROM card WHERE quality NOT BETWEEN 1 AND 5 UNION ALL SELECT id, 'tasks' FROM card WHERE len(tasks) > 1 UNION ALL "
    "SELECT id, 'core_skills' FROM card WHERE len(core_skills) > 1 UNION ALL "
    "SELECT id, 'uri' FROM dataset WHERE NOT regexp_matches(uri, '^[a-zA-Z][a-zA-Z0-9+.-]*://') UNION ALL "
    "SELECT id, 'version' FROM dataset WHERE NOT regexp_matches(version, '^\\d+\\.\\d+(\\.\\d+)?$') UNION ALL "
    "SELECT child_card_name, 'weight' FROM composition WHERE weight NOT BETWEEN 0 AND 1 UNION ALL "
    "SELECT child_card_name, 'self' FROM composition WHERE parent_card_name = child_card_name",
)


def _uniqueness(spark, sf_dir):
    a = K.duplicates(frame(spark, sf_dir, "card"), ["dataset_id"]).select(F.lit("card").alias("table"), F.col("dataset_id").alias("value"), "rows")
    b = K.duplicates(frame(spark, sf_dir, "dataset"), ["name"]).select(F.lit("dataset").alias("table"), F.col("name").alias("value"), "rows")
    return a.unionByName(b)


_register(
    "i13_uniqueness", _uniqueness,
    _with("card", "dataset") + "SELECT 'card' AS \"table\", dataset_id AS value, count(*) AS rows FROM card GROUP BY 2 HAVING count(*) > 1 UNION ALL "
    "SELECT 'dataset', name, count(*) FROM dataset GROUP BY 2 HAVING count(*) > 1",
)


def _foreign_keys(spark, sf_dir):
    dist, dataset = frame(spark, sf_dir, "distribution"), frame(spark, sf_dir, "dataset")
    parts = [
        K.dangling(dist, "id", "derived_from", dist).select("id", F.lit("distribution.derived_from").alias("key")),
        K.dangling(dataset, "id", "derived_dataset", dataset).select("id", F.lit("dataset.derived_dataset").alias("key")),
        K.dangling(frame(spark, sf_dir, "card"), "id", "license", frame(spark, sf_dir, "vocab_license"), "code").select("id", F.lit("card.license").alias("key")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_register(
    "i13_foreign_keys", _foreign_keys,
    _with("distribution", "dataset", "card", "vocab_license")
    + "SELECT id, 'distribution.derived_from' AS key FROM distribution WHERE derived_from IS NOT NULL AND derived_from NOT IN (SELECT id FROM distribution) UNION ALL "
    "SELECT id, 'dataset.derived_dataset' FROM dataset WHERE derived_dataset IS NOT NULL AND derived_dataset NOT IN (SELECT id FROM dataset) UNION ALL "
    "SELECT id, 'card.license' FROM card WHERE license NOT IN (SELECT code FROM vocab_license)",
)
_RAWNAME = "' _' || p_name || '  ' || p_brand || '.v' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '-_' ELSE '. ' END"
_NAME_SQL = "trim(trim(trim(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '__', 'g'), '[^a-z0-9_\\-.]', '', 'g'), '_'), '-'), '.')"
_register(
    "i14_normalise_name",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey", f"{_RAWNAME} AS raw").select("p_partkey", N.entity_name(F.col("raw")).alias("name")),
    f"SELECT p_partkey, {_NAME_SQL.format(_RAWNAME)} AS name FROM part",
)
_SEED = {
    "seq": "o_orderkey",
    "LANG": "CASE o_orderkey % 7 WHEN 0 THEN 'Nan' WHEN 1 THEN NULL WHEN 2 THEN 'English' WHEN 3 THEN 'None' ELSE 'FR' END",
    "QUALITY SCORE": "CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN NULL WHEN 2 THEN '3' ELSE '2.7' END",
    "DIR INPUT": "CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 13 = 1 THEN NULL "
                 "ELSE '/seed/' || o_orderstatus || '/L ' || substring(o_orderpriority, 1, 1) || '/' END",
    "NAME": "'Name ' || CAST(o_custkey % 700 AS STRING)",
    "dataset_id": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Base.' || CAST(o_custkey % 700 AS STRING) END",
}


def _spark_list(columns):
    return [f"{expr} AS `{alias}`" for alias, expr in columns.items()]


def _sql_list(columns):
    return ", ".join(f'{expr} AS "{alias}"' for alias, expr in columns.items())


def _seeded(spark, sf_dir):
    return K.seed_distributions(read_table(spark, sf_dir, "orders").selectExpr(*_spark_list(_SEED)), ["seq"])


_register(
    "i15_seed_distributions", _seeded,
    f"WITH r AS (SELECT {_sql_list(_SEED)} FROM orders), "
    + "f AS (SELECT *, CASE WHEN LANG IS NULL OR lower(substring(LANG, 1, 2)) IN ('na', 'no') THEN 'un' ELSE lower(substring(LANG, 1, 2)) END AS lg, "
    "CAST(coalesce(trunc(try_cast(\"QUALITY SCORE\" AS DOUBLE)), 1) AS INT) AS quality, coalesce(dataset_id, NAME) AS base FROM r WHERE trim(coalesce(\"DIR INPUT\", '')) <> ''), "
    "k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY base, \"DIR INPUT\" ORDER BY seq) = 1), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY base) AS n, string_split(rtrim(\"DIR INPUT\", '/'), '/')[-1] AS leaf FROM k), "
    "z AS (SELECT *, concat_ws(' ', lg, NAME, CASE WHEN n > 1 THEN leaf END) AS rn, concat_ws(' ', lg, base, CASE WHEN n > 1 THEN leaf END) AS ri FROM c) "
    f"SELECT {_NAME_SQL.format('rn')} AS name, quality, {_NAME_SQL.format('ri')} AS dataset_id, {_NAME_SQL.format('rn')} AS dataset, \"DIR INPUT\" AS uri, 3 AS step, lg AS lang FROM z",
)
_CARD_SEED = {
    "seq": "c_custkey",
    "dataset_id": "'Set ' || CAST(c_custkey % 900 AS STRING) || '!'",
    "dataset name": "CASE WHEN c_custkey % 40 = 0 THEN '??' ELSE c_name END",
    "Reasoning field": "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'math' END",
    "languages": "CASE c_custkey % 4 WHEN 0 THEN 'EN, fr,en' WHEN 1 THEN 'multi,xyz' WHEN 2 THEN NULL ELSE ' de ,,it' END",
    "licence": "CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'mit' ELSE NULL END",
    "core skill / capability": "CASE WHEN c_custkey % 5 = 0 THEN ' ,skill a, b' ELSE 'Skill ' || CAST(c_custkey % 6 AS STRING) END",
    "tasks": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Task 1,Task 2' END",
}


def _seeded_cards(spark, sf_dir):
    out = K.seed_cards(read_table(spark, sf_dir, "customer").selectExpr(*_spark_list(_CARD_SEED)), ["seq"])
    joined = {c: F.array_join(c, ",").alias(c) for c in ("languages", "core_skills", "tasks")}
    return out.select("dataset_id", "dataset_name", "has_reasoning", "license", "modality", "source_type", *joined.values())


_register(
    "i16_seed_cards", _seeded_cards,
    f"WITH r AS (SELECT {_sql_list(_CARD_SEED)} FROM customer), "
    + f"n AS (SELECT *, {_NAME_SQL.format('dataset_id')} AS did, {_NAME_SQL.format(chr(34) + 'dataset name' + chr(34))} AS dn FROM r), "
    "k AS (SELECT * FROM n WHERE did <> '' AND dn <> '' QUALIFY row_number() OVER (PARTITION BY did ORDER BY seq) = 1) "
    "SELECT did AS dataset_id, dn AS dataset_name, trim(coalesce(\"Reasoning field\", '')) <> '' AS has_reasoning, coalesce(nullif(trim(licence), ''), 'unknown') AS license, "
    "'text' AS modality, 'unknown' AS source_type, CASE seq % 4 WHEN 0 THEN 'en,fr' WHEN 1 THEN 'multi' WHEN 2 THEN '' ELSE 'de,it' END AS languages, "
    "CASE WHEN seq % 5 = 0 THEN 'skill a' ELSE 'Skill ' || CAST(seq % 6 AS STRING) END AS core_skills, CASE WHEN seq % 6 = 0 THEN '' ELSE 'Task 1' END AS tasks FROM k",
)


def _labels(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    raw = parts.select(F.concat(F.col("p_type"), F.lit("-"), F.col("p_name")).alias("raw")).unionByName(
        parts.select(F.concat(F.lit(" "), "p_type", F.lit("/"), F.expr("substring(p_name, 1, 4)"), F.lit("9!")).alias("raw"))
    )
    words = parts.filter("p_partkey % 3 <> 0").select(F.lower(F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")))).alias("code")).distinct()
    return raw, words


def _matched_labels(spark, sf_dir):
    raw, words = _labels(spark, sf_dir)
    return K.match_vocabulary(raw, "raw", words)


_register("i17_vocabulary_match", _matched_labels)


def _exact_labels(spark, sf_dir):
    raw, words = _labels(spark, sf_dir)
    return K.match_vocabulary(raw, "raw", words).filter("reason = 'exact_match'").select("raw", "code", "matched")


_register(
    "i17_exact_match", _exact_labels,
    "WITH l AS (SELECT p_type || '-' || p_name AS raw FROM part UNION SELECT ' ' || p_type || '/' || substring(p_name, 1, 4) || '9!' FROM part), "
    "w AS (SELECT DISTINCT lower(p_type || '_' || replace(p_name, ' ', '_')) AS code FROM part WHERE p_partkey % 3 <> 0), "
    "n AS (SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[\\s\\-/]+', '_', 'g'), '[^a-z_]', '', 'g'), '_+', '_', 'g'), '_') AS code FROM l) "
    "SELECT raw, code, code AS matched FROM n WHERE code IN (SELECT code FROM w)",
)
_register(
    "i17_license_fallback",
    lambda s, d: K.known_license(F.col("license"), frame(s, d, "vocab_license"), frame(s, d, "card")).select("id", "license"),
    _with("card", "vocab_license") + "SELECT id, CASE WHEN license IN (SELECT code FROM vocab_license) THEN license ELSE 'unknown' END AS license FROM card",
)


def _triplets(spark, sf_dir):
    incoming = read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "'ds-' || CAST(c_custkey + 700 AS STRING) AS card_id", "'fresh_' || CAST(c_custkey AS STRING) AS card_name",
        "'dataset_' || CAST(c_custkey + 14500 AS STRING) AS name",
    )
    cards, datasets = K.triplet_inserts(incoming, frame(spark, sf_dir, "card"), frame(spark, sf_dir, "dataset"))
    parts = [cards.select("c_custkey", F.lit("card").alias("insert"))]
    parts += [datasets.select("c_custkey", F.lit(kind).alias("insert")) for kind in ("dataset", "distribution")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_register(
    "i18_triplet_insert", _triplets,
    _with("card", "dataset") + ", i AS (SELECT c_custkey, 'ds-' || CAST(c_custkey + 700 AS STRING) AS card_id, 'dataset_' || CAST(c_custkey + 14500 AS STRING) AS name FROM customer) "
    "SELECT c_custkey, 'card' AS \"insert\" FROM i WHERE card_id NOT IN (SELECT dataset_id FROM card) UNION ALL "
    "SELECT c_custkey, kind FROM i, (VALUES ('dataset'), ('distribution')) v(kind) WHERE name NOT IN (SELECT name FROM dataset)",
)


def _prompt_upsert(spark, sf_dir):
    prompts = frame(spark, sf_dir, "prompt").select("name", "prompt", "length", "description", "_lang", "version")
    given = frame(spark, sf_dir, "prompt").filter("_lang = 'fr'").select(
        F.when(F.col("deleted"), F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), F.upper("prompt").alias("prompt"),
        F.length("prompt").alias("length"), F.lit("imported").alias("description"), F.lit("un").alias("_lang"),
    )
    return K.upsert(prompts, given, "name").select("name", "prompt", "length", "description", "_lang", "version")


_register(
    "i19_prompt_upsert", _prompt_upsert,
    _with("prompt") + ", g AS (SELECT CASE WHEN deleted THEN name || ' new' ELSE name END AS name, upper(prompt.prompt) AS p, length(prompt.prompt) AS n FROM prompt WHERE _lang = 'fr') "
    "SELECT coalesce(g.name, prompt.name) AS name, CASE WHEN g.name IS NOT NULL THEN g.p ELSE prompt.prompt END AS prompt, "
    "CASE WHEN g.name IS NOT NULL THEN g.n ELSE prompt.length END AS length, CASE WHEN g.name IS NOT NULL THEN 'imported' ELSE description END AS description, "
    "CASE WHEN g.name IS NOT NULL THEN 'un' ELSE _lang END AS _lang, version FROM prompt FULL JOIN g ON prompt.name = g.name",
)
_register(
    "i20_register_layer",
    lambda s, d: K.register_layer(frame(s, d, "dataset").filter("step = 1"), ["en", "fr"], "processed", 2, ".jsonl.gz").select("dataset", "name", "uri", "lang", "glob", "step"),
    _with("dataset") + "SELECT 'processed__' || name AS dataset, 'processed__' || name || '__' || l AS name, "
    "regexp_replace(uri, '/data/[a-z]+/', '/data/processed/', 'g') || '/' || l AS uri, l AS lang, '*.jsonl.gz' AS glob, 2 AS step "
    "FROM dataset, (VALUES ('en'), ('fr')) v(l) WHERE step = 1",
)


def _repaired(spark, sf_dir):
    dist = frame(spark, sf_dir, "distribution")
    return K.repair_alignment(dist, K.orphans(dist, _orphan_listing(spark, sf_dir))).select("id", "materialized")


_register(
    "i21_alignment_repair", _repaired,
    _with("distribution") + "SELECT id, materialized AND uri IN (SELECT uri FROM distribution WHERE part % 4 <> 0) AS materialized FROM distribution",
)


_KEY = "CAST(substring(id, 6) AS BIGINT)"
_RAW_ROWS = {
    "uri": "CASE WHEN k % 2 = 0 THEN replace(uri, 'file:///data/', 'file:///app/') ELSE uri || '/raw' END",
    "name": "CASE WHEN k % 4 < 2 THEN name WHEN k % 8 = 6 THEN 'dataset_' || CAST(k + 1 AS STRING) ELSE 'raw_' || CAST(k AS STRING) END",
    "languages": "CASE WHEN k % 5 = 0 THEN NULL ELSE split('pt,ro', ',') END",
}


def _raw_registered(spark, sf_dir):
    """Every third dataset registered again: by address with its own, a new or another's name, and at
    a new address with a known or a new name. Some names of the catalog are held by two datasets."""
    known = frame(spark, sf_dir, "dataset").withColumn("k", F.expr(_KEY))
    existing = known.select("uri", "name", "languages", "step", F.array(F.lit("*.old")).alias("globs"))
    incoming = known.filter("k % 3 = 0").selectExpr(*[f"{expr} AS {name}" for name, expr in _RAW_ROWS.items()])
    globs = known.select(F.concat("uri", F.lit("/raw")).alias("uri"), F.array(F.lit("*.json")).alias("globs"))
    snapshot, conflicts = K.register_raw(incoming, existing, [("/app/", "/data/")], globs)
    rows = snapshot.select("uri", "name", "step", F.array_join("languages", ",").alias("languages"), F.array_join("globs", ",").alias("globs"), F.lit("ok").alias("state"))
    return rows.unionByName(conflicts.select("uri", "name", F.col("reason").alias("state")), allowMissingColumns=True)


_register(
    "i22_register_raw", _raw_registered,
    _with("dataset") + f""", e AS (SELECT uri, name, array_to_string(languages, ',') AS languages, step, '*.old' AS globs, {_KEY} AS k FROM dataset),
    i AS (SELECT CASE WHEN k % 2 = 0 THEN uri ELSE uri || '/raw' END AS uri, CASE WHEN k % 4 < 2 THEN name WHEN k % 8 = 6 THEN 'dataset_' || CAST(k + 1 AS STRING) ELSE 'raw_' || CAST(k AS STRING) END AS name,
        CASE WHEN k % 5 = 0 THEN 'en' ELSE 'pt,ro' END AS languages FROM e WHERE k % 3 = 0),
    j AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY uri, name) AS nu, row_number() OVER (PARTITION BY name ORDER BY uri, name) AS nn FROM i),
    o AS (SELECT name AS oname, count(*) AS n, min(uri) AS owner FROM e GROUP BY name),
    d AS (SELECT j.*, x.uri IS NOT NULL AS known, coalesce(n, 0) AS n, owner FROM j LEFT JOIN (SELECT DISTINCT uri FROM e) x ON x.uri = j.uri LEFT JOIN o ON oname = j.name),
    r AS (SELECT *, CASE WHEN nu > 1 OR nn > 1 THEN 'repeated' WHEN known AND NOT (n = 0 OR (n = 1 AND owner = uri)) THEN 'name_taken' WHEN NOT known AND n > 1 THEN 'name_taken' END AS reason,
        CASE WHEN known THEN uri WHEN n = 1 THEN owner END AS target FROM d),
    f AS (SELECT r.*, CASE WHEN reason IS NOT NULL THEN reason WHEN target <> uri AND target IN (SELECT target FROM r WHERE reason IS NULL AND target = uri) THEN 'row_taken' END AS state FROM r),
    a AS (SELECT * FROM f WHERE state IS NULL)
    SELECT coalesce(a.uri, e.uri) AS uri, coalesce(a.name, e.name) AS name, CASE WHEN a.uri IS NULL THEN e.step ELSE 1 END AS step, coalesce(a.languages, e.languages) AS languages,
        CASE WHEN a.uri <> e.uri THEN '*.json' ELSE e.globs END AS globs, 'ok' AS state FROM e LEFT JOIN a ON a.target = e.uri
    UNION ALL SELECT uri, name, 1, languages, '*.json', 'ok' FROM a WHERE target IS NULL
    UNION ALL SELECT uri, name, NULL, NULL, NULL, state FROM f WHERE state IS NOT NULL""",
)


def _mapped_layer(spark, sf_dir):
    """All processed distributions mapped; some mapped datasets and distributions exist already."""
    datasets, dist = frame(spark, sf_dir, "dataset"), frame(spark, sf_dir, "distribution")
    new_datasets, new_dist = K.mapped_layer(dist.filter("step = 2"), datasets)
    columns = ["uri", "name", "version", "license", "step"]
    sets, refused = K.upsert_by_address(new_datasets.select(*columns, "description"), datasets.select(*columns, "description"))
    parts, lost = K.upsert_by_address(new_dist, dist.select("uri", "name", "split", "license", "lang", "derived_from", "materialized", "step"))
    kind = lambda df, k, state: df.select(F.lit(k).alias("kind"), "uri", "name", *([F.col("step")] if "step" in df.columns else [F.lit(None).cast("int").alias("step")]), state.alias("state"))
    ok = F.lit("ok")
    return reduce(lambda a, b: a.unionByName(b), [kind(sets, "dataset", ok), kind(refused, "dataset", F.col("reason")), kind(parts, "distribution", ok), kind(lost, "distribution", F.col("reason"))])


def _upsert_sql(kind, base, existing):
    """Snapshot and conflicts of rows ``(uri, name, step)`` upserted by address, then by name."""
    p = kind[:2]
    return (
        f"{p}j AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY uri, name) AS nu, row_number() OVER (PARTITION BY name ORDER BY uri, name) AS nn FROM {base}), "
        f"{p}o AS (SELECT name AS oname, count(*) AS n, min(uri) AS owner FROM {existing} GROUP BY name), "
        f"{p}d AS (SELECT j.*, x.uri IS NOT NULL AS known, coalesce(n, 0) AS n, owner FROM {p}j j LEFT JOIN (SELECT DISTINCT uri FROM {existing}) x ON x.uri = j.uri LEFT JOIN {p}o ON oname = j.name), "
        f"{p}r AS (SELECT *, CASE WHEN nu > 1 OR nn > 1 THEN 'repeated' WHEN known AND NOT (n = 0 OR (n = 1 AND owner = uri)) THEN 'name_taken' WHEN NOT known AND n > 1 THEN 'name_taken' END AS reason, "
        f"CASE WHEN known THEN uri WHEN n = 1 THEN owner END AS target FROM {p}d), "
        f"{p}f AS (SELECT r.*, CASE WHEN reason IS NOT NULL THEN reason WHEN target <> uri AND target IN (SELECT target FROM {p}r WHERE reason IS NULL AND target = uri) THEN 'row_taken' END AS state FROM {p}r r), "
        f"{p}a AS (SELECT * FROM {p}f WHERE state IS NULL), {p}out AS ("
        f"SELECT '{kind}' AS kind, coalesce(a.uri, e.uri) AS uri, coalesce(a.name, e.name) AS name, coalesce(a.step, e.step) AS step, 'ok' AS state FROM {existing} e LEFT JOIN {p}a a ON a.target = e.uri "
        f"UNION ALL SELECT '{kind}', uri, name, step, 'ok' FROM {p}a WHERE target IS NULL UNION ALL SELECT '{kind}', uri, name, NULL, state FROM {p}f WHERE state IS NOT NULL)"
    )


_register(
    "i20_mapped_layer", _mapped_layer,
    _with("dataset", "distribution") + ", src AS (SELECT * FROM distribution WHERE step = 2), "
    "nd AS (SELECT regexp_replace(uri, '/data/[a-z]+/', '/data/mapped/', 'g') AS uri, 'mapped__' || name AS name, 3 AS step FROM dataset WHERE id IN (SELECT dataset_id FROM src)), "
    "nx AS (SELECT regexp_replace(uri, '/data/[a-z]+/', '/data/mapped/', 'g') AS uri, 'mapped__' || name AS name, 3 AS step FROM src), "
    + _upsert_sql("dataset", "nd", "dataset") + ", " + _upsert_sql("xdistribution", "nx", "distribution").replace("'xdistribution'", "'distribution'")
    + " SELECT * FROM daout UNION ALL SELECT * FROM xdout",
)
