"""Lineage over the derived catalog: edges, traversal, reachability and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lineage as L
from millrace.plans.catalog_frames import cte, frame

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def edges(spark, sf_dir):
    return L.catalog_edges(*[frame(spark, sf_dir, n) for n in ("card", "composition", "dataset", "distribution")])


_EDGES = cte("card", "composition", "dataset", "distribution") + (
    ", edges AS (SELECT 'Card' AS source_type, p.id AS source_id, 'ml:composes' AS edge_type, 'Card' AS target_type, c.id AS target_id "
    "FROM composition cc JOIN card p ON p.dataset_name = cc.parent_card_name JOIN card c ON c.dataset_name = cc.child_card_name UNION ALL "
    "SELECT 'Card', dc.id, 'ml:describes', 'Dataset', d.id FROM card dc JOIN dataset d ON d.derived_card = dc.id UNION ALL "
    "SELECT 'Dataset', d.id, 'ml:manifests_as', 'Distribution', x.id FROM dataset d JOIN distribution x ON x.dataset_id = d.id UNION ALL "
    "SELECT 'Dataset', a.id, 'ml:datasetProcessedBy', 'Dataset', b.id FROM dataset a JOIN dataset b ON a.derived_dataset = b.id WHERE a.step > b.step UNION ALL "
    "SELECT 'Distribution', a.id, 'ml:refinedBy', 'Distribution', b.id FROM distribution a JOIN distribution b ON a.derived_from = b.id "
    "JOIN dataset d ON a.dataset_id = d.id WHERE a.step = b.step AND d.derived_card IS NOT NULL UNION ALL "
    "SELECT 'Distribution', a.id, 'ml:distributionProcessedBy', 'Distribution', b.id FROM distribution a JOIN distribution b ON a.derived_from = b.id WHERE a.step > b.step)"
)
_register("g01_edges", edges, f"WITH {_EDGES} SELECT * FROM edges")
_register(
    "u01_edge_union", lambda s, d: edges(s, d).groupBy("source_type", "edge_type", "target_type").agg(F.count("*").alias("edges")),
    f"WITH {_EDGES} SELECT source_type, edge_type, target_type, count(*) AS edges FROM edges GROUP BY 1, 2, 3",
)
_register(
    "j11_disjunctive_join",
    lambda s, d: L.both_ways(edges(s, d)).groupBy("from_type", "from_id").agg(F.count("*").alias("degree")),
    f"WITH {_EDGES}, nodes AS (SELECT source_type AS t, source_id AS i FROM edges UNION SELECT target_type, target_id FROM edges), "
    "hit AS (SELECT source_type AS t, source_id AS i FROM edges UNION ALL SELECT target_type, target_id FROM edges) "
    "SELECT t AS from_type, i AS from_id, count(*) AS degree FROM nodes JOIN hit USING (t, i) GROUP BY 1, 2",
)


def _walk_sql(edges_name, kind, start, depth):
    """Simple paths from a node, or from every row of a table of nodes, walking every edge in both directions."""
    one = f"'{start}'" if start else "id"
    source = "" if start else f" FROM {kind[1]}"
    kind = kind if start else kind[0]
    return (
        f"both_ways AS (SELECT source_type AS ft, source_id AS fi, edge_type AS e, target_type AS nt, target_id AS ni FROM {edges_name} UNION ALL "
        f"SELECT target_type, target_id, edge_type, source_type, source_id FROM {edges_name}), "
        f"walk AS (SELECT {one} AS start_id, 0 AS depth, CAST(NULL AS VARCHAR) AS from_type, CAST(NULL AS VARCHAR) AS from_id, CAST(NULL AS VARCHAR) AS via_edge, "
        f"'{kind}' AS node_type, {one} AS node_id, ['{kind}:' || {one}] AS path{source} UNION ALL "
        "SELECT w.start_id, w.depth + 1, w.node_type, w.node_id, b.e, b.nt, b.ni, list_append(w.path, b.nt || ':' || b.ni) FROM walk w JOIN both_ways b "
        f"ON w.node_type = b.ft AND w.node_id = b.fi WHERE w.depth < {depth} AND NOT list_contains(w.path, b.nt || ':' || b.ni))"
    )


START_CARD = "card-1"


def _start(spark, kind, identity):
    return spark.range(1).select(F.lit(kind).alias("node_type"), F.lit(identity).alias("node_id"))


def card_paths(spark, sf_dir):
    """Walk from one card; the node and the depth are the parameters of the operator."""
    return L.traverse(edges(spark, sf_dir), _start(spark, "Card", START_CARD), 4).drop("start_type", "start_id")


_WALK = f"WITH RECURSIVE {_EDGES}, {_walk_sql('edges', 'Card', START_CARD, 4)} "
_register(
    "g02_traversal", card_paths,
    _WALK + "SELECT depth, from_type, from_id, via_edge, node_type, node_id FROM walk WHERE depth > 0",
)


def _forest(nodes, max_depth, live=None):
    """Lineage of every row of a table of nodes with one parent each."""
    parents = nodes.select(F.col("id").alias("node"), (F.when(live, F.col("derived_from")) if live is not None else F.col("derived_from")).alias("parent"))
    # A parent that is no row of its own ends the tree.
    known = parents.select(F.col("node").alias("parent")).withColumn("known", F.lit(True))
    parents = parents.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    return L.forest_lineage(parents, parents, max_depth)


def _recipe_lineage(spark, sf_dir):
    """Lineage of every recipe at once."""
    recipes = frame(spark, sf_dir, "recipe")
    paths = _forest(recipes, 5).withColumn("via_edge", F.lit(L.RECIPE_DERIVED))
    names = recipes.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    about = recipes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), "scope", "version")
    return paths.join(names, "from_id", "left").join(about, "node_id").select(
        "start_id", "depth", "from_id", "from_name", "via_edge", "node_id", "node_name", "scope", "version")


_RECIPE_EDGES = (
    "edges AS (SELECT 'Recipe' AS source_type, id AS source_id, 'recipe:derivedFrom' AS edge_type, 'Recipe' AS target_type, derived_from AS target_id "
    "FROM recipe WHERE derived_from IS NOT NULL)"
)
_register(
    "g03_recipe_lineage", _recipe_lineage,
    f"WITH RECURSIVE {cte('recipe')}, {_RECIPE_EDGES}, {_walk_sql('edges', ('Recipe', 'recipe'), None, 5)} "
    "SELECT start_id, depth, from_id, f.name AS from_name, via_edge, node_id, r.name AS node_name, r.scope, r.version FROM walk JOIN recipe r ON r.id = node_id "
    "LEFT JOIN recipe f ON f.id = from_id WHERE depth > 0",
)


def _prompt_lineage(spark, sf_dir):
    """Lineage of every prompt at once, three edges deep; a deleted prompt has no edge to its parent."""
    prompts = frame(spark, sf_dir, "prompt")
    paths = _forest(prompts, 3, ~F.col("deleted")).withColumn("via_edge", F.lit(L.PROMPT_DERIVED))
    names = prompts.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    about = prompts.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("_lang").alias("node_lang"), F.col("deleted").alias("node_deleted"))
    return paths.join(names, "from_id", "left").join(about, "node_id").select(
        "start_id", "depth", "from_id", "from_name", "via_edge", "node_id", "node_name", "node_lang", "node_deleted")


_PROMPT_EDGES = (
    "edges AS (SELECT 'SystemPrompt' AS source_type, id AS source_id, 'sp:derivedFrom' AS edge_type, 'SystemPrompt' AS target_type, derived_from AS target_id "
    "FROM prompt WHERE derived_from IS NOT NULL AND NOT deleted)"
)
_register(
    "g04_prompt_lineage", _prompt_lineage,
    f"WITH RECURSIVE {cte('prompt')}, {_PROMPT_EDGES}, {_walk_sql('edges', ('SystemPrompt', 'prompt'), None, 3)} "
    "SELECT start_id, depth, from_id, f.name AS from_name, via_edge, node_id, r.name AS node_name, r._lang AS node_lang, r.deleted AS node_deleted FROM walk "
    "JOIN prompt r ON r.id = node_id LEFT JOIN prompt f ON f.id = from_id WHERE depth > 0",
)
_register(
    "g05_min_depth",
    lambda s, d: L.min_depth(L.reach(edges(s, d), _start(s, "Card", START_CARD), 4).filter("depth > 0")),
    _WALK + "SELECT node_type, node_id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2",
)


def _recipe_reach(spark, sf_dir):
    """Smallest depth between every recipe and all it reaches, breadth first from all at once."""
    recipes = frame(spark, sf_dir, "recipe")
    starts = recipes.select(F.lit("Recipe").alias("node_type"), F.col("id").alias("node_id"))
    out = L.reach(L.recipe_edges(recipes), starts, 4)
    return out.filter("depth > 0").select("start_id", "node_id", "depth")


_register(
    "g05_reach_all_recipes", _recipe_reach,
    f"WITH RECURSIVE {cte('recipe')}, e AS (SELECT id AS a, derived_from AS b FROM recipe WHERE derived_from IS NOT NULL UNION SELECT derived_from, id FROM recipe "
    "WHERE derived_from IS NOT NULL), w AS (SELECT id AS s, id AS n, 0 AS depth FROM recipe UNION SELECT w.s, e.b, w.depth + 1 FROM w JOIN e ON w.n = e.a WHERE w.depth < 4) "
    "SELECT s AS start_id, n AS node_id, min(depth) AS depth FROM w WHERE s <> n GROUP BY 1, 2",
)
_register(
    "g06_undirected_edges",
    lambda s, d: L.undirected(edges(s, d), _start(s, "Card", START_CARD), 4).select("pair_key", "via_edge", "from_id", "node_id", "depth"),
    _WALK + ", k AS (SELECT *, least(from_id, node_id) || '|' || greatest(from_id, node_id) AS pair_key FROM walk WHERE depth > 0 AND from_id <> node_id) "
    "SELECT pair_key, via_edge, from_id, node_id, depth FROM k QUALIFY row_number() OVER (PARTITION BY pair_key, via_edge ORDER BY depth, from_id, node_id) = 1",
)


def _named(spark, sf_dir):
    names = L.entity_names(*[frame(spark, sf_dir, n) for n in ("card", "dataset", "distribution")])
    return L.named_both_ways(edges(spark, sf_dir), names).select("from_id", "from_name", "via_edge", "node_id", "node_name")


_register(
    "g07_node_names", _named,
    f"WITH {_EDGES}, names AS (SELECT 'Card' AS t, id, dataset_name AS name FROM card UNION ALL SELECT 'Dataset', id, name FROM dataset UNION ALL SELECT 'Distribution', id, name FROM distribution), "
    "b AS (SELECT source_type AS ft, source_id AS fi, edge_type AS e, target_type AS nt, target_id AS ni FROM edges UNION ALL SELECT target_type, target_id, edge_type, source_type, source_id FROM edges) "
    "SELECT fi AS from_id, f.name AS from_name, e AS via_edge, ni AS node_id, n.name AS node_name FROM b LEFT JOIN names f ON f.t = ft AND f.id = fi LEFT JOIN names n ON n.t = nt AND n.id = ni",
)


def _stepped(spark, sf_dir):
    walked = L.both_ways(edges(spark, sf_dir))
    out = L.with_steps(walked, frame(spark, sf_dir, "dataset"), frame(spark, sf_dir, "distribution"))
    return out.groupBy("from_type", "via_edge", "node_type", "from_step", "node_step").agg(F.count("*").alias("edges"))


_register(
    "j07_step_enrichment", _stepped,
    f"WITH {_EDGES}, b AS (SELECT source_type AS from_type, source_id AS fi, edge_type AS via_edge, target_type AS node_type, target_id AS ni FROM edges UNION ALL "
    "SELECT target_type, target_id, edge_type, source_type, source_id FROM edges) SELECT from_type, via_edge, node_type, coalesce(d1.step, x1.step) AS from_step, "
    "coalesce(d2.step, x2.step) AS node_step, count(*) AS edges FROM b LEFT JOIN dataset d1 ON from_type = 'Dataset' AND d1.id = fi LEFT JOIN distribution x1 ON from_type = 'Distribution' AND x1.id = fi "
    "LEFT JOIN dataset d2 ON node_type = 'Dataset' AND d2.id = ni LEFT JOIN distribution x2 ON node_type = 'Distribution' AND x2.id = ni GROUP BY 1, 2, 3, 4, 5",
)
