"""The lineage graph: typed edges, bounded traversal, reachability and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.catalog import first_per_key
from millrace.session import ensure_checkpoint_dir

# --- Fixed values: edge names --------------------------------------------------------
COMPOSES = "ml:composes"
DESCRIBES = "ml:describes"
MANIFESTS = "ml:manifests_as"
DATASET_PROCESSED = "ml:datasetProcessedBy"
REFINED = "ml:refinedBy"
DISTRIBUTION_PROCESSED = "ml:distributionProcessedBy"
RECIPE_DERIVED = "recipe:derivedFrom"
PROMPT_DERIVED = "sp:derivedFrom"


def _edge(df: DataFrame, source_type: str, source: str, name, target_type: str, target: str) -> DataFrame:
    return df.select(
        F.lit(source_type).alias("source_type"), F.col(source).alias("source_id"),
        (F.lit(name) if isinstance(name, str) else name).alias("edge_type"),
        F.lit(target_type).alias("target_type"), F.col(target).alias("target_id"),
    )


def catalog_edges(cards: DataFrame, composition: DataFrame, datasets: DataFrame, distributions: DataFrame) -> DataFrame:
    """All typed edges between cards, datasets and distributions."""
    parents = cards.select(F.col("dataset_name").alias("parent_card_name"), F.col("id").alias("parent_id"))
    children = cards.select(F.col("dataset_name").alias("child_card_name"), F.col("id").alias("child_id"))
    composed = composition.join(parents, "parent_card_name").join(children, "child_card_name")
    described = datasets.join(cards.select(F.col("id").alias("derived_card")), "derived_card")
    manifested = distributions.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id")
    older = datasets.select(F.col("id").alias("derived_dataset"), F.col("step").alias("parent_step"))
    processed = datasets.join(older, "derived_dataset").filter("step > parent_step")
    origin = distributions.select(F.col("id").alias("derived_from"), F.col("step").alias("parent_step"))
    owner = datasets.select(F.col("id").alias("dataset_id"), F.col("derived_card").alias("owner_card"))
    # One join gives both kinds of distribution edge.
    derived = distributions.join(origin, "derived_from").filter("step >= parent_step").join(owner, "dataset_id", "left")
    derived = derived.filter("step > parent_step OR owner_card IS NOT NULL")
    kind = F.when(F.col("step") > F.col("parent_step"), DISTRIBUTION_PROCESSED).otherwise(REFINED)
    return reduce(
        DataFrame.unionByName,
        [
            _edge(composed, "Card", "parent_id", COMPOSES, "Card", "child_id"),
            _edge(described, "Card", "derived_card", DESCRIBES, "Dataset", "id"),
            _edge(manifested, "Dataset", "dataset_id", MANIFESTS, "Distribution", "id"),
            _edge(processed, "Dataset", "id", DATASET_PROCESSED, "Dataset", "derived_dataset"),
            _edge(derived, "Distribution", "id", kind, "Distribution", "derived_from"),
        ],
    )


def recipe_edges(recipes: DataFrame) -> DataFrame:
    return _edge(recipes.filter("derived_from is not null"), "Recipe", "id", RECIPE_DERIVED, "Recipe", "derived_from")


def prompt_edges(prompts: DataFrame) -> DataFrame:
    live = prompts.filter(F.col("derived_from").isNotNull() & ~F.col("deleted"))
    return _edge(live, "SystemPrompt", "id", PROMPT_DERIVED, "SystemPrompt", "derived_from")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(from_type, from_id, via_edge, node_type, node_id)`` in either direction, so that
    walking an edge from any end is one equi-join."""
    forward = _forward(edges)
    return forward.select(F.inline(F.array(_way("from", "node", ["type", "id"]), _way("node", "from", ["type", "id"]))))


def _forward(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("source_type").alias("from_type"), F.col("source_id").alias("from_id"), F.col("edge_type").alias("via_edge"),
        F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id"),
    )


def _way(start: str, end: str, fields: list[str]) -> Column:
    """An edge walked from one end; a row gives both ways, so that its joins are run once."""
    return F.struct(*[F.col(f"{start}_{x}").alias(f"from_{x}") for x in fields], "via_edge", *[F.col(f"{end}_{x}").alias(f"node_{x}") for x in fields])


def _marker(kind: str, identity: str):
    return F.concat_ws(":", kind, identity)


#: A frontier of up to so many rows is sent to the tasks that read the edges.
FEW_ROWS = 100_000


def _meet(here: DataFrame, rows: int, steps: DataFrame) -> DataFrame:
    """``here`` joined to the edges that leave its nodes. While it is small the edges are read where
    they lie; the size of a checkpoint is not known to the planner, which would shuffle them all."""
    return (F.broadcast(here) if rows <= FEW_ROWS else here).join(steps, ["from_type", "from_id"])


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """One row per simple path prefix from each of ``starts(node_type, node_id)``, up to
    ``max_depth`` edges; ``start_type`` and ``start_id`` tell the starts apart.

    Each level is checkpointed: the next level and the result both read it.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    steps = both_ways(edges).checkpoint()
    frontier = starts.select(
        F.col("node_type").alias("start_type"), F.col("node_id").alias("start_id"), "node_type", "node_id",
        F.array(_marker("node_type", "node_id")).alias("path"),
    )
    levels, rows = [], frontier.count()
    for depth in range(1, max_depth + 1):
        here = frontier.select("start_type", "start_id", F.col("node_type").alias("from_type"), F.col("node_id").alias("from_id"), "path")
        walked = _meet(here, rows, steps).filter(~F.array_contains("path", _marker("node_type", "node_id")))
        frontier = walked.select(
            "start_type", "start_id", F.lit(depth).alias("depth"), "from_type", "from_id", "via_edge", "node_type", "node_id",
            F.array_append("path", _marker("node_type", "node_id")).alias("path"),
        ).checkpoint()
        levels.append(frontier.drop("path"))
        rows = frontier.count()
        if not rows:
            break
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Smallest depth of every node reachable from each start: breadth first, one row per
    start and node, so dense graphs do not multiply paths."""
    ensure_checkpoint_dir(edges.sparkSession)
    return _reach(both_ways(edges).select("from_type", "from_id", "node_type", "node_id").checkpoint(), starts, max_depth)[0]


def _reach(steps: DataFrame, starts: DataFrame, max_depth: int) -> tuple[DataFrame, int]:
    """``reach`` over stored steps, which may repeat, and the number of its rows."""
    node = ["start_type", "start_id", "node_type", "node_id"]
    frontier = starts.select(
        F.col("node_type").alias("start_type"), F.col("node_id").alias("start_id"), "node_type", "node_id", F.lit(0).alias("depth")
    )
    seen, rows = frontier, frontier.count()
    total = rows
    for depth in range(1, max_depth + 1):
        here = frontier.select("start_type", "start_id", F.col("node_type").alias("from_type"), F.col("node_id").alias("from_id"))
        found = _meet(here, rows, steps).select(*node).distinct()
        frontier = found.join(seen, node, "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        rows = frontier.count()
        if not rows:
            break
        seen, total = seen.unionByName(frontier), total + rows
    return seen, total


def ancestors_within(parents: DataFrame, max_depth: int) -> DataFrame:
    """``(node, ancestor, distance)`` up to ``max_depth`` steps, each node being its own at 0, from
    ``(node, parent)`` with one parent at most.

    Pointer doubling: the ancestors within 2^k steps, looked up again from the one exactly 2^k steps
    away, are those within 2^(k+1). The rounds grow with the logarithm of the depth and a hub with
    many children is looked up, never paired. A node on a cycle is no ancestor of itself.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    one = parents.filter("parent IS NOT NULL AND parent <> node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    up, reached = one.checkpoint(), 1
    while reached < max_depth:
        jump = up.filter(F.col("distance") == reached).select("node", F.col("ancestor").alias("via"))
        if jump.isEmpty():
            break
        beyond = up.select(F.col("node").alias("via"), "ancestor", (F.col("distance") + reached).alias("distance"))
        more = jump.join(beyond, "via").filter(F.col("distance") <= max_depth).select("node", "ancestor", "distance")
        up, reached = up.unionByName(more).checkpoint(), 2 * reached
    own = parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    shortest = up.filter("node <> ancestor").unionByName(own).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
    return shortest


def forest_lineage(parents: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """``(start_id, depth, from_id, node_id)``: all nodes within ``max_depth`` edges of each of
    ``starts(node)``, edges walked in both directions, in a forest ``(node, parent)``.

    Between two nodes of a tree there is one simple path, up to their nearest common ancestor and
    down again, so no path is kept: the ancestors of the starts meet the ancestors of all nodes.
    ``from_id`` is the node before on the path.
    """
    up = ancestors_within(parents, max_depth).checkpoint()
    own = starts.select("node").distinct().join(up, "node").select(F.col("node").alias("start_id"), "ancestor", F.col("distance").alias("rise"))
    # A start asks for the distances it can still go, so nodes that lie too deep are never paired.
    asked = own.withColumn("fall", F.explode(F.sequence(F.lit(0), F.lit(max_depth) - F.col("rise"))))
    met = asked.join(up.select(F.col("node").alias("node_id"), "ancestor", F.col("distance").alias("fall")), ["ancestor", "fall"])
    # The nearest common ancestor gives the shortest way.
    best = met.groupBy("start_id", "node_id").agg(F.min(F.col("rise") + F.col("fall")).alias("depth"), F.min_by("rise", F.col("rise") + F.col("fall")).alias("rise"))
    best = best.filter("start_id <> node_id AND depth > 0")
    below = own.select("start_id", (F.col("rise") + 1).alias("rise"), F.col("ancestor").alias("below"))
    of = parents.select(F.col("node").alias("node_id"), F.col("parent").alias("above"))
    placed = best.join(of, "node_id").join(below, ["start_id", "rise"], "left")
    came = F.when(F.col("depth") == F.col("rise"), F.col("below")).otherwise(F.col("above"))
    return placed.select("start_id", "depth", came.alias("from_id"), "node_id")


def min_depth(paths: DataFrame) -> DataFrame:
    return paths.groupBy("node_type", "node_id").agg(F.min("depth").alias("depth"))


def undirected(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Edges within reach without loops, each pair and edge type once, seen from its nearer end;
    ``depth`` is the number of edges from the start to the farther one."""
    ensure_checkpoint_dir(edges.sparkSession)
    steps = both_ways(edges).checkpoint()
    near, rows = _reach(steps, starts, max_depth - 1)
    near = near.groupBy(F.col("node_type").alias("from_type"), F.col("node_id").alias("from_id")).agg((F.min("depth") + 1).alias("depth"))
    paths = _meet(near, rows, steps)
    pair = F.array_join(F.array_sort(F.array("from_id", "node_id")), "|")
    walked = paths.filter("from_id <> node_id").withColumn("pair_key", pair)
    return first_per_key(walked, ["pair_key", "via_edge"], ["depth", "from_id", "node_id"])


def with_steps(paths: DataFrame, datasets: DataFrame, distributions: DataFrame) -> DataFrame:
    """Layer step of both ends of a walked edge; cards have none."""
    steps = datasets.select(F.lit("Dataset").alias("t"), "id", "step").unionByName(
        distributions.select(F.lit("Distribution").alias("t"), "id", "step")
    )
    ends = {
        end: steps.select(F.col("t").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"), F.col("step").alias(f"{end}_step"))
        for end in ("node", "from")
    }
    out = paths.join(ends["node"], ["node_type", "node_id"], "left")
    return out.join(ends["from"], ["from_type", "from_id"], "left")


def with_names(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Names of both ends from ``names(type, id, name)``."""
    out = paths
    for end in ("from", "node"):
        side = names.select(F.col("type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
        out = out.join(side, [f"{end}_type", f"{end}_id"], "left")
    return out


def named_both_ways(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``both_ways`` with the names of both ends. Each edge meets the names once and is turned then."""
    named, fields = with_names(_forward(edges), names), ["type", "id", "name"]
    return named.select(F.inline(F.array(_way("from", "node", fields), _way("node", "from", fields))))


def entity_names(cards=None, datasets=None, distributions=None, recipes=None, prompts=None) -> DataFrame:
    parts = []
    for kind, df, column in (
        ("Card", cards, "dataset_name"), ("Dataset", datasets, "name"), ("Distribution", distributions, "name"),
        ("Recipe", recipes, "name"), ("SystemPrompt", prompts, "name"),
    ):
        if df is not None:
            parts.append(df.select(F.lit(kind).alias("type"), "id", F.col(column).alias("name")))
    return reduce(DataFrame.unionByName, parts)
