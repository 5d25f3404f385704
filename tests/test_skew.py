"""One key holding a third of the rows must neither fail nor lose rows."""

from pyspark.sql import functions as F

from millrace.functions.chat_stats import chat_stats_of_turns
from millrace.operators import catalog as K
from millrace.operators import dedup as D
from millrace.operators import lineage as L
from millrace.operators import relate as R
from millrace.operators.recipe import training_table

ROWS = 90_000


def hot(spark):
    """A third of the rows share the key 0."""
    return spark.range(ROWS).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))


def test_exact_duplicates_keep_one(spark):
    kept = D.drop_exact_duplicates(hot(spark), "k", "id")
    assert kept.count() == ROWS - ROWS // 3 + 1
    assert kept.filter("k = 0").first().id == 0


def test_keep_first(spark):
    out = K.first_per_key(hot(spark), ["k"], [-F.col("id")])
    assert out.count() == ROWS - ROWS // 3 + 1 and out.filter("k = 0").first().id == ROWS - 3


def test_a_huge_conversation_is_aggregated_not_collected(spark):
    turns = hot(spark).select("k", "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("one two").alias("text"))
    stats = chat_stats_of_turns(turns, "k", "id", "role", "text")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortAggregate" not in plan
    row = stats.filter("id = 0").first()
    assert row._message_count == ROWS // 3 and row._user_word_count == 2 * row._user_message_count


def test_near_duplicate_links_stay_linear(spark):
    signatures = spark.range(3000).select("id", F.array_repeat(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")), 128).alias("signature"))
    links = D.verified_links(signatures, "id", 0.8)
    assert links.count() == 999 and links.select("b").distinct().count() == 1


def test_containment_with_a_prefix_common_to_all(spark):
    """All right values begin alike; only whole ones that occur are joined."""
    right = spark.range(2000).select(F.concat(F.lit("a-long-common-prefix-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), "id")
    left = spark.range(3000).select(F.concat(F.lit("x/a-long-common-prefix-"), F.lpad((F.col("id") % 1500 * 2).cast("string"), 6, "0"), F.lit("/y")).alias("listed"))
    joined = R.containment_join(left, "listed", right, "name")
    assert joined.count() == 3000 and joined.filter("id is not null").count() == 2000


def test_a_hot_source_is_sampled_and_repeated_whole(spark):
    rows = hot(spark).select("id", F.when(F.col("k") == 0, "big").otherwise("rest").alias("source"))
    mix = spark.createDataFrame([("big", 2.0), ("rest", 1.0)], "source string, replica double")
    counts = {r.source: r["count"] for r in training_table(rows, mix, ["source"], "id").groupBy("source").count().collect()}
    assert counts == {"big": 2 * ROWS // 3, "rest": ROWS - ROWS // 3}


def test_a_hub_of_the_lineage_is_looked_up_not_paired(spark):
    """A third of all nodes have one parent; the ancestors stay one row per node and step."""
    parents = spark.range(ROWS // 3).selectExpr("id AS node", "IF(id = 0, NULL, IF(id % 3 = 0, 0, id - 1)) AS parent")
    up = L.ancestors_within(parents, 5)
    assert up.count() <= 6 * ROWS // 3
    near = L.forest_lineage(parents, spark.createDataFrame([(7,)], "node long"), 2)
    assert sorted((r.depth, r.node_id) for r in near.collect()) == [(1, 6), (1, 8), (2, 0)]
