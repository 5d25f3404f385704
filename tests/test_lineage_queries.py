"""The lineage queries on tables of their own."""

from millrace.plans import registry


def test_every_recipe_and_prompt_is_a_start(spark, tmp_path):
    spark.range(1, 4).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "id AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 4).selectExpr(
        "id AS p_partkey", "concat('p', id) AS p_name", "'t' AS p_type", "'b' AS p_brand", "1 AS p_size"
    ).write.parquet(f"{tmp_path}/part.parquet")
    queries = registry()[0]
    for name, prefix in (("g03_recipe_lineage", "rec-"), ("g04_prompt_lineage", "sp-")):
        # 3 comes from 1; 1 and 2 come from 0, which is no row. No key is divisible by 20.
        got = {(r.start_id, r.depth, r.from_id, r.node_id) for r in queries[name](spark, str(tmp_path)).collect()}
        one, three = f"{prefix}1", f"{prefix}3"
        assert got == {(one, 1, one, three), (three, 1, three, one)}


def test_walks_from_few_and_from_many_nodes_agree(spark, monkeypatch):
    """A small frontier is sent to the edges, a large one meets them by a shuffle; repeated edges,
    loops and null ends included."""
    from millrace.operators import lineage as L

    rows = [("N", s, "e", "N", t) for s, t in [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "d"), ("d", "a"), (None, "a"), ("d", None), ("x", "y")]]
    edges = spark.createDataFrame(rows, "source_type string, source_id string, edge_type string, target_type string, target_id string")
    start = spark.createDataFrame([("N", "a")], "node_type string, node_id string")
    names = spark.createDataFrame([("N", "a", "A"), ("N", "c", "C")], "type string, id string, name string")

    def results():
        frames = [L.traverse(edges, start, 3), L.reach(edges, start, 3), L.undirected(edges, start, 3)]
        return [sorted(map(tuple, f.collect()), key=str) for f in frames]

    few = results()
    monkeypatch.setattr(L, "FEW_ROWS", 0)
    assert few == results()
    assert {(r[3], r[4]) for r in few[1] if r[3]} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    ways = L.both_ways(edges)
    want = L.with_names(ways, names).select("from_id", "from_name", "via_edge", "node_id", "node_name")
    got = L.named_both_ways(edges, names).select(*want.columns)
    assert ways.count() == 2 * len(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
