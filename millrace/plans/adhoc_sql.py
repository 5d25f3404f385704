"""Conformance of the ad-hoc SQL surface: plain statements both engines run alike."""

from __future__ import annotations

from millrace.operators.adhoc import run_sql
from millrace.session import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

# name -> (Spark SQL, oracle SQL or None when the same text serves both)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "q01_over_distribution": (
        "SELECT lang, count(*) AS records, sum(n_chars) AS chars FROM documents WHERE n_chars > 100 GROUP BY lang",
        "SELECT lang, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars > 100 GROUP BY lang",
    ),
    "q04_filter_project": ("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'", None),
    "q04_inner_join": (
        "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey "
        "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None,
    ),
    "q04_left_join": (
        "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", None,
    ),
    "q04_full_join": (
        "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey) a "
        "FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) b ON a.k = b.k", None,
    ),
    "q04_semi_join": (
        "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)", None,
    ),
    "q04_anti_join": (
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None,
    ),
    "q04_small_cross_join": (
        "SELECT r_name, s.o_orderstatus, s.n FROM region CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) s", None,
    ),
    "q04_theta_join": (
        "SELECT a.n_nationkey AS low, count(*) AS higher FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey", None,
    ),
    "q04_group_by": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, "
        "count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None,
    ),
    "q04_distinct_aggregate": (
        "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey", None,
    ),
    "q04_grouping_sets": (
        "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS biggest FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())", None,
    ),
    "q04_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "q04_rollup": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "q04_ranking": (
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders", None,
    ),
    "q04_analytic": (
        "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", None,
    ),
    "q04_frames": (
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, "
        "max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events", None,
    ),
    "q04_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "q04_top_k_per_group": (
        "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT l_suppkey, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r "
        "FROM lineitem) WHERE r <= 3", None,
    ),
    "q04_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "q04_intersect": ("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20", None),
    "q04_except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount < 0.02", None),
    "q04_strings": (
        "SELECT p_partkey, upper(p_name) AS up, concat(p_brand, '-', p_type) AS joined, substring(p_name, 2, 4) AS cut, replace(p_name, 'r', 'R') AS swapped, length(p_name) AS n, "
        "lpad(cast(p_size AS string), 4, '0') AS padded, split_part(p_name, ' ', 2) AS second, instr(p_name, 'i') AS at FROM part", None,
    ),
    "q04_dates": (
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, cast(date_trunc('month', o_orderdate) AS string) AS first FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS first FROM orders",
    ),
    "q04_math": (
        "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS lo, ceil(l_extendedprice) AS hi, round(sqrt(l_extendedprice), 4) AS root, abs(l_discount - 0.05) > 0.02 AS far, l_orderkey % 7 AS rest, round(ln(l_quantity), 5) AS log FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS lo, CAST(ceil(l_extendedprice) AS BIGINT) AS hi, round(sqrt(l_extendedprice), 4) AS root, abs(l_discount - 0.05) > 0.02 AS far, l_orderkey % 7 AS rest, round(ln(l_quantity), 5) AS log FROM lineitem",
    ),
    "q04_arrays": (
        "SELECT doc_id, size(w) AS n, array_contains(w, 'the') AS has_the, element_at(w, 1) AS head, size(array_distinct(w)) AS uniq FROM (SELECT doc_id, split(text, ' ') AS w FROM documents)",
        "SELECT doc_id, CAST(len(w) AS INT) AS n, list_contains(w, 'the') AS has_the, w[1] AS head, CAST(len(list_distinct(w)) AS INT) AS uniq FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
    ),
    "q04_json": (
        "SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k, get_json_object(props, '$.none') AS none FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS none FROM events",
    ),
    "q04_explode": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(lower(text), ' ')) AS word FROM documents) WHERE length(word) > 3 GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE length(word) > 3 GROUP BY word",
    ),
    "q04_case_null": (
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'fair' END AS kind, nullif(c_mktsegment, 'BUILDING') AS seg, coalesce(nullif(c_mktsegment, 'BUILDING'), 'x') AS seg2 FROM customer", None,
    ),
    "q04_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "q04_cte": (
        "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, round(avg(total), 2) AS mean FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", None,
    ),
    "q04_conditional_aggregate": (
        "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE event_type = 'purchase') AS best FROM events GROUP BY user_id", None,
    ),
    "q04_percentiles": (
        "SELECT c_mktsegment, median(c_acctbal) AS mid, percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p90 FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, round(median(c_acctbal), 4) AS mid, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY c_mktsegment",
    ),
    "q04_exclude_columns": (
        "SELECT * EXCEPT (text, n_chars), split_part(source, 'c', 2) AS number FROM documents",
        "SELECT * EXCLUDE (text, n_chars), split_part(source, 'c', 2) AS number FROM documents",
    ),
    "q04_pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open, 'F' AS final))",
        "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS open, sum(l_quantity) FILTER (l_linestatus = 'F') AS final FROM lineitem GROUP BY 1",
    ),
}
STATEMENTS["q04_percentiles"] = (
    "SELECT c_mktsegment, round(median(c_acctbal), 4) AS mid, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90 FROM customer GROUP BY c_mktsegment",
    STATEMENTS["q04_percentiles"][1],
)


def _run(sql):
    def run(spark, sf_dir):
        used = [name for name in TABLES if name in sql]
        return run_sql(spark, {name: read_table(spark, sf_dir, name) for name in used}, sql)

    return run


QUERIES = {name: _run(sql) for name, (sql, _) in STATEMENTS.items()}
ORACLES = {name: other or sql for name, (sql, other) in STATEMENTS.items()}
