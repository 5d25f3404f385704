"""Catalog frames derived from the relational tables, for Spark and for the oracle.

Cards come from customers, datasets from orders, distributions and strategies from
line items, recipes from suppliers, prompts from parts, so the catalog grows with
them. The expressions are plain SQL both engines read alike.
"""

from __future__ import annotations

from millrace.session import read_table


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _int(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def _card_name(key: str) -> str:
    return f"'customer_' || lpad({_s(key)}, 9, '0')"


_DIST_KEY = "l_orderkey, l_linenumber"
# frame -> (source table, grouping or None, {column: expression}, condition or None)
FRAMES = {
    "card": ("customer", None, {
        "id": f"'card-' || {_s('c_custkey')}",
        "dataset_name": _card_name("c_custkey"),
        "dataset_id": f"'ds-' || {_s('c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END')}",
        "languages": "split(CASE WHEN c_nationkey % 7 = 6 THEN 'xx,en' WHEN c_nationkey % 3 = 0 THEN 'en,fr' "
                     "WHEN c_nationkey % 3 = 1 THEN 'de' ELSE 'es,it' END, ',')",
        "license": "CASE c_mktsegment WHEN 'BUILDING' THEN 'mit' WHEN 'MACHINERY' THEN 'apache_2' "
                   "WHEN 'HOUSEHOLD' THEN 'cc_by' WHEN 'FURNITURE' THEN 'unknown' ELSE 'homemade' END",
        "core_skills": f"split(CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'mix' "
                       f"ELSE 'skill_' || {_s('c_custkey % 6')} END, ',')",
        "tasks": f"split(CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'mix' "
                 f"WHEN c_custkey % 31 = 0 THEN 'task_1,task_2' ELSE 'task_' || {_s('c_custkey % 10')} END, ',')",
        "sources": f"split('src_' || {_s('c_custkey % 4')} || ',src_' || {_s('c_custkey % 9')}, ',')",
        "fields": f"split('field_' || {_s('c_custkey % 5')}, ',')",
        "vertical": f"split('vert_' || {_s('c_custkey % 3')}, ',')",
        "contents": f"split('cont_' || {_s('c_custkey % 8')}, ',')",
        "source_type": "CASE WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'synthetic' END",
        "quality": "CAST(CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 1 + c_custkey % 6 END AS INT)",
        "created_at": f"CAST('2024-01-' || lpad({_s('1 + c_custkey % 28')}, 2, '0') || ' 00:00:00' AS TIMESTAMP)",
        "source_url": f"CASE WHEN c_custkey % 29 = 0 THEN 'ftp://old' WHEN c_custkey % 7 = 0 THEN '' "
                      f"ELSE 'https://hub.example.org/' || {_s('c_custkey')} END",
        "notes": "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END",
    }, None),
    "composition": ("customer", None, {
        "parent_card_name": _card_name(f"CASE WHEN c_custkey % 40 = 0 THEN c_custkey ELSE {_int('c_custkey / 2')} END"),
        "child_card_name": _card_name("c_custkey"),
        "weight": "CAST((c_custkey % 120) / 100.0 AS DECIMAL(4,2))",
    }, "c_custkey > 0"),
    "dataset": ("orders", None, {
        "id": f"'dset-' || {_s('o_orderkey')}",
        "uri": f"CASE WHEN o_orderkey % 10 = 0 THEN 'file:///data/mapped/g' || {_s(_int('o_orderkey / 10'))} "
               f"WHEN o_orderkey % 10 < 6 THEN 'file:///data/mapped/g' || {_s(_int('o_orderkey / 10'))} || '/s' || {_s('o_orderkey % 10')} "
               f"WHEN o_orderkey % 10 = 9 THEN 'data/raw/' || {_s('o_orderkey')} "
               f"ELSE 'file:///data/processed/' || {_s('o_orderkey')} || '/x/y' END",
        "name": f"'dataset_' || {_s('o_orderkey - CASE WHEN o_orderkey % 37 = 1 THEN 1 ELSE 0 END')}",
        "derived_card": f"'card-' || {_s('o_custkey')}",
        "derived_dataset": f"CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'dset-' || {_s(_int('o_orderkey / 4'))} END",
        "languages": "split(CASE WHEN o_orderkey % 5 = 0 THEN 'en' WHEN o_orderkey % 5 = 1 THEN 'en,fr' "
                     "WHEN o_orderkey % 5 = 2 THEN 'de' ELSE 'es,xx' END, ',')",
        "version": "CASE o_orderkey % 6 WHEN 0 THEN '1.0' WHEN 1 THEN '1.0.3' WHEN 2 THEN 'bad' WHEN 3 THEN NULL "
                   "WHEN 4 THEN '2' ELSE '3.x.1' END",
        "license": "CASE WHEN o_orderkey % 2 = 0 THEN 'mit' ELSE 'cc_by' END",
        "dataset_type": "lower(o_orderstatus)",
        "description": "lower(o_orderpriority)",
        "step": "CAST(1 + o_orderkey % 3 AS INT)",
    }, None),
    "distribution": ("lineitem", _DIST_KEY, {
        "id": f"'dist-' || {_s('l_orderkey')} || '-' || {_s('l_linenumber')}",
        "dataset_id": f"'dset-' || {_s('l_orderkey')}",
        "name": f"'part ' || {_s('l_orderkey')} || ' ' || {_s('l_linenumber')}",
        "description": "min(lower(l_returnflag)) || ' slice'",
        "uri": f"'file:///data/' || CASE WHEN l_linenumber % 4 = 0 THEN 'mapped' ELSE 'processed' END || '/d' || {_s('l_orderkey')} || '/p' || {_s('l_linenumber')}",
        "lang": "CASE min(l_suppkey) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'it' END",
        "split": "CASE min(l_returnflag) WHEN 'A' THEN 'train' WHEN 'N' THEN 'test' ELSE 'validation' END",
        "license": "CASE WHEN min(l_partkey) % 3 = 0 THEN 'mit' ELSE 'cc_by' END",
        "materialized": "min(l_linestatus) = 'O'",
        "derived_from": f"CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'dist-' || {_s(_int('l_orderkey / 4'))} || '-' || {_s('l_linenumber')} END",
        "step": "CAST(CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 + l_orderkey % 3 END AS INT)",
        "tags": "split('t' || CAST(l_linenumber AS STRING) || ',all', ',')",
        "supplier": "min(l_suppkey)",
        "part": "min(l_partkey)",
        "samples": "min(l_partkey) + 1",
        "tokens": "(min(l_partkey) + 1) * 37",
        "words": "(min(l_partkey) + 1) * 23",
        "factor": "CAST(max(l_quantity) / 20 AS DECIMAL(6,2))",
        "chat_type": "CASE min(l_partkey) % 3 WHEN 0 THEN 'simple_chat' WHEN 1 THEN 'context_chat' ELSE NULL END",
    }, None),
    "recipe": ("supplier", None, {
        "id": f"'rec-' || {_s('s_suppkey')}",
        "name": "lower(s_name)",
        "description": f"'mix for nation ' || {_s('s_nationkey')}",
        "scope": "CASE WHEN s_suppkey % 2 = 0 THEN 'sft' ELSE 'dpo' END",
        "tags": f"split('n' || {_s('s_nationkey')}, ',')",
        "version": "'1.0'",
        "derived_from": f"CASE WHEN s_suppkey = 0 OR s_suppkey % 5 = 4 THEN NULL ELSE 'rec-' || {_s(_int('s_suppkey / 3'))} END",
    }, None),
    "prompt": ("part", None, {
        "id": f"'sp-' || {_s('p_partkey')}",
        "name": f"p_name || ' ' || {_s('p_partkey')}",
        "description": "lower(p_type)",
        "prompt": "p_name || ' by ' || p_brand || ' of size ' || CAST(p_size AS STRING)",
        "_lang": "CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'it' WHEN 2 THEN 'fr' ELSE 'un' END",
        "length": "CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE length(p_name || ' by ' || p_brand || ' of size ' || CAST(p_size AS STRING)) END AS INT)",
        "derived_from": f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'sp-' || {_s(_int('p_partkey / 3'))} END",
        "deleted": "p_partkey % 10 = 0",
        "version": f"'1.' || {_s('p_partkey % 7')}",
        "quality_score": "CAST((p_partkey % 101) / 20.0 AS DECIMAL(3,2))",
    }, None),
    "taxonomy": ("part", "1, 2", {
        "task_code": f"'task_' || {_s('p_partkey % 10')}",
        "skill_code": f"'skill_' || {_s('p_partkey % 6')}",
    }, "p_partkey % 3 <> 0"),
    "vocab_language": ("region", None, {
        "code": "CASE r_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'it' END",
        "description": "r_name",
    }, None),
    "vocab_license": ("region", None, {
        "code": "CASE r_regionkey WHEN 0 THEN 'mit' WHEN 1 THEN 'apache_2' WHEN 2 THEN 'cc_by' WHEN 3 THEN 'unknown' ELSE 'gpl_3' END",
        "description": "lower(r_name)",
    }, None),
    "vocab_skill": ("part", "1, 2", {
        "code": f"'skill_' || {_s('p_partkey % 5')}",
        "description": f"'Skill number ' || {_s('p_partkey % 5')}",
    }, None),
}


def frame(spark, sf_dir, name):
    source, grouping, columns, condition = FRAMES[name]
    df = read_table(spark, sf_dir, source)
    if condition:
        df = df.filter(condition)
    picks = [f"{expr} AS `{alias}`" for alias, expr in columns.items()]
    if grouping is None:
        return df.selectExpr(*picks)
    if grouping == _DIST_KEY:
        return df.groupBy("l_orderkey", "l_linenumber").agg(*_grouped(columns)).drop("l_orderkey", "l_linenumber")
    return df.selectExpr(*picks).distinct()


def _grouped(columns):
    from pyspark.sql import functions as F

    keys = {"l_orderkey": "max(l_orderkey)", "l_linenumber": "max(l_linenumber)"}
    out = []
    for alias, expr in columns.items():
        if "min(" not in expr and "max(" not in expr:
            for key, value in keys.items():
                expr = expr.replace(key, value)
        out.append(F.expr(expr).alias(alias))
    return out


def cte(*names: str) -> str:
    """``name AS (...)`` definitions for the oracle."""
    parts = []
    for name in names:
        source, grouping, columns, condition = FRAMES[name]
        picks = ", ".join(f'{expr} AS "{alias}"' for alias, expr in columns.items())
        where = f" WHERE {condition}" if condition else ""
        group = f" GROUP BY {grouping}" if grouping else ""
        parts.append(f"{name} AS (SELECT {picks} FROM {source}{where}{group})")
    return ", ".join(parts)
