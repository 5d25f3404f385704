"""Duplicates over whole documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dedup as D
from millrace.plans.sql_text import sql_tokens
from millrace.plans.stats_query import data
from millrace.session import read_table
from millrace.sources.scan import union_by_name

QUERIES, ORACLES = {}, {}

QUERIES["w03_exact_duplicates"] = lambda s, d: D.drop_exact_duplicates(data(s, d)).select("doc_id", "_id_hash")
ORACLES["w03_exact_duplicates"] = "SELECT min(doc_id) AS doc_id, sha256(text) AS _id_hash FROM documents GROUP BY text"


def _groups(spark, sf_dir):
    return D.duplicate_groups(data(spark, sf_dir), "_id_hash", "doc_id")


QUERIES["w03_duplicate_groups"] = _groups
ORACLES["w03_duplicate_groups"] = (
    "SELECT sha256(text) AS _id_hash, min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1"
)


def both_sources(spark, sf_dir):
    """Documents and benchmark items as one set of records."""
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text", "source")
    items = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), "text")
    return union_by_name(docs, items)


QUERIES["s10_union_by_name"] = lambda s, d: both_sources(s, d).select("id", F.length("text").alias("chars"), "source")
ORACLES["s10_union_by_name"] = (
    "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, length(text) AS chars, source FROM documents UNION ALL "
    "SELECT 'b' || CAST(item_id AS VARCHAR), length(text), NULL FROM benchmark"
)


def _signatures(spark, sf_dir):
    signed = D.minhash(both_sources(spark, sf_dir), F.array_distinct(T.tokens(F.col("text"))), ["id"])
    return signed.select("id", F.size("signature").alias("slots"), F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature_md5"))


_BOTH = (
    "records AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), text FROM benchmark)"
)


def _minhash_sql(items: str) -> str:
    """CTEs up to ``signed(id, signature)``; ``items`` has ``id`` and ``item``. The arithmetic is in
    128-bit integers."""
    family = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(D.hash_family(D.NUM_HASHES)))
    code = " || ".join(f"substr(h, {7 - 2 * i}, 2)" for i in range(4))
    return (
        f"family(slot, a, b) AS (VALUES {family}), items AS ({items}), "
        f"codes AS (SELECT id, CAST('0x' || {code} AS HUGEINT) AS code FROM (SELECT DISTINCT id, sha1(item) AS h FROM items)), "
        "minima AS (SELECT id, slot, min((((a::HUGEINT * code + b) % 18446744073709551616) % 2305843009213693951) % 4294967296)::BIGINT AS m FROM codes, family GROUP BY id, slot), "
        "signed AS (SELECT id, list(m ORDER BY slot) AS signature FROM minima GROUP BY id)"
    )


QUERIES["w04_minhash_signature"] = _signatures
ORACLES["w04_minhash_signature"] = (
    f"WITH {_BOTH}, {_minhash_sql(f'SELECT id, unnest({sql_tokens("text")}) AS item FROM records')} "
    "SELECT id, CAST(coalesce(len(signature), 128) AS INTEGER) AS slots, "
    "md5(array_to_string(coalesce(signature, list_transform(range(128), lambda i: 4294967295)), ',')) AS signature_md5 FROM records LEFT JOIN signed USING (id)"
)

QUERIES["w05_near_duplicates"] = lambda s, d: D.near_duplicates(both_sources(s, d), "text", "id")
_RUNS = (
    "SELECT id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS item "
    f"FROM (SELECT id, {sql_tokens('lower(text)')} AS w FROM firsts)"
)
# Every pair that shares a band and reaches the threshold is a link.
ORACLES["w05_near_duplicates"] = f"""
WITH RECURSIVE {_BOTH}, firsts AS MATERIALIZED (SELECT min(id) AS id, text FROM records WHERE text IS NOT NULL GROUP BY text),
{_minhash_sql(_RUNS).replace("signed AS (", "signed AS MATERIALIZED (")},
banded AS MATERIALIZED (SELECT id, band, signature[band * 8 + 1 : band * 8 + 8] AS key FROM signed, range(16) t(band)),
near AS MATERIALIZED (
    SELECT a, b FROM (SELECT DISTINCT x.id AS a, y.id AS b FROM banded x JOIN banded y ON x.band = y.band AND x.key = y.key AND x.id > y.id)
    JOIN signed s ON s.id = a JOIN signed t ON t.id = b
    WHERE len(list_filter(list_zip(s.signature, t.signature), lambda z: z[1] = z[2])) >= 0.8 * 128
), edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS id, least(a, min(b)) AS root FROM reached GROUP BY a),
grown AS (
    SELECT f.id, coalesce(root, f.id) AS cluster, text FROM firsts f LEFT JOIN roots ON roots.id = f.id
), members AS (SELECT x.id, g.id AS first, cluster FROM records x JOIN grown g ON x.text = g.text)
SELECT m.id, m.cluster, len(list_filter(list_zip(s.signature, t.signature), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS similarity
FROM members m JOIN signed s ON s.id = m.first JOIN signed t ON t.id = m.cluster
WHERE m.cluster IN (SELECT cluster FROM members GROUP BY cluster HAVING count(*) > 1)
"""
