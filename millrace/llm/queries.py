"""The registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import dart_minhash, exact_dedup, importance_resampling, kd_search, license_rules, piece_dropout, pivotal_mix
from millrace.llm import quality_bands, substring_dedup, token_scan, vector_codes, warc_derivatives, wrapper_induction
from millrace.llm.stage import stored

QUERIES, ORACLES = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_bands.with_quality(docs).select("doc_id", "quality.*")


QUERIES["op9_compression_bands"] = _quality


def _licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_rules.with_licenses(docs).select("doc_id", "license.*")


QUERIES["op10_license_rules"] = _licenses


def _substrings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.removal_digest(docs)


QUERIES["op2_seed_extend"] = _substrings


def _near(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dart_minhash.with_classes(docs).select("doc_id", "class_id", "class_size")


QUERIES["op5_dart_minhash"] = _near


def _mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pivotal_mix.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


QUERIES["op8_pivotal_mix"] = _mix


def _pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_dropout.encoded_and_decoded(docs)


QUERIES["op3_piece_dropout"] = _pieces


def _nearest(spark, sf_dir):
    return kd_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["op4_kd_trees"] = _nearest
ORACLES["op4_kd_trees"] = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM sound q JOIN sound c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def _tokens(spark, sf_dir):
    return token_scan.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op1_separator_scan"] = _tokens


def _main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrapper_induction.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op7_wrapper_induction"] = _main_text


def _derivatives(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_derivatives.build_derivatives(warc_derivatives.page_responses(pages))


QUERIES["op6_warc_derivatives"] = _derivatives


def _resampled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance_resampling.draw(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op11_importance_resampling"] = _resampled
# A feature's bytes are taken from its hex form; the CRC table follows from the polynomial.
ORACLES["op11_importance_resampling"] = r"""
WITH steps AS (
    SELECT list(c ORDER BY i) AS step
    FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) t(i))
), docs AS (
    SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT k, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
    UNION ALL
    SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), occurrences AS (
    SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (
    SELECT k, f, count(*) AS n FROM occurrences GROUP BY k, f
), bucketed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT))),
                              lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)), steps
), shares AS (
    SELECT bucket, coalesce(sum(n) FILTER (k IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (k IS NULL), 0)::DOUBLE AS t
    FROM counted JOIN bucketed USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM shares) + 10000) / ((s + 1) * ((SELECT sum(t) FROM shares) + 10000)))) AS BIGINT) AS gain FROM shares
), sums AS (
    SELECT k, sum(n * gain) AS total, sum(n) AS n FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE k IS NOT NULL GROUP BY k
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
           CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM docs JOIN words USING (k) LEFT JOIN sums USING (k)
), noisy AS (
    SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL) AS n FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND score IS NOT NULL AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


def _codes(spark, sf_dir):
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    whole = vector_codes.with_label_errors(stored(codes, "codes"))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES["op12_cover_tree_codes"] = _codes


def _codes_sql(rounds=6):
    """The rounds as a chain of common tables, every part compared with every entry."""
    nearest = """a{r} AS (
    SELECT id, part, v, entry, d FROM (
        SELECT id, p.part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{r} USING (part))
    QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1
)"""
    update = """m{r} AS (
    SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS c FROM (
        SELECT part, entry, place, sum(x)::DOUBLE AS total, count(*) AS n
        FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{r}) GROUP BY ALL) GROUP BY part, entry
), b{next} AS (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(r=r), update.format(r=r, next=r + 1)]
    return f"""
WITH sound AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM sound, range(8) t(part)
), b0 AS (SELECT part, id - 1 AS entry, v AS c FROM p WHERE id <= 16),
{", ".join(steps).replace(" AS (", " AS MATERIALIZED (")},
{nearest.format(r=rounds)}, books AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
), codes AS (
    SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sound JOIN codes USING (id), books
"""


ORACLES["op12_cover_tree_codes"] = _codes_sql()


def _exact(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op13_exact_dedup"] = _exact
ORACLES["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""

QUERIES["pipeline"] = corpus_pipeline.run
