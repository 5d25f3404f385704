"""Silo joins, filters and profiles over whole documents."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import functions as F

from millrace.functions.chat_stats import chat_stats_of_messages
from millrace.functions.low_stats import low_level_stats
from millrace.operators import profile as P
from millrace.operators.sampling import hash_sample
from millrace.operators.silo_store import Store, join_store, write_store
from millrace.operators.stats_query import enrich, one_row_per_id
from millrace.plans.chat_stats import CHAT_SQL, _DOC, document_messages
from millrace.plans.low_stats import stats_cte
from millrace.session import ensure_checkpoint_dir, read_table

QUERIES, ORACLES = {}, {}


def _register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def data(spark, sf_dir):
    """Documents as standard records keyed by content hash and language."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", "text", F.col("lang").alias("_lang"), F.col("source").alias("_dataset_name"),
        F.concat_ws("/", "source", "lang").alias("_subpath"),
        # Never null, so that joins need no second hash for a null check.
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("_id_hash"),
    )


def silo(spark, sf_dir):
    """One statistics row per content hash. Copies collapse after the measuring, so only
    numbers are shuffled, never texts."""
    return one_row_per_id(low_level_stats(data(spark, sf_dir), "text", "_id_hash", "_lang"))


def chat_silo(spark, sf_dir):
    """One conversation-statistics row per content hash, which is taken from the row itself: no
    text is joined or shuffled."""
    keyed = document_messages(spark, sf_dir, F.coalesce(F.sha2("text", 256), F.lit("")).alias("_id_hash"))
    return one_row_per_id(chat_stats_of_messages(keyed, "messages", "_id_hash", "_lang"))


def write_stored_silo(spark, sf_dir):
    """The documents and their two silos as a new store."""
    # A store belongs to a session and to the folder its tables were read from.
    store = silo_name(sf_dir)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/silo-{uuid.uuid4().hex}"
    write_store(store, folder, data(spark, sf_dir), silo(spark, sf_dir), chat_silo(spark, sf_dir))
    return store


def silo_name(sf_dir):
    return Store(f"silo_{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:16]}")


def stored_silo(spark, sf_dir):
    """The store of these tables, written at first use in a session."""
    store = silo_name(sf_dir)
    return store if store.exists(spark) else write_stored_silo(spark, sf_dir)


def _stored_rows(spark, sf_dir):
    """What the store holds: every record once, one row of either silo per content."""
    store = stored_silo(spark, sf_dir)
    data_rows = [spark.table(store.table("data", hot)).select(F.lit("data").alias("part"), F.col("_id_hash").alias("id")) for hot in (False, True)]
    silo_rows = [spark.table(store.table(part)).select(F.lit(part).alias("part"), "id") for part in ("low", "chat")]
    rows = reduce(lambda a, b: a.unionByName(b), data_rows + silo_rows)
    return rows.groupBy("part").agg(F.count("*").alias("records"), F.count_distinct("id").alias("contents"))


_DATA = (
    "d AS (SELECT doc_id, text, lang AS _lang, source AS _dataset_name, source || '/' || lang AS _subpath, "
    "sha256(text) AS _id_hash FROM documents)"
)


def _silo_sql(*names):
    """Silo CTE: one row of statistics per content hash."""
    least = ", ".join(f"min({n}) AS {n}" for n in names)
    return (
        f"{_DATA}, s0 AS ({stats_cte(*names)}), "
        f"s AS (SELECT d._id_hash AS id, {least} FROM d JOIN s0 ON d.doc_id = s0.id GROUP BY 1)"
    )


_register(
    "j01_stored_silo", _stored_rows,
    "SELECT part, CASE part WHEN 'data' THEN records ELSE contents END AS records, contents FROM "
    "(SELECT count(*) AS records, count(DISTINCT coalesce(sha256(text), '')) AS contents FROM documents), (VALUES ('data'), ('low'), ('chat')) p(part)",
)

FLAGSHIP_FILTERS = [("d._lang", "=", "en"), ("_word_count", ">=", 50), ("s._unigram_entropy", "range", (3.0, 5.5))]


def _flagship(spark, sf_dir):
    joined = join_store(spark, stored_silo(spark, sf_dir), FLAGSHIP_FILTERS)
    return joined.select("doc_id", "_id_hash", "_lang", "_dataset_name", F.length("text").alias("chars"))


_register(
    "j01_stats_join", _flagship,
    f"WITH {_silo_sql('_word_count', '_unigram_entropy')} SELECT d.doc_id, d._id_hash, d._lang, d._dataset_name, "
    "length(d.text) AS chars FROM d JOIN s ON d._id_hash = s.id "
    "WHERE d._lang = 'en' AND s._word_count >= 50 AND s._unigram_entropy BETWEEN 3.0 AND 5.5",
)


def _filtered(filters, custom=None):
    def run(spark, sf_dir):
        return join_store(spark, stored_silo(spark, sf_dir), filters, custom).select("doc_id")

    return run


def _filter_sql(where, *names):
    return f"WITH {_silo_sql(*names)} SELECT d.doc_id FROM d JOIN s ON d._id_hash = s.id WHERE {where}"


_register(
    "f01_comparisons",
    _filtered([("_word_count", ">", 20), ("_word_count", "<", 2000), ("_length", ">=", 100), ("_length", "<=", 9000),
               ("_javascript_count", "=", 0), ("_lines_count", "!=", 7)]),
    _filter_sql(
        "_word_count > 20 AND _word_count < 2000 AND _length >= 100 AND _length <= 9000 AND _javascript_count = 0 AND _lines_count <> 7",
        "_word_count", "_length", "_javascript_count", "_lines_count",
    ),
)
_register("f02_range", _filtered([("_lines_count", "range", (2, 12))]), _filter_sql("_lines_count BETWEEN 2 AND 12", "_lines_count"))
_register(
    "f03_in_list", _filtered([("_lines_count", "in", [1, 3, 5, 9]), ("_lines_short_char_20_count", "not in", [2, 3])]),
    _filter_sql("_lines_count IN (1, 3, 5, 9) AND _lines_short_char_20_count NOT IN (2, 3)", "_lines_count", "_lines_short_char_20_count"),
)
_register(
    "f04_custom_fragment", _filtered([("_word_count", ">", 100)], "s._lines_count > 3 OR d._lang = 'fr'"),
    _filter_sql("_word_count > 100 AND (s._lines_count > 3 OR d._lang = 'fr')", "_word_count", "_lines_count"),
)


def _triple(spark, sf_dir):
    wanted = [("_word_count", ">", 50), ("c._user_char_count", "<", 8000), ("c._has_context", "=", 1)]
    out = join_store(spark, stored_silo(spark, sf_dir), wanted, chat=True)
    return out.select("doc_id", "_id_hash", "_lang")


_CHAT_CTE = (
    f"c0 AS (SELECT id AS doc_id, {CHAT_SQL['_user_char_count']} AS _user_char_count, {CHAT_SQL['_has_context']} AS _has_context "
    f"FROM ({_DOC}) GROUP BY id), c AS (SELECT d._id_hash AS id, min(_user_char_count) AS _user_char_count, "
    "min(_has_context) AS _has_context FROM c0 JOIN d USING (doc_id) GROUP BY 1)"
)
_TRIPLE_WHERE = "s._word_count > 50 AND c._user_char_count < 8000 AND c._has_context = 1"
_register(
    "j02_triple_join", _triple,
    f"WITH {_silo_sql('_word_count')}, {_CHAT_CTE} SELECT d.doc_id, d._id_hash, d._lang FROM d "
    f"JOIN s ON d._id_hash = s.id JOIN c ON d._id_hash = c.id WHERE {_TRIPLE_WHERE}",
)


def _alias_default(spark, sf_dir):
    """A bare column means the low-level silo, ``c.`` the conversation silo."""
    wanted = [("_word_count", ">", 50), ("c._user_char_count", ">", 500)]
    out = join_store(spark, stored_silo(spark, sf_dir), wanted, keep=["_word_count", "c._user_char_count"], chat=True)
    return out.select("doc_id", "_word_count", "_user_char_count")


_register(
    "f05_alias_default", _alias_default,
    f"WITH {_silo_sql('_word_count')}, {_CHAT_CTE} SELECT d.doc_id, s._word_count, c._user_char_count FROM d "
    "JOIN s ON d._id_hash = s.id JOIN c ON d._id_hash = c.id WHERE s._word_count > 50 AND c._user_char_count > 500",
)


def _projected(spark, sf_dir):
    out = join_store(spark, stored_silo(spark, sf_dir), [("_token_count", ">", 1000)], keep=["_token_count"])
    return out.select("doc_id", "_lang", F.round("_token_count", 4).alias("_token_count"))


_register(
    "j03_stats_projection", _projected,
    f"WITH {_silo_sql('_token_count')} SELECT d.doc_id, d._lang, round(s._token_count, 4) AS _token_count "
    "FROM d JOIN s ON d._id_hash = s.id WHERE s._token_count > 1000",
)


def _enriched(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    return enrich(data(spark, sf_dir).select("doc_id", "_lang"), labels, "doc_id", "doc_id")


_register(
    "j04_enrichment_join", _enriched,
    "SELECT d.doc_id, d.lang AS _lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)


def _saved(spark, sf_dir):
    out = join_store(spark, stored_silo(spark, sf_dir), [("_word_count", ">", 200)], folder="long_ones")
    return out.select("doc_id", "_subpath")


_register(
    "p12_query_subpath", _saved,
    f"WITH {_silo_sql('_word_count')} SELECT d.doc_id, split_part(d._subpath, '/', 1) || '/long_ones' AS _subpath "
    "FROM d JOIN s ON d._id_hash = s.id WHERE s._word_count > 200",
)

_PROFILED = ["_length", "_word_count", "_lines_count", "_unigram_entropy", "_mean_word_length", "_punctuation_ratio"]


def document_stats(spark, sf_dir, columns):
    """A stored silo: profiles read it several times, so it is written once."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    return low_level_stats(docs, "text", "doc_id", "lang").select("id", *columns).checkpoint()


def _long_sql(columns):
    picks = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM st" for c in columns)
    return f"st AS ({stats_cte(*columns)}), lv AS ({picks})"


def _profile(spark, sf_dir):
    out = P.column_profile(document_stats(spark, sf_dir, _PROFILED), _PROFILED)
    rounded = ["min", "max", "mean", "median", "p05", "p95", "std"]
    return out.select("column", *[F.round(c, 5).alias(c) for c in rounded], "count")


_register(
    "a01_column_profile", _profile,
    f"WITH {_long_sql(_PROFILED)} SELECT \"column\", round(min(v), 5) AS min, round(max(v), 5) AS max, round(avg(v), 5) AS mean, "
    "round(median(v), 5) AS median, round(quantile_cont(v, 0.05), 5) AS p05, round(quantile_cont(v, 0.95), 5) AS p95, "
    "round(stddev_samp(v), 5) AS std, count(v) AS count FROM lv GROUP BY 1",
)


def _shape(spark, sf_dir):
    out = P.column_profile(document_stats(spark, sf_dir, _PROFILED), _PROFILED)
    return out.select("column", F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


_register(
    "a02_skewness_kurtosis", _shape,
    f"WITH {_long_sql(_PROFILED)}, m AS (SELECT \"column\", avg(v) AS mu, stddev_pop(v) AS sd FROM lv GROUP BY 1) "
    "SELECT \"column\", round(avg(pow((v - mu) / sd, 3)), 5) AS skewness, round(avg(pow((v - mu) / sd, 4)) - 3, 5) AS kurtosis "
    "FROM lv JOIN m USING (\"column\") GROUP BY 1",
)


def _histogram(spark, sf_dir):
    out = P.histogram(document_stats(spark, sf_dir, _PROFILED), _PROFILED)
    return out.select("column", "bin", F.round("bin_start", 5).alias("bin_start"), "rows")


_register(
    "a03_histogram", _histogram,
    f"WITH {_long_sql(_PROFILED)}, b AS (SELECT \"column\", min(v) AS lo, max(v) AS hi FROM lv GROUP BY 1) "
    "SELECT \"column\", bin, round(lo + (bin - 1) * (hi - lo) / 50, 5) AS bin_start, count(*) AS rows FROM "
    "(SELECT \"column\", lo, hi, CASE WHEN hi > lo THEN least(CAST(floor(50 * (v - lo) / (hi - lo)) AS BIGINT) + 1, 50) ELSE 1 END AS bin "
    "FROM lv JOIN b USING (\"column\")) GROUP BY \"column\", lo, hi, bin",
)


def _inline_totals(spark, sf_dir, by):
    """Totals without a join: group keys ride along inside the id."""
    docs = read_table(spark, sf_dir, "documents").withColumn("key", F.struct(*by))
    stats = low_level_stats(docs, "text", "key", "lang").select("id.*", "_token_count", "_word_count")
    return P.totals(stats, by)


TOTALS_SQL = (
    f"tt AS (SELECT d.source, d.lang, count(*) AS samples, "
    "CAST(trunc(sum(CAST(_token_count AS DECIMAL(20,6)))) AS BIGINT) AS tokens, CAST(sum(_word_count) AS BIGINT) AS words "
    "FROM documents d JOIN st ON d.doc_id = st.id GROUP BY 1, 2)"
)
TOTALS_WITH = f"st AS ({stats_cte('_token_count', '_word_count')}), {TOTALS_SQL}"
_register(
    "a04_distribution_totals", lambda s, d: _inline_totals(s, d, ["source", "lang"]),
    f"WITH {TOTALS_WITH} SELECT * FROM tt",
)


def _missing_totals(spark, sf_dir):
    """Distributions without statistics count as zero."""
    docs = read_table(spark, sf_dir, "documents")
    groups = docs.select("source", F.explode(F.array(F.lit("en"), F.lit("it"))).alias("lang")).distinct()
    return P.with_missing(groups, _inline_totals(spark, sf_dir, ["source", "lang"]), ["source", "lang"])


_register(
    "a04_missing_totals", _missing_totals,
    f"WITH {TOTALS_WITH}, g AS (SELECT DISTINCT source, unnest(['en', 'it']) AS lang FROM documents) "
    "SELECT g.source, g.lang, coalesce(samples, 0) AS samples, coalesce(tokens, 0) AS tokens, coalesce(words, 0) AS words "
    "FROM g LEFT JOIN tt USING (source, lang)",
)
_REPLICA = "(1 + length(source)) * 0.35"


def mix_entries(spark, sf_dir):
    """Each source and language with a fractional replica factor."""
    return _inline_totals(spark, sf_dir, ["source", "lang"]).withColumn("replica", F.expr(f"cast({_REPLICA} as decimal(6,2))"))


def _mix(by, truncate=True):
    def run(spark, sf_dir):
        out = P.scaled_totals(mix_entries(spark, sf_dir), by, truncate)
        return out if truncate else out.select(*by, *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("samples", "tokens", "words")])

    return run


def _mix_sql(by, truncate=True, where=""):
    cells = ", ".join(
        f"CAST(sum(CAST(trunc(CAST({c} AS DOUBLE) * CAST(CAST({_REPLICA} AS DECIMAL(6,2)) AS DOUBLE)) AS BIGINT)) AS BIGINT) AS {c}"
        if truncate
        else f"round(CAST(sum({c} * CAST({_REPLICA} AS DECIMAL(6,2))) AS DOUBLE), 2) AS {c}"
        for c in ("samples", "tokens", "words")
    )
    head = f"{', '.join(by)}, " if by else ""
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"WITH {TOTALS_WITH} SELECT {head}{cells} FROM tt{where}{group}"


_register("a05_mix_totals", _mix([]), _mix_sql([]))
_register("a05_mix_totals_by_language", _mix(["lang"]), _mix_sql(["lang"]))
_register("a06_dataset_totals", _mix(["source"], False), _mix_sql(["source"], False))


def _language_filtered(spark, sf_dir):
    entries = mix_entries(spark, sf_dir).filter(F.col("lang").isin("en", "fr"))
    return P.scaled_totals(entries, ["source"])


_register("a06_dataset_totals_filtered", _language_filtered, _mix_sql(["source"], True, " WHERE lang IN ('en', 'fr')"))


def _density(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), "source", "n_chars",
    )
    out = P.null_density(docs)
    return out.select("field", "nulls", "records", F.round("null_ratio", 6).alias("null_ratio"))


_register(
    "a09_null_density", _density,
    "SELECT 'text' AS field, count(*) FILTER (doc_id % 5 = 0) AS nulls, count(*) AS records, "
    "round(avg(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END), 6) AS null_ratio FROM documents UNION ALL "
    "SELECT 'lang', count(*) FILTER (lang = 'de'), count(*), round(avg(CASE WHEN lang = 'de' THEN 1 ELSE 0 END), 6) FROM documents "
    "UNION ALL SELECT 'source', 0, count(*), 0.0 FROM documents UNION ALL SELECT 'n_chars', 0, count(*), 0.0 FROM documents",
)


def _languages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("_filename", F.concat("source", F.lit("_processed")))
    return P.language_counts(docs, "_filename", "lang", F.length("text") >= 50)


_register(
    "a11_language_counts", _languages,
    "SELECT lang, count(*) FILTER (length(text) >= 50) AS written, count(DISTINCT source) FILTER (length(text) >= 50) AS files, "
    "count(*) FILTER (length(text) < 50) AS errors FROM documents GROUP BY 1",
)


def _row_count(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("text_bytes"))


_register(
    "a08_row_count", _row_count,
    "SELECT count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM documents",
)


def _preview(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.orderBy("doc_id").limit(5).select("doc_id", "lang", "source", "n_chars")


_register("a08_preview", _preview, "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")


def _column_sample(spark, sf_dir):
    """Values of one statistics column for a plot: a repeatable share of the records."""
    stats = document_stats(spark, sf_dir, ["_word_count"])
    return hash_sample(stats, "id", 0.4, 1).select("id", "_word_count")


_register(
    "w08_column_sample", _column_sample,
    f"WITH st AS ({stats_cte('_word_count')}) SELECT id, _word_count FROM st "
    "WHERE ('0x' || substr(sha256(CAST(id AS VARCHAR) || '|1'), 1, 8))::BIGINT < 0.4 * 4294967296",
)
