"""Queries: text cleaning, TF-IDF retrieval, normalisation, recall. Documents stand for libraries, benchmark texts for advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, match, phrases, relational, retrieval
from .registry import Fixture, literal, query, table

K = 10


def sql_tokens(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, text in T.CONTRACTIONS:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(text.replace('$1', chr(92) + '1'))}, 'g')"
    words = f"string_split(trim(lower(regexp_replace(translate({out}, '''', ' '), '[^a-zA-Z]+', ' ', 'g'))), ' ')"
    return f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({literal(list(T.STOP_WORDS))}, w))"


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lib_idx"), F.concat(F.lit("maven:"), "source", F.lit(":"), "lang", F.lit("-"), "doc_id").alias("name"), F.col("text").alias("summary"))
    return retrieval.corpus(named)


def _advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_LIBRARIES_SQL = f"""
lib0 AS (SELECT doc_id AS lib_idx, 'maven:' || source || ':' || lang || '-' || doc_id AS name, text AS summary FROM documents),
lib AS (SELECT lib_idx, lower(name) AS object, {sql_tokens("repeat(lower(name), 4) || ' ' || coalesce(summary, ' ')")} AS tokens
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lib_idx) AS r FROM lib0 WHERE name IS NOT NULL) WHERE r = 1),
words AS (SELECT lib_idx, len(tokens) + 1 AS n, unnest(tokens) AS term FROM lib),
postings AS (SELECT lib_idx, term, count(*) / any_value(n) AS tf FROM words GROUP BY lib_idx, term),
idf AS (SELECT term, ln((SELECT count(*) FROM lib)::DOUBLE / (count(*) + 1)) AS idf FROM postings GROUP BY term)
"""

_SEARCH_SQL = f"""
WITH {_LIBRARIES_SQL},
asked AS (SELECT item_id AS query_id, {sql_tokens("text")} AS tokens FROM benchmark),
terms AS (SELECT query_id, term, count(*) / any_value(n) AS weight FROM (SELECT query_id, len(tokens) AS n, unnest(tokens) AS term FROM asked) GROUP BY query_id, term),
scored AS (SELECT query_id, lib_idx, round(sum(tf * weight * idf), 9) AS score FROM terms JOIN postings USING (term) JOIN idf USING (term) GROUP BY query_id, lib_idx),
every AS (SELECT query_id, lib_idx, object, coalesce(score, 0.0) AS score FROM (SELECT query_id FROM asked WHERE len(tokens) > 0) CROSS JOIN lib LEFT JOIN scored USING (query_id, lib_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lib_idx) AS rank FROM every)
"""


@query(f"{_SEARCH_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, lib_idx, object, score FROM ranked WHERE rank <= {K}")
def tfidf_topk(spark, sf_dir):
    """The flagship: the best libraries of each advisory text."""
    return retrieval.search(_libraries(spark, sf_dir), _advisories(spark, sf_dir), K)


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def clean_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("""
SELECT event_id, user_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) END, 9) AS normal
FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)
""")
def minmax_normalise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(relational.min_max(F.col("value"), ["user_id"]), 9).alias("normal"))


@query(f"""{_SEARCH_SQL},
top AS (SELECT query_id AS id, rank AS place, object AS name, score FROM ranked WHERE rank <= {K}),
bounds AS (SELECT *, min(score) OVER (PARTITION BY id) AS lo, max(score) OVER (PARTITION BY id) AS hi FROM top),
kept AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS r FROM bounds WHERE round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 9) >= 0.5)
SELECT id, coalesce(max(CASE WHEN r = 1 THEN name END), '') || ';' || coalesce(max(CASE WHEN r = 2 THEN name END), '') || ';' || coalesce(max(CASE WHEN r = 3 THEN name END), '') AS triple
FROM (SELECT DISTINCT id FROM top) LEFT JOIN kept USING (id) GROUP BY id
""")
def rerank_top3_triple(spark, sf_dir):
    found = tfidf_topk(spark, sf_dir)
    return match.rerank(found.select(F.col("query_id").alias("id"), F.col("rank").alias("place"), F.col("object").alias("name"), "score"), 0.5)


_ENTITIES = Fixture("query_id long, pos int, entity string", [(0, 0, "src0:en-3"), (0, 1, "the"), (1, 0, "SRC1 : en-1"), (2, 0, "no such library"), (3, 0, "src2:en-2"), (3, 1, "src1:en-1")])


def sql_name_key(c: str) -> str:
    out = f"trim({c}, '/')"
    for prefix in T.NAME_PREFIXES:
        out = f"replace({out}, {literal(prefix)}, '')"
    return f"lower(regexp_replace({out}, '[:|/ ]', '', 'g'))"


@query(f"""
WITH lib AS (SELECT doc_id AS lib_idx, lower('maven:' || source || ':' || lang || '-' || doc_id) AS object FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
keys AS (SELECT {sql_name_key("object")} AS key, arg_max(object, lib_idx) AS object, max(lib_idx) AS lib_idx FROM lib GROUP BY 1)
SELECT query_id, pos, lib_idx, object FROM (SELECT *, replace(replace(lower(entity), ' ', ''), ':', '') AS key FROM {_ENTITIES.sql}) JOIN keys USING (key)
""")
def name_index_probe(spark, sf_dir):
    entities = _ENTITIES.df(spark).withColumn("entity", F.replace("entity", F.lit(":"), F.lit("")))
    return retrieval.name_hits(_libraries(spark, sf_dir), entities)


@query(f"""
WITH {_LIBRARIES_SQL},
named AS (SELECT query_id, list_distinct(list_concat(list(entity), flatten(list({sql_tokens("entity")})))) AS names FROM (SELECT query_id, pos, replace(entity, ':', '') AS entity FROM {_ENTITIES.sql}) GROUP BY query_id),
asked AS (SELECT item_id AS query_id, {sql_tokens("text")} AS tokens, coalesce(names, []) AS names FROM benchmark LEFT JOIN named ON item_id = query_id),
sized AS (SELECT query_id, tokens, names, len(tokens) + 3 * len(list_filter(tokens, lambda w: list_contains(names, w))) AS n FROM asked),
terms AS (SELECT query_id, term, sum(CASE WHEN list_contains(names, term) THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) / any_value(n) AS weight FROM (SELECT query_id, names, n, unnest(tokens) AS term FROM sized) GROUP BY query_id, term),
scored AS (SELECT query_id, lib_idx, round(sum(tf * weight * idf), 9) AS score FROM terms JOIN postings USING (term) JOIN idf USING (term) GROUP BY query_id, lib_idx),
every AS (SELECT query_id, lib_idx, object, coalesce(score, 0.0) AS score FROM (SELECT query_id FROM asked WHERE len(tokens) > 0) CROSS JOIN lib LEFT JOIN scored USING (query_id, lib_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lib_idx) AS place FROM every),
keys AS (SELECT {sql_name_key("object")} AS key, arg_max(object, lib_idx) AS object FROM lib GROUP BY 1),
hits AS (SELECT query_id, object, min(pos) AS place FROM (SELECT *, replace(replace(lower(entity), ' ', ''), ':', '') AS key FROM {_ENTITIES.sql}) JOIN keys USING (key) GROUP BY query_id, object),
both_ AS (SELECT query_id, object, place, 0 AS step FROM hits WHERE query_id IN (SELECT query_id FROM asked WHERE len(tokens) > 0) UNION ALL
          SELECT query_id, object, place, 1 FROM ranked r WHERE place <= {K} AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = r.query_id AND h.object = r.object))
SELECT query_id, CAST(rank AS INTEGER) AS rank, object FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step, place, object) AS rank FROM both_) WHERE rank <= {K}
""")
def tfidf_topk_named_boost(spark, sf_dir):
    entities = _ENTITIES.df(spark).withColumn("entity", F.replace("entity", F.lit(":"), F.lit("")))
    return retrieval.search_with_names(_libraries(spark, sf_dir), _advisories(spark, sf_dir), entities, K)


@query(f"""{_SEARCH_SQL},
truth AS (SELECT item_id AS query_id, 'maven:' || source || ':' || lang || '-' || doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
hits AS (SELECT truth.query_id, rank FROM truth LEFT JOIN ranked ON ranked.query_id = truth.query_id AND object = lower(item) AND rank <= {K})
SELECT k, count(*) AS n_queries, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS recall FROM hits CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k
""")
def recall_at_k(spark, sf_dir):
    """Documents that hold a whole benchmark passage are what the search should find."""
    found = tfidf_topk(spark, sf_dir).select("query_id", "rank", F.col("object").alias("item"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.lower(F.concat(F.lit("maven:"), "source", F.lit(":"), "lang", F.lit("-"), "doc_id")).alias("item"), "text")
    truth = phrases.passages_held(docs, items)
    return evaluate.recall_at(found, truth, [1, 3, 5, 10])
