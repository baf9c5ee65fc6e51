"""Queries on the graph, enrichment, retrieval and sinks, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark import sinks, workspace
from vellumspark.config import RetrievalConfig
from vellumspark.operators import enrich, graph, rows, search
from vellumspark.plans import pipeline
from vellumspark.plans.base import oracle, query, table
from vellumspark.plans.text_queries import DIALOGUE, SUMMARY, dialogue_chunks, summarised

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


# --- graph ----------------------------------------------------------------------------------------------------


@query
def graph_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sequence_edges(dialogue_chunks(spark, sf_dir)).drop("ord")


oracle(
    "graph_sequential",
    f"""WITH {DIALOGUE}, l AS (SELECT chunk_id, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
    SELECT chunk_id AS src_id, p AS dst_id, 'follows' AS relation, 1.0::DOUBLE AS weight FROM l WHERE p IS NOT NULL UNION ALL SELECT chunk_id, n, 'precedes', 1.0::DOUBLE FROM l WHERE n IS NOT NULL""",
)


@query
def graph_same_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.section_edges(dialogue_chunks(spark, sf_dir)).drop("ord")


oracle("graph_same_section", f"WITH {DIALOGUE} SELECT a.chunk_id AS src_id, b.chunk_id AS dst_id, 'same_section' AS relation, 1.0::DOUBLE AS weight FROM c a JOIN c b USING (doc_id, section_id) WHERE a.chunk_id <> b.chunk_id")


def _with_entities(chunks: DataFrame) -> DataFrame:
    """Capitalised words of three letters or more as entities."""
    return chunks.withColumn("entities", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))))


@query
def graph_shared_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_edges(_with_entities(dialogue_chunks(spark, sf_dir))).drop("ord")


_ENTITIES = "e AS (SELECT DISTINCT doc_id, chunk_id, chunk_index, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS entity FROM c)"
oracle("graph_shared_entity", f"WITH {DIALOGUE}, {_ENTITIES} SELECT DISTINCT a.chunk_id AS src_id, b.chunk_id AS dst_id, 'shared_entity' AS relation, 0.8::DOUBLE AS weight FROM e a JOIN e b USING (doc_id, entity) WHERE a.chunk_id <> b.chunk_id")


@query
def graph_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.nested(graph.edges(_with_entities(dialogue_chunks(spark, sf_dir))))
    return found.select("src_id", F.size("relationships").alias("degree"), F.array_join(F.transform("relationships", lambda r: F.concat(r["relation"], F.lit(":"), r["target_id"])), " ").alias("shown"))


oracle(
    "graph_nested",
    f"""WITH {DIALOGUE}, {_ENTITIES}, l AS (SELECT chunk_id, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
    x AS (SELECT chunk_id AS src_id, p AS dst, 'follows' AS relation, 1 AS kind, 0 AS ord FROM l WHERE p IS NOT NULL UNION ALL SELECT chunk_id, n, 'precedes', 2, 1 FROM l WHERE n IS NOT NULL
        UNION ALL SELECT a.chunk_id, b.chunk_id, 'same_section', 3, b.chunk_index FROM c a JOIN c b USING (doc_id, section_id) WHERE a.chunk_id <> b.chunk_id
        UNION ALL SELECT DISTINCT a.chunk_id, b.chunk_id, 'shared_entity', 4, b.chunk_index FROM e a JOIN e b USING (doc_id, entity) WHERE a.chunk_id <> b.chunk_id)
    SELECT src_id, count(*)::INTEGER AS degree, string_agg(concat(relation, ':', dst), ' ' ORDER BY kind, ord, dst) AS shown FROM x GROUP BY src_id""",
)


@query
def neighbor_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbor_summaries(summarised(dialogue_chunks(spark, sf_dir))).select("chunk_id", "summary", "prev_summary", "next_summary")


oracle("neighbor_summaries", f"WITH {DIALOGUE}, s AS (SELECT *, {SUMMARY} AS summary FROM c) SELECT chunk_id, summary, coalesce(lag(summary) OVER w, '') AS prev_summary, coalesce(lead(summary) OVER w, '') AS next_summary FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")


# --- retrieval ------------------------------------------------------------------------------------------------


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_KEPT: dict[tuple, object] = {}
_T = TypeVar("_T")


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], _T]) -> _T:
    """What is written by the first query that asks for it in a session, and only read by the others."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _KEPT:
        _KEPT[place] = build()
    return _KEPT[place]


def _document_index(spark: SparkSession, sf_dir: str) -> search.Index:
    """An index of all words of all documents."""
    return _once(spark, sf_dir, "documents", lambda: search.build_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text")))


def _bm25_sql(source: str, key: str, k: int, name: str = "lex", okapi: bool = False) -> str:
    """CTEs that end in name(query_id, chunk_key, rank, bm25_score)."""
    idf = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
    if okapi:
        idf = "ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)"
    floored = "CASE WHEN idf < 0 THEN 0.25::DOUBLE * (avg(idf) OVER ()) ELSE idf END" if okapi else "idf"
    return f"""{name}_p AS (SELECT {key} AS chunk_key, {_WORDS.format("text")} AS ws FROM {source}),
    {name}_tf AS (SELECT chunk_key, len(ws) AS dl, term, count(*) AS tf FROM (SELECT chunk_key, ws, unnest(ws) AS term FROM {name}_p) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
    {name}_n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_p),
    {name}_i AS (SELECT term, {floored} AS idf FROM (SELECT term, {idf} AS idf FROM {name}_df CROSS JOIN {name}_n)),
    {name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
    {name}_s AS (SELECT query_id, chunk_key, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw FROM {name}_q JOIN {name}_i USING (term) JOIN {name}_tf USING (term) CROSS JOIN {name}_n GROUP BY ALL),
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, chunk_key) - 1 AS rank FROM {name}_s WHERE raw > 0),
    {name} AS (SELECT query_id, chunk_key, rank::INTEGER AS rank, raw / max(raw) OVER (PARTITION BY query_id) AS bm25_score FROM {name}_r WHERE rank < {k})"""


@query
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built anew: words of all documents and in how many of them each is."""
    index = search.build_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return index.terms.crossJoin(F.broadcast(index.totals)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


oracle("bm25_term_stats", f"WITH {_bm25_sql('documents', 'doc_id', 10)} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM lex_df CROSS JOIN lex_n")


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25_search(_document_index(spark, sf_dir), _queries(spark, sf_dir), 10)
    return hits.select("query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("bm25_score", 6).alias("bm25_score"))


oracle("bm25_topk", f"WITH {_bm25_sql('documents', 'doc_id', 10)} SELECT query_id, chunk_key AS doc_id, rank, round(bm25_score, 6) AS bm25_score FROM lex")


@query
def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25_search(_document_index(spark, sf_dir), _queries(spark, sf_dir), 10, okapi=True)
    return hits.select("query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("bm25_score", 6).alias("bm25_score"))


oracle("bm25_okapi_topk", f"WITH {_bm25_sql('documents', 'doc_id', 10, okapi=True)} SELECT query_id, chunk_key AS doc_id, rank, round(bm25_score, 6) AS bm25_score FROM lex")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries with a vector of their number."""
    return _queries(spark, sf_dir).join(_vectors(spark, sf_dir), F.col("query_id") == F.col("chunk_key")).drop("chunk_key")


def _dense_sql(k: int, asked: str = "benchmark JOIN embeddings a ON item_id = a.vec_id", qid: str = "item_id") -> str:
    dot = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
    cos = f"{dot.format('a.embedding', 'b.embedding')} / (sqrt({dot.format('a.embedding', 'a.embedding')}) * sqrt({dot.format('b.embedding', 'b.embedding')}) + 1e-10)"
    return f"""den_s AS (SELECT {qid} AS query_id, b.vec_id AS chunk_key, greatest(0.0::DOUBLE, {cos}) AS dense_score FROM {asked} CROSS JOIN embeddings b),
    den_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense_score, 10) DESC, chunk_key) - 1 AS rank FROM den_s WHERE dense_score > 0),
    den AS (SELECT query_id, chunk_key, rank::INTEGER AS rank, dense_score FROM den_r WHERE rank < {k})"""


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against all of them."""
    asked = _vectors(spark, sf_dir).withColumnRenamed("chunk_key", "query_id")
    hits = search.dense_search(_vectors(spark, sf_dir), asked, 10, dims=64)
    return hits.select("query_id", F.col("chunk_key").alias("vec_id"), "rank", F.round("dense_score", 6).alias("dense_score"))


oracle("dense_topk", f"WITH {_dense_sql(10, 'embeddings a', 'a.vec_id')} SELECT query_id, chunk_key AS vec_id, rank, round(dense_score, 6) AS dense_score FROM den")


def _fused(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    dense = search.dense_search(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), depth, dims=64)
    lexical = search.bm25_search(_document_index(spark, sf_dir), _queries(spark, sf_dir), depth)
    return search.fuse(dense, lexical)


_FUSED = f"""{_bm25_sql('documents', 'doc_id', 30)}, {_dense_sql(30)},
    rrf_u AS (SELECT query_id, chunk_key, 0.7::DOUBLE / (61 + rank) AS part, dense_score, NULL AS bm25_score, rank AS dr, NULL AS br FROM den UNION ALL SELECT query_id, chunk_key, 0.3::DOUBLE / (61 + rank), NULL, bm25_score, NULL, rank FROM lex),
    rrf_s AS (SELECT query_id, chunk_key, sum(part) AS score, coalesce(max(dense_score), 0) AS dense_score, coalesce(max(bm25_score), 0) AS bm25_score, max(dr) AS dr, max(br) AS br FROM rrf_u GROUP BY ALL),
    rrf AS (SELECT query_id, chunk_key, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, dr NULLS LAST, br NULLS LAST) - 1)::INTEGER AS rank, score, dense_score, bm25_score FROM rrf_s)"""
_ROUNDED = "round(score, 8) AS score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score"


def _rounded(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("score", 8).alias("score"), F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score"), *more)


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fused(spark, sf_dir, 30).where("rank < 10"))


oracle("rrf_fusion", f"WITH {_FUSED} SELECT query_id, chunk_key AS doc_id, rank, {_ROUNDED} FROM rrf WHERE rank < 10")


@query
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused lists cut by language, whatever its case, before the cut to ten."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_key")
    return _rounded(search.filtered(_fused(spark, sf_dir, 30), docs, {"lang": "EN"}).where("rank < 10"))


oracle("filtered_search", f"WITH {_FUSED}, f AS (SELECT query_id, chunk_key, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INTEGER AS rank, score, dense_score, bm25_score FROM rrf JOIN documents ON doc_id = chunk_key WHERE lower(lang) = 'en') SELECT query_id, chunk_key AS doc_id, rank, {_ROUNDED} FROM f WHERE rank < 10")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks table of conversations, written once: searches read it several times, mostly a few columns."""
    return _once(spark, sf_dir, "chunks", lambda: workspace.kept(dialogue_chunks(spark, sf_dir)))


def _dialogue_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = _turns(spark, sf_dir).withColumn("chunk_key", F.col("chunk_id"))
    index = _once(spark, sf_dir, "dialogue", lambda: search.build_index(chunks, "chunk_key", F.col("text")))
    hits = search.bm25_search(index, _queries(spark, sf_dir), 3)
    return chunks, hits.select("query_id", "chunk_key", "rank", F.col("bm25_score").alias("score"), F.lit(0.0).alias("dense_score"), "bm25_score")


def _expanded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("chunk_key").alias("chunk_id"), "rank", F.round("score", 6).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), "via")


_HITS = f"{DIALOGUE}, {_bm25_sql('c', 'chunk_id', 3)}"


def _expand_sql(more: str) -> str:
    return f"""WITH {_HITS}, m AS ({more}),
    a AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM lex h WHERE h.query_id = m.query_id AND h.chunk_key = m.chunk_key)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_key ORDER BY by_rank, kind, s1, s2) AS first FROM a) WHERE first = 1),
    e AS (SELECT query_id, chunk_key, rank AS by_rank, -1 AS kind, 0 AS s1, 0 AS s2, bm25_score AS score, bm25_score FROM lex UNION ALL SELECT query_id, chunk_key, by_rank, kind, s1, s2, score, bm25_score FROM f)
    SELECT query_id, chunk_key AS chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind < 0 THEN 0 ELSE 1 END, by_rank, kind, s1, s2) - 1)::INTEGER AS rank, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score,
        CASE WHEN kind < 0 THEN 'hit' WHEN kind = 0 THEN 'section' ELSE 'neighbor' END AS via FROM e"""


_SIBLINGS = "SELECT query_id, o.chunk_id AS chunk_key, rank AS by_rank, 0 AS kind, o.doc_id AS s1, o.chunk_index AS s2, bm25_score * 0.9::DOUBLE AS score, bm25_score FROM lex JOIN c i ON i.chunk_id = lex.chunk_key JOIN c o ON o.doc_id = i.doc_id AND o.section_id = i.section_id"
_NEIGHBORS = "SELECT query_id, o.chunk_id AS chunk_key, rank AS by_rank, CASE WHEN o.chunk_index < i.chunk_index THEN 1 ELSE 2 END AS kind, 0 AS s1, abs(o.chunk_index - i.chunk_index) AS s2, bm25_score * 0.85::DOUBLE AS score, 0.0::DOUBLE AS bm25_score FROM lex JOIN c i ON i.chunk_id = lex.chunk_key JOIN c o ON o.doc_id = i.doc_id AND abs(o.chunk_index - i.chunk_index) BETWEEN 1 AND 2"


@query
def expand_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = _dialogue_hits(spark, sf_dir)
    return _expanded(search.expand(hits, chunks, parents=True))


oracle("expand_siblings", _expand_sql(_SIBLINGS))


@query
def expand_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = _dialogue_hits(spark, sf_dir)
    return _expanded(search.expand(hits, chunks, neighbors=2))


oracle("expand_neighbors", _expand_sql(_NEIGHBORS))


@query
def expand_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = _dialogue_hits(spark, sf_dir)
    return _expanded(search.expand(hits, chunks, parents=True, neighbors=2))


oracle("expand_both", _expand_sql(f"{_SIBLINGS} UNION ALL {_NEIGHBORS}"))


@query
def rerank_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lexical hits, the five shortest first."""
    hits = search.bm25_search(_document_index(spark, sf_dir), _queries(spark, sf_dir), 10)
    sized = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_key"), F.length("text").alias("size")), "chunk_key")
    found = search.rerank_by(sized, -F.col("size"))
    return found.select("query_id", F.col("chunk_key").alias("doc_id"), "rank", "rerank_score")


oracle("rerank_custom", f"WITH {_bm25_sql('documents', 'doc_id', 10)}, r AS (SELECT query_id, chunk_key AS doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY length(text), rank) - 1)::INTEGER AS rank, (-length(text))::DOUBLE AS rerank_score FROM lex JOIN documents ON doc_id = chunk_key) SELECT * FROM r WHERE rank < 5")


@query
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = _dialogue_hits(spark, sf_dir)
    texts = hits.join(chunks.select("chunk_key", "text"), "chunk_key")
    return pipeline.context_blocks(texts)


oracle("rag_prompt", f"WITH {_HITS} SELECT query_id, string_agg(concat('[', rank + 1, '] ', text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM lex JOIN c ON chunk_id = chunk_key GROUP BY query_id")


@query
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the passages that occur in documents: is one of these documents among the first k, and how high."""
    docs, asked = table(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    index = _document_index(spark, sf_dir)
    relevant = search.containing(docs.select(F.col("doc_id").alias("chunk_key"), "text"), asked, index)
    hits = search.bm25_search(index, asked, 10)
    return pipeline.retrieval_metrics(hits, relevant)


oracle(
    "hit_at_k",
    f"""WITH {_bm25_sql('documents', 'doc_id', 10)}, rel AS (SELECT item_id AS query_id, doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)),
    best AS (SELECT r.query_id, min(rank) AS best FROM rel r LEFT JOIN lex ON lex.query_id = r.query_id AND chunk_key = doc_id GROUP BY r.query_id)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN best < 3 THEN 1.0 ELSE 0 END::DOUBLE), 6) AS hit_at_3, round(avg(CASE WHEN best < 5 THEN 1.0 ELSE 0 END::DOUBLE), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / (best + 1), 0)), 6) AS mrr FROM best""",
)


# --- enrichment -----------------------------------------------------------------------------------------------


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies of five shapes: bare, fenced, amid prose, not JSON, and with other names and a score."""
    value = F.round("value", 2).cast("string")
    good = F.concat(F.lit('{"Summary": "Event '), F.col("event_type"), F.lit('", "keywords": ["'), F.col("event_type"), F.lit('", "k'), F.pmod("user_id", F.lit(7)).cast("string"), F.lit('"], "confidence": '), value, F.lit("}"))
    other = F.concat(F.lit('{"summary": "", "description": "Other '), F.col("event_type"), F.lit('", "tags": "solo", "confidence": 0, "score": 0.25}'))
    kind = F.pmod("event_id", F.lit(5))
    shaped = F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), good, F.lit("\n```\nBye."))).when(kind == 2, F.concat(F.lit("Sure: "), good, F.lit(" - done"))).when(kind == 3, F.lit("no object here")).otherwise(other)
    return table(spark, sf_dir, "events").select("event_id", shaped.alias("reply"))


_CONFIDENCE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(value, 2)))"


@query
def llm_json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replies(spark, sf_dir).withColumn("v", enrich.parsed(F.col("reply")))
    return found.select("event_id", F.col("v").isNotNull().alias("is_json"), F.variant_get("v", "$.Summary", "string").alias("summary"))


oracle("llm_json_ladder", "SELECT event_id, event_id % 5 <> 3 AS is_json, CASE WHEN event_id % 5 < 3 THEN concat('Event ', event_type) END AS summary FROM events")


@query
def enrichment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replies(spark, sf_dir).withColumn("v", enrich.parsed(F.col("reply")))
    found = found.withColumn("f", enrich.fields(F.col("v")))
    fields = F.col("f")
    return found.select("event_id", fields["summary"].alias("summary"), F.array_join(fields["keywords"], "|").alias("keywords"), F.array_join(fields["entities"], "|").alias("entities"), F.round(fields["confidence"], 4).alias("confidence"))


oracle(
    "enrichment_fields",
    f"""SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN concat('Other ', event_type) ELSE concat('Event ', event_type) END AS summary,
    CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN 'solo' ELSE concat(event_type, '|k', user_id % 7) END AS keywords, NULL::VARCHAR AS entities,
    CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN 0.25::DOUBLE ELSE round(CASE WHEN round(value, 2) = 0 THEN NULL ELSE {_CONFIDENCE} END, 4) END AS confidence FROM events""",
)


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as chunks, and a cache of those in two languages."""
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang in ('en', 'de')").select(enrich.text_hash(F.col("text")).alias("text_hash"), F.concat(F.lit("en-"), F.length("text").cast("string")).alias("payload")).distinct()
    return docs.select("doc_id", F.lit(0).alias("chunk_index"), "text"), cache


_LOOKED = """k AS (SELECT DISTINCT sha256(text) AS text_hash, concat('en-', length(text)) AS payload FROM documents WHERE lang IN ('en', 'de')),
    l AS (SELECT doc_id, sha256(text) AS text_hash, payload, CASE WHEN payload IS NOT NULL OR row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'HIT' ELSE 'MISS' END AS cache_status FROM documents LEFT JOIN k ON k.text_hash = sha256(text))"""


@query
def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_cache(*_cached(spark, sf_dir)).select("doc_id", "text_hash", "payload", "cache_status")


oracle("cache_join", f"WITH {_LOOKED} SELECT * FROM l")


@query
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.cache_stats(enrich.with_cache(*_cached(spark, sf_dir)))


oracle("cache_stats", f"WITH {_LOOKED}, s AS (SELECT count(*) FILTER (cache_status = 'HIT') AS hits, count(*) FILTER (cache_status = 'MISS') AS misses, count(DISTINCT text_hash) AS entries FROM l) SELECT hits, misses, entries, round(hits * 100.0::DOUBLE / (hits + misses), 1) AS hit_rate_percent, hits AS calls_saved, round(hits * 1.5::DOUBLE, 2) AS time_saved_seconds FROM s")


@query
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = _cached(spark, sf_dir)
    new = table(spark, sf_dir, "documents").where("lang in ('en', 'fr')").select(enrich.text_hash(F.col("text")).alias("text_hash"), F.lit("new").alias("payload")).distinct()
    return enrich.cache_upsert(cache, new)


oracle("cache_upsert", f"WITH {_LOOKED}, n AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE lang IN ('en', 'fr')) SELECT text_hash, 'new' AS payload FROM n UNION ALL SELECT text_hash, payload FROM k WHERE text_hash NOT IN (SELECT text_hash FROM n)")


@query
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.col("quality") * 0.5 + (1 - F.col("toxic")) * 0.3
    return table(spark, sf_dir, "labels").groupBy(pipeline.confidence_tier(confidence).alias("tier")).agg(F.count("*").alias("n"))


oracle("confidence_tiers", "SELECT CASE WHEN quality * 0.5::DOUBLE + (1 - toxic) * 0.3::DOUBLE >= 0.8 THEN 'high' WHEN quality * 0.5::DOUBLE + (1 - toxic) * 0.3::DOUBLE >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM labels GROUP BY 1")


@query
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns enriched by the offline stand-in, each distinct text once."""
    empty = spark.createDataFrame([], "text_hash string, payload string")
    found, _ = enrich.enrich(dialogue_chunks(spark, sf_dir), empty)
    return found.select("doc_id", "chunk_index", "cache_status", "summary", "prev_summary", "next_summary", F.array_join("keywords", "|").alias("keywords"), F.round("confidence", 6).alias("confidence"))


oracle(
    "enriched_chunks",
    rf"""WITH {DIALOGUE}, b AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM c),
    s AS (SELECT doc_id, chunk_index, text, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk_index) > 1 THEN 'HIT' ELSE 'MISS' END AS cache_status,
        substr(regexp_extract(concat(body, ' '), '^(.*?[.!?])\s', 1), 1, 200) AS lead, substr(body, 1, 200) AS whole, least(1.0::DOUBLE, length(text) / 400::DOUBLE) AS confidence FROM b),
    w AS (SELECT doc_id, chunk_index, word, count(*) AS n FROM (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM c) WHERE length(word) > 4 GROUP BY ALL),
    k AS (SELECT doc_id, chunk_index, string_agg(word, '|' ORDER BY n DESC, word) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY n DESC, word) AS r FROM w) WHERE r <= 5 GROUP BY ALL),
    t AS (SELECT s.doc_id, s.chunk_index, cache_status, CASE WHEN lead <> '' THEN lead ELSE whole END AS summary, coalesce(keywords, '') AS keywords, round(confidence, 6) AS confidence FROM s LEFT JOIN k USING (doc_id, chunk_index))
    SELECT doc_id, chunk_index, cache_status, summary, coalesce(lag(summary) OVER o, '') AS prev_summary, coalesce(lead(summary) OVER o, '') AS next_summary, keywords, confidence FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)""",
)


# --- sinks ----------------------------------------------------------------------------------------------------


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_sequence(rows.with_context(_with_entities(summarised(dialogue_chunks(spark, sf_dir)))))


_RECORD = f"""WITH {DIALOGUE}, s AS (SELECT *, {SUMMARY} AS summary, list_distinct_ordered FROM (SELECT *, list_filter(es, lambda x, i: list_position(es, x) = i) AS list_distinct_ordered FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS es FROM c))),
    r AS (SELECT chunk_id AS id, text, concat_ws(chr(10), concat('Document: ', source), concat('Section: ', parent_context), CASE WHEN summary <> '' THEN concat('Summary: ', summary) END, text) AS shown, summary, list_distinct_ordered AS entities,
        parent_context, coalesce(lag(chunk_id) OVER w, '') AS prev_id, coalesce(lead(chunk_id) OVER w, '') AS next_id, '' AS parent_id, section_id, 2::INTEGER AS depth, 0.0::DOUBLE AS confidence, source, chunk_index, total_chunks, 0::INTEGER AS page FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"""
_FLAT = ("summary", "parent_context", "prev_id", "next_id", "parent_id", "section_id", "depth", "confidence", "source", "chunk_index", "total_chunks", "page")


@query
def vector_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sinks.vector_records(_ready(spark, sf_dir))
    return found.select("id", "embed_text", F.array_join("metadata.entities", "|").alias("entities"), *[F.col(f"metadata.{c}").alias(c) for c in _FLAT])


oracle("vector_record", f"{_RECORD} SELECT id, shown AS embed_text, array_to_string(entities, '|') AS entities, {', '.join(_FLAT)} FROM r")


@query
def collection_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sinks.collection_records(_ready(spark, sf_dir))
    return found.select("id", "document", F.col("metadata.raw_text").alias("raw_text"), F.col("metadata.entities").alias("entities"), *[F.col(f"metadata.{c}").alias(c) for c in _FLAT])


oracle("collection_record", f"{_RECORD} SELECT id, shown AS document, text AS raw_text, array_to_string(entities, ', ') AS entities, {', '.join(_FLAT)} FROM r")


@query
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _ready(spark, sf_dir).select("doc_id", "source", "chunk_index", "chunk_id", "text", "section_id", "page", "total_chunks")
    return sinks.json_lines(chunks).select("doc_id", "chunk_index", "value")


oracle(
    "jsonl_records",
    f"""WITH {DIALOGUE} SELECT doc_id, chunk_index, concat('{{"id":', to_json(chunk_id), ',"text":', to_json(text), ',"section_id":', to_json(section_id), ',"metadata":{{"source":', to_json(source), ',"page":null,"chunk_index":', chunk_index, ',"total_chunks":', total_chunks, '}}}}') AS value FROM c""",
)


# --- all of it ------------------------------------------------------------------------------------------------


@query
def process_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through sections, chunks, graph and contextual text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = pipeline.process_text(docs)
    return found.chunks.select("doc_id", "chunk_index", "total_chunks", "chunk_id", "prev_id", "next_id", "token_count", "contextual_text")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts over all turns, with both legs and expansion."""
    chunks = rows.with_context(_turns(spark, sf_dir))
    # a turn's vector is that of its conversation's number, counted round
    vectors = _vectors(spark, sf_dir)
    count = vectors.agg(F.count("*").alias("n_vectors"))
    placed = chunks.crossJoin(F.broadcast(count)).select(F.col("chunk_id"), F.pmod("doc_id", "n_vectors").alias("v"))
    vectors = placed.join(vectors, F.col("v") == F.col("chunk_key")).select(F.col("chunk_id").alias("chunk_key"), "embedding")
    config = RetrievalConfig(0.5, 0.5, expand_parents=True, expand_neighbors=1)
    text = search.search_text(F.col("text"), F.col("keywords"), F.col("entities"), F.col("summary"), F.col("parent_context"))
    index = _once(spark, sf_dir, "turns", lambda: search.build_index(chunks, "chunk_id", text))
    found = search.hybrid_search(chunks, _asked_vectors(spark, sf_dir), vectors, config, top_k=3, index=index)
    return found.select("query_id", F.col("chunk_key").alias("chunk_id"), "rank", F.round("score", 8).alias("score"), F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score"), "via")


_COSINE = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10)"
oracle(
    "hybrid_search",
    f"""WITH {DIALOGUE}, sc AS (SELECT chunk_id, concat_ws(' ', text, '', '', '', parent_context) AS text FROM c), {_bm25_sql('sc', 'chunk_id', 9)},
    cv AS (SELECT chunk_id, embedding FROM c JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
    den_s AS (SELECT item_id AS query_id, b.chunk_id AS chunk_key, greatest(0.0::DOUBLE, {_COSINE}) AS dense_score FROM benchmark JOIN embeddings a ON item_id = a.vec_id CROSS JOIN cv b),
    den AS (SELECT * FROM (SELECT query_id, chunk_key, (row_number() OVER (PARTITION BY query_id ORDER BY round(dense_score, 10) DESC, chunk_key) - 1)::INTEGER AS rank, dense_score FROM den_s WHERE dense_score > 0) WHERE rank < 9),
    lx AS (SELECT * FROM lex WHERE query_id IN (SELECT vec_id FROM embeddings)),
    u AS (SELECT query_id, chunk_key, 0.5::DOUBLE / (61 + rank) AS part, dense_score, NULL AS bm25_score, rank AS dr, NULL AS br FROM den UNION ALL SELECT query_id, chunk_key, 0.5::DOUBLE / (61 + rank), NULL, bm25_score, NULL, rank FROM lx),
    fs AS (SELECT query_id, chunk_key, sum(part) AS score, coalesce(max(dense_score), 0) AS dense_score, coalesce(max(bm25_score), 0) AS bm25_score, max(dr) AS dr, max(br) AS br FROM u GROUP BY ALL),
    h AS (SELECT * FROM (SELECT query_id, chunk_key, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, dr NULLS LAST, br NULLS LAST) - 1)::INTEGER AS rank, score, dense_score, bm25_score FROM fs) WHERE rank < 3),
    m AS (SELECT query_id, o.chunk_id AS chunk_key, rank AS by_rank, 0 AS kind, o.doc_id AS s1, o.chunk_index AS s2, score * 0.9::DOUBLE AS score, dense_score, bm25_score FROM h JOIN c i ON i.chunk_id = h.chunk_key JOIN c o ON o.doc_id = i.doc_id AND o.section_id = i.section_id
        UNION ALL SELECT query_id, o.chunk_id, rank, CASE WHEN o.chunk_index < i.chunk_index THEN 1 ELSE 2 END, 0, 1, score * 0.85::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM h JOIN c i ON i.chunk_id = h.chunk_key JOIN c o ON o.doc_id = i.doc_id AND abs(o.chunk_index - i.chunk_index) = 1),
    a AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = m.query_id AND h.chunk_key = m.chunk_key)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_key ORDER BY by_rank, kind, s1, s2) AS first FROM a) WHERE first = 1),
    e AS (SELECT query_id, chunk_key, rank AS by_rank, -1 AS kind, 0 AS s1, 0 AS s2, score, dense_score, bm25_score FROM h UNION ALL SELECT query_id, chunk_key, by_rank, kind, s1, s2, score, dense_score, bm25_score FROM f)
    SELECT query_id, chunk_key AS chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind < 0 THEN 0 ELSE 1 END, by_rank, kind, s1, s2) - 1)::INTEGER AS rank, round(score, 8) AS score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score,
        CASE WHEN kind < 0 THEN 'hit' WHEN kind = 0 THEN 'section' ELSE 'neighbor' END AS via FROM e""",
)


@query
def dense_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_topk by blocks of queries and of vectors, as beyond the size of what is broadcast."""
    asked = _vectors(spark, sf_dir).withColumnRenamed("chunk_key", "query_id")
    hits = search.dense_search(_vectors(spark, sf_dir), asked, 10, broadcast_bytes=100_000)
    return hits.select("query_id", F.col("chunk_key").alias("vec_id"), "rank", F.round("dense_score", 6).alias("dense_score"))


oracle("dense_blocks", f"WITH {_dense_sql(10, 'embeddings a', 'a.vec_id')} SELECT query_id, chunk_key AS vec_id, rank, round(dense_score, 6) AS dense_score FROM den")
