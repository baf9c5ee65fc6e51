"""Retrieval against plain models of BM25, reciprocal ranks and expansion."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.config import RetrievalConfig
from vellumspark.operators import rows, search


def tokens(t):
    return re.findall(r"\w+", t.lower())


def plain_bm25(texts, query, k, okapi=False):
    docs = [tokens(t) for t in texts]
    mean = sum(map(len, docs)) / max(1, len(docs))
    df = Counter(w for d in docs for w in set(d))
    if okapi:
        idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        low = 0.25 * sum(idf.values()) / max(1, len(idf))
        idf = {w: low if x < 0 else x for w, x in idf.items()}
    else:
        idf = {w: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    out = []
    for d in docs:
        tf, s = Counter(d), 0.0
        for w in tokens(query):
            if tf[w]:
                s += idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(s)
    top = sorted((x for x in range(len(docs)) if out[x] > 0), key=lambda x: (-round(out[x], 10), x))[:k]
    return [(x, out[x] / out[top[0]]) for x in top]


def chunk_table(spark, texts, contexts=None):
    raw = [(0, "src", 0, k, t, (contexts or [""] * len(texts))[k], None, "text", None, []) for k, t in enumerate(texts)]
    df = spark.createDataFrame(raw, "doc_id long, source string, section_ord int, chunk_ord int, text string, parent_context string, page int, content_type string, table_data string, figures array<string>")
    return rows.with_context(rows.build_chunks(df, "structural"))


@pytest.mark.parametrize("okapi", [False, True])
def test_bm25_is_the_plain_formula(spark, okapi):
    rng = random.Random(3)
    # by the classical weights "ab" is in so many texts that its own is below 0
    texts = [" ".join(rng.choice("ab ab ab ba ca da eé f g h i".split()) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    asked = ["ab ab f", "zzz", "", "EÉ g g g", "ca"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = search.bm25_search(search.build_index(df, "id", F.col("text")), queries, 7, okapi).collect()
    for q, text in enumerate(asked):
        mine = sorted(((r.rank, r.chunk_key, r.bm25_score) for r in got if r.query_id == q))
        want = plain_bm25(texts, text, 7, okapi)
        assert [m[1] for m in mine] == [w[0] for w in want] and [m[0] for m in mine] == list(range(len(want)))
        assert np.allclose([m[2] for m in mine], [w[1] for w in want])


def test_index_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "")], "id long, text string")
    queries = spark.createDataFrame([(0, "b c")], "query_id long, query string")
    index = search.build_index(df, "id", F.col("text"), str(tmp_path / "i"))
    loaded = search.Index.load(spark, str(tmp_path / "i"))
    assert search.bm25_search(loaded, queries).collect() == search.bm25_search(index, queries).collect()
    assert loaded.totals.first().n == 3


def test_dense_is_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(50, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_key long, embedding array<float>")
    asked = vectors.withColumnRenamed("chunk_key", "query_id").where("query_id < 5")
    got = search.dense_search(vectors, asked, 6).collect()
    fast = search.dense_search(vectors.repartition(3), asked, 6, dims=8).collect()
    shown = lambda rows: sorted((r.query_id, r.rank, r.chunk_key, round(r.dense_score, 10)) for r in rows)
    assert shown(got) == shown(fast)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(5):
        s = y @ y[q]
        want = [k for k in np.argsort(-s, kind="stable") if s[k] > 0][:6]
        assert [r.chunk_key for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_fusion(spark):
    legs = "query_id long, chunk_key string, rank int, {}_score double"
    dense = spark.createDataFrame([(1, "a", 0, 0.9), (1, "b", 1, 0.8)], legs.format("dense"))
    lexical = spark.createDataFrame([(1, "b", 0, 1.0), (1, "c", 1, 0.5), (2, "d", 0, 1.0)], legs.format("bm25"))
    got = search.fuse(dense, lexical, RetrievalConfig(0.5, 0.5)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_key) for r in got] == [(1, "b"), (1, "a"), (1, "c"), (2, "d")]
    assert got[0].score == pytest.approx(0.5 / 62 + 0.5 / 61) and got[1].bm25_score == 0
    # equal scores: the dense list's one first
    tie = search.fuse(dense.where("rank = 0"), lexical.where("chunk_key = 'c'").withColumn("rank", F.lit(0)), RetrievalConfig(0.5, 0.5)).orderBy("rank").collect()
    assert [r.chunk_key for r in tie] == ["a", "c"]


def test_filters(spark):
    df = spark.createDataFrame([("A", 1.0, None, True), ("b", 0.5, "X", False)], "s string, d double, n string, b boolean")
    keep = lambda f: [r.s for r in df.where(search.matches(df, f)).collect()]
    assert keep({"s": "a"}) == ["A"] and keep({"d": 1.0}) == ["A"] and keep({"d": 0.5}) == ["b"]
    assert keep({"n": None}) == ["A"] and keep({"b": True}) == ["A"] and keep({"n": "x", "s": "B"}) == ["b"]
    assert keep({"absent": 1}) == [] and keep({}) == ["A", "b"]


def test_expansion_stops_at_gaps_and_first_hit_wins(spark):
    places = [(f"d{d}c{k}", d, k, s) for d, k, s in [(1, 0, "x"), (1, 1, "x"), (1, 3, "x"), (1, 4, "y"), (2, 0, "x")]]
    chunks = spark.createDataFrame(places, "chunk_key string, doc_id long, chunk_index int, section_id string")
    hits = spark.createDataFrame([(0, "d1c3", 0, 1.0, 0.5, 0.25), (0, "d1c4", 1, 0.5, 0.0, 0.5)], "query_id long, chunk_key string, rank int, score double, dense_score double, bm25_score double")
    shown = lambda **o: [(r.chunk_key, round(r.score, 4), r.dense_score, r.via) for r in search.expand(hits, chunks, **o).orderBy("rank").collect()]
    both = [("d1c3", 1.0, 0.5, "hit"), ("d1c4", 0.5, 0.0, "hit")]
    assert shown(neighbors=3) == both  # chunk 2 isn't there, so the walk doesn't reach 1
    assert shown(parents=True) == [*both, ("d1c0", 0.9, 0.5, "section"), ("d1c1", 0.9, 0.5, "section")]
    assert ("d2c0", 0.9, 0.5, "section") in shown(parents=True, cross_document=True)
    assert shown() == both


def test_hybrid_with_reranker_and_expansion(spark):
    chunks = chunk_table(spark, ["AI grows", "plain words", "more AI here", "end"], ["A", "A", "B", "B"])
    queries = spark.createDataFrame([(1, "AI words"), (2, " ")], "query_id long, query string")
    model = lambda q, texts: [0.95 if "more" in t else 0.1 for t in texts]
    got = search.hybrid_search(chunks, queries, top_k=3, reranker=model).orderBy("rank").collect()
    texts = {r.chunk_id: r.text for r in chunks.collect()}
    assert texts[got[0].chunk_key] == "more AI here" and got[0].rerank_score == 0.95 and {r.query_id for r in got} == {1}
    wide = search.hybrid_search(chunks, queries, config=RetrievalConfig(0.5, 0.5, True, 1), top_k=1).collect()
    assert len(wide) > 1 and sum(r.via == "hit" for r in wide) == 1
    assert search.hybrid_search(chunks, queries, top_k=3, filters={"parent_context": "b"}).count() == 1
    assert search.hybrid_search(chunks.where("false"), queries).count() == 0


def test_rerank_by(spark):
    hits = spark.createDataFrame([(1, "a", 0, 1.0, 3), (1, "b", 1, 0.9, 5), (1, "c", 2, 0.8, 5)], "query_id long, chunk_key string, rank int, score double, size int")
    got = search.rerank_by(hits, F.col("size"), 2).orderBy("rank").collect()
    assert [(r.chunk_key, r.score) for r in got] == [("b", 5.0), ("c", 5.0)]


def test_hybrid_makes_no_product_of_all_pairs(spark):
    """Default legs by an embed function; the plans of both legs, run and shown."""
    from vellumspark.config import RetrievalConfig
    from vellumspark.functions import embedding

    texts = ["Revenue grew by ten percent", "The cat sat on the mat", "Costs fell in the second quarter", "Revenue and costs of the cat"]
    chunks = chunk_table(spark, texts)
    asked = spark.createDataFrame([(1, "revenue growth"), (2, "cat mat"), (3, "  ")], "query_id long, query string")
    found = search.hybrid_search(chunks, asked, config=RetrievalConfig(0.5, 0.5, expand_parents=True, expand_neighbors=1), top_k=2, embed=embedding.hashed(32), reranker=search.overlap)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and found.count() > 0
    best = {r.query_id: r.chunk_key for r in found.where("rank = 0").collect()}
    by_text = {r.text: r.chunk_id for r in chunks.collect()}
    assert set(best) == {1, 2} and best[2] == by_text[texts[1]]
    assert search.shown(found).where("score <> round(score, 4)").count() == 0


def test_dense_blocks_are_the_broadcast_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(k, rng.normal(size=6).round(1).tolist()) for k in range(300)] + [(900, None)], "chunk_key long, embedding array<float>")
    asked = vectors.withColumnRenamed("chunk_key", "query_id")
    rows = lambda **o: sorted(map(str, search.dense_search(vectors, asked, 5, **o).collect()))
    assert rows() == rows(broadcast_bytes=2000) and len(rows()) == 1500
    assert search.dense_search(vectors, asked.where("false"), 5).count() == 0


def test_unknown_ids_of_an_own_leg_fail(spark):
    chunks = chunk_table(spark, ["one text", "another text"])
    asked = spark.createDataFrame([(1, "text")], "query_id long, query string")
    leg = lambda q, k: q.selectExpr("query_id", "'nowhere' AS chunk_key", "0 AS rank", "1.0D AS dense_score")
    with pytest.raises(Exception, match="isn't there"):
        search.hybrid_search(chunks, asked, dense=leg).collect()


def test_passages_in_documents(spark):
    docs = spark.createDataFrame([(1, "xx rare bird sings loud"), (2, "the bird sings"), (3, "rarebird sings aloud and long"), (4, None)], "chunk_key long, text string")
    asked = spark.createDataFrame([(1, "are bird sings lou"), (2, "ird"), (3, "bird sings now"), (4, "sings"), (5, "the bird sings")], "query_id long, query string")
    index = search.build_index(docs, "chunk_key", docs["text"])
    got = sorted(tuple(r) for r in search.containing(docs, asked, index).collect())
    want = sorted((q.query_id, d.chunk_key) for q in asked.collect() for d in docs.collect() if d.text and q.query in d.text)
    assert got == want


@pytest.mark.parametrize("okapi", [False, True])
def test_blocks_score_as_the_join_does(spark, monkeypatch, okapi):
    rng = random.Random(5)
    # a few common words, so that scores tie over blocks; keys that several chunks have, and none
    keys = [None, None, 7, 7, 7, *range(5, 300)]
    texts = [" ".join(rng.choices("ab ba ca da e f g h".split(), [9, 5, 3, 3, 2, 1, 1, 1], k=rng.randint(0, 6))) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, texts, strict=True)), "id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(rng.choices("ab ba ca e f h zz".split(), k=3))) for q in range(300)], "query_id long, query string")
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 16)
    index = search.build_index(df, "id", F.col("text"))
    assert index.blocks.count() >= 300 // 16 and sorted((r.chunk_key is None, r.chunk_key) for r in index.repeated.collect()) == [(False, 7), (True, None)]
    assert sorted(tuple(r) for r in index.terms.collect()) == sorted(Counter(w for t in texts for w in set(t.split())).items())

    def found():
        return sorted((r.query_id, r.rank, repr(r.chunk_key), round(r.bm25_score, 12)) for r in search.bm25_search(index, queries, 5, okapi).collect())

    blocks = found()
    monkeypatch.setattr(search, "SENT_ROWS", 0)
    assert blocks == found() and len({q for q, *_ in blocks}) > 250


def test_tasks_let_go_of_the_best_only(spark):
    # a common word in all chunks: scores of all of them were shuffled
    df = spark.range(3000).selectExpr("id", "concat('common ', repeat('x ', cast(id % 7 as int))) as text").coalesce(2)
    queries = spark.createDataFrame([(q, "common x") for q in range(20)], "query_id long, query string")
    index = search.build_index(df, "id", F.col("text"))
    rows = search.query_weights(index, queries).toArrow()
    scored = search._block_best(index, rows, index.repeated.toArrow()["chunk_key"].combine_chunks(), 4, "long")
    assert scored.count() <= 20 * 4 * 2
    best = search.bm25_search(index, queries, 4).where("query_id = 3").orderBy("rank").collect()
    assert [r.chunk_key for r in best] == [6, 13, 20, 27]


def test_passages_are_searched_where_all_their_words_are(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("a b c d e f".split(), k=12)) for _ in range(80)]
    passages = [t[i : i + 9] for t in texts[:40] for i in (0, 4)] + ["a", "a b", "zz a b", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_key long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 16)
    index = search.build_index(docs, "chunk_key", docs["text"])
    want = sorted((q, k) for q, p in enumerate(passages) for k, t in enumerate(texts) if p in t)
    assert sorted(tuple(r) for r in search.containing(docs, asked, index).collect()) == want
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "f", 1.0), (1, "zz", 1.0), (1, "a", 1.0)], "query_id long, term string, w double").toArrow()
    found = search._with_all_words(index, rows, "long")
    assert sorted(tuple(r) for r in found.collect()) == [(0, k) for k, t in enumerate(texts) if {"a", "f"} <= set(t.split())]
    monkeypatch.setattr(search, "SENT_ROWS", 0)
    assert sorted(tuple(r) for r in search.containing(docs, asked, index).collect()) == want


@pytest.mark.parametrize("layout", ["sent", "blocks"])
def test_dense_is_exact_on_odd_vectors(spark, monkeypatch, layout):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    # copies, so that scores tie; next to equal ones; zeros; short ones, of which the small term takes most; one that isn't a number
    x[50:90], x[90:130] = x[:40], x[:40] * 3
    x[130:160] = x[:30] + rng.normal(size=(30, 6)) * 1e-7
    x[200], x[201:230], x[230:240] = 0, x[201:230] * 1e-8, x[230:240] * 1e-5
    x[300, 2] = np.nan
    x = x.astype(np.float32)
    monkeypatch.setattr(search, "VECTOR_BYTES", 4096)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_key long, embedding array<float>").repartition(3)
    asked = vectors.withColumnRenamed("chunk_key", "query_id")
    got = search.dense_search(vectors, asked, 7, broadcast_bytes=1 << 20 if layout == "sent" else 3000).collect()
    y = x.astype(float)
    norm = np.sqrt((y**2).sum(1))
    score = np.nan_to_num(np.maximum(0.0, (y[:, None, :] * y[None]).sum(2) / (norm[:, None] * norm + 1e-10)))
    shown = np.round(score, 10)
    want = [(q, r, k, shown[q, k]) for q in range(400) for r, k in enumerate([k for k in np.lexsort((np.arange(400), -shown[q])) if score[q, k] > 0][:7])]
    mine = sorted((r.query_id, r.rank, r.chunk_key, r.dense_score) for r in got)
    assert [m[:3] for m in mine] == [w[:3] for w in want] and np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-9)


def test_blocks_of_queries_stay_few(spark, monkeypatch):
    # each takes a copy of all vectors: with a block for each 100 bytes there would be 64
    made = []
    whole = search._grid_search
    monkeypatch.setattr(search, "_grid_search", lambda *a: made.append(a[4:]) or whole(*a))
    vectors = spark.range(200).selectExpr("id as chunk_key", "array(float(id), float(1), float(id % 3), float(2)) as embedding")
    asked = vectors.withColumnRenamed("chunk_key", "query_id")
    got = search.dense_search(vectors, asked, 3, broadcast_bytes=100)
    assert made == [(search.QUERY_BLOCKS, 1)] and got.count() == 600
