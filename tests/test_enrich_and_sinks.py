"""Replies, cache, configuration, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_search import chunk_table
from vellumspark import sinks
from vellumspark.config import ChunkerConfig, EnrichmentConfig, load_config
from vellumspark.operators import enrich, graph
from vellumspark.plans import pipeline
from vellumspark.streaming import ingest


def fields(spark, reply, enrichments=("summary", "entities", "keywords", "confidence")):
    df = spark.createDataFrame([(reply,)], "r string").withColumn("v", enrich.parsed(F.col("r")))
    return df.select(*[c.alias(k) for k, c in enrich.extracted(F.col("v"), enrichments).items()]).first().asDict()


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"summary": "s", "entities": ["A", 1], "keywords": ["k"], "confidence": 1.5}', {"summary": "s", "entities": ["A", "1"], "keywords": ["k"], "confidence": 1.0}),
        ('text\n```json\n{"SUMMARY": "s"}\n```', {"summary": "s", "entities": None, "keywords": None, "confidence": None}),
        ('Sure {"Description": "d", "named entities": "one", "tags": ["t"], "score": -2} ok', {"summary": "d", "entities": ["one"], "keywords": ["t"], "confidence": 0.0}),
        ('{"summary": "", "description": "d", "confidence": 0, "score": 0.4}', {"summary": "d", "entities": None, "keywords": None, "confidence": 0.4}),
        ('{"confidence": "high", "keywords": []}', {"summary": None, "entities": None, "keywords": None, "confidence": 0.0}),
        ("nothing", {"summary": None, "entities": None, "keywords": None, "confidence": None}),
        ("[1, 2]", {"summary": None, "entities": None, "keywords": None, "confidence": None}),
        (None, {"summary": None, "entities": None, "keywords": None, "confidence": None}),
    ],
)
def test_reply_ladder(spark, reply, want):
    assert fields(spark, reply) == want


def test_toggles(spark):
    assert fields(spark, '{"summary": "s", "keywords": ["k"]}', ("keywords",)) == {"keywords": ["k"]}


def no_cache(spark):
    return spark.createDataFrame([], "text_hash string, payload string")


def test_enrich_asks_once_for_each_text(spark):
    chunks = chunk_table(spark, ["Same text here.", "Other words.", "Same text here."])
    model = lambda prompts: [json.dumps({"summary": f"len {len(p)}", "confidence": 0.9}) for p in prompts]
    found, replies = enrich.enrich(chunks, no_cache(spark), model)
    got = found.orderBy("chunk_index").collect()
    assert [r.cache_status for r in got] == ["MISS", "MISS", "HIT"] and replies.count() == 2
    assert got[0].summary == got[2].summary and got[1].prev_summary == got[0].summary and got[0].prev_summary == ""
    stats = enrich.cache_stats(enrich.with_cache(chunks, no_cache(spark))).first()
    assert (stats.hits, stats.misses, stats.hit_rate_percent, stats.time_saved_seconds) == (1, 2, 33.3, 1.5)
    again, none = enrich.enrich(chunks, replies.select("text_hash", "payload"), model)
    assert {r.cache_status for r in again.collect()} == {"HIT"} and none.count() == 0
    used = enrich.usage(replies).first()
    assert used.total_tokens == used.prompt_tokens + used.completion_tokens > 0


def test_failed_calls_leave_blank_chunks(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ['{"summary": "ok"}'] * len(prompts)

    chunks = chunk_table(spark, ["good one", "bad one", "bad one"])
    config = EnrichmentConfig(batch_size=1, max_retries=2)
    asked = enrich.with_cache(chunks, no_cache(spark)).where("payload is null").dropDuplicates(["text_hash"]).select("text_hash", F.col("text").alias("prompt"))
    got = {r.text_hash: r.payload for r in enrich.ask(asked, model, config, wait=lambda s: None).collect()}
    assert sorted(map(str, got.values())) == ["None", '{"summary": "ok"}']


def test_extractive_model():
    got = json.loads(enrich.extractive_model(["head\n---\nFirst one. Then Ann met Bobby at noon.\n---"])[0])
    assert got["summary"] == "First one." and "Bobby" in got["entities"]


def test_upsert_prefers_new(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "text_hash string, payload string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "text_hash string, payload string")
    assert {tuple(r) for r in enrich.cache_upsert(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_cache_file(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert sinks.read_cache(spark, path).count() == 0
    for payload in ("1", "2"):
        sinks.write_cache(spark.createDataFrame([("a", payload)], "text_hash string, payload string"), path)
        assert [tuple(r) for r in sinks.read_cache(spark, path).collect()] == [("a", payload)]


def test_config(tmp_path):
    (tmp_path / ".env").write_text("VELLUM_CHUNK_SIZE=100\nVELLUM_STRATEGY='structural'\n# x=1\n")
    got = load_config({"VELLUM_CHUNK_SIZE": "200", "VELLUM_ENRICHMENTS": "summary, Keywords", "VELLUM_ENRICH": "yes"}, str(tmp_path / ".env"), chunk_overlap=0, vector_weight=0.0)
    assert got.chunker == ChunkerConfig("structural", 200, 0) and got.enrichment.enrichments == ("summary", "keywords") and got.enrich
    assert got.retrieval.vector_weight == 0 and load_config({}).chunker == ChunkerConfig()
    for bad in ({"chunk_size": 0}, {"strategy": "x"}, {"temperature": 3.0}, {"similarity_threshold": 2.0}):
        with pytest.raises(ValueError):
            load_config({}, **bad)
    with pytest.raises(TypeError):
        load_config({}, nonsense=1)


def test_json_sinks(spark, tmp_path):
    chunks = graph.link_sequence(chunk_table(spark, ["é one", "two"]))
    path = tmp_path / "deep" / "er" / "x.json"
    sinks.export(chunks, "json", str(path))
    got = json.loads(path.read_text(encoding="utf-8"))
    assert [c["text"] for c in got] == ["é one", "two"] and got[0]["metadata"]["total_chunks"] == 2 and got[0]["prev_id"] is None
    assert "é" in path.read_text(encoding="utf-8")
    sinks.export(chunks, "jsonl", str(tmp_path / "l"))
    assert {json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "l")).collect()} == {c["id"] for c in got}
    assert [c["text"] for c in sinks.export(chunks, "dict")] == ["é one", "two"]
    sinks.export(chunks.where("false"), "json", str(path))
    assert json.loads(path.read_text()) == []
    with pytest.raises(ValueError):
        sinks.export(chunks, "xml")


def test_records_hold_no_nulls_and_reach_a_client(spark, tmp_path):
    chunks = graph.link_sequence(chunk_table(spark, ["one", "two"]))
    first = sinks.vector_records(chunks).orderBy("metadata.chunk_index").first()
    assert first.metadata.prev_id == "" and first.metadata.page == 0 and len(first.metadata) == 18
    assert len(sinks.collection_records(chunks).first().metadata) == 17
    folder = str(tmp_path)

    def connect():
        def send(batch):
            for r in batch:
                with open(f"{folder}/{r['id']}", "w") as f:
                    f.write(r["document"])

        return send

    sinks.upsert(sinks.collection_records(chunks), connect, 1)
    assert len(list(tmp_path.iterdir())) == 2


def test_reports(spark):
    hits = spark.createDataFrame([(1, "a", 1, "A"), (1, "b", 0, "B"), (2, "c", 3, "C")], "query_id long, chunk_key string, rank int, text string")
    assert {r.query_id: r.context for r in pipeline.context_blocks(hits).collect()}[1] == "[1] B\n\n---\n\n[2] A"
    relevant = spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "query_id long, chunk_key string")
    got = pipeline.retrieval_metrics(hits, relevant).first()
    assert (got.n_queries, got.hit_at_3, got.hit_at_5) == (3, 0.333333, 0.666667) and got.mrr == pytest.approx((0.5 + 0.25) / 3, abs=1e-6)


def test_stream(spark, tmp_path):
    rows = spark.sql("select 1L doc_id, 'a b' text, 's' source, timestamp'2024-01-01' arrived union all select 2L, 'a b', 's', timestamp'2024-01-01' union all select 3L, 'c', 's', timestamp'2024-01-01'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.fresh(ingest.read_documents(spark, str(tmp_path / "in")))
    ingest.write_chunks(stream, str(tmp_path / "chunks"), str(tmp_path / "edges"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "chunks")).collect()) == ["a b", "c"]
    assert ingest.counts(ingest.read_documents(spark, str(tmp_path / "in"))).isStreaming


def test_chat_settings_reach_the_service(spark):
    seen = []

    def call(messages, model, temperature):
        seen.append(([m["role"] for m in messages], model, temperature))
        if "fail" in messages[1]["content"]:
            raise OSError("no answer")
        return "{}"

    model = enrich.chat_model(call, EnrichmentConfig(model="large", temperature=0.3))
    out = model(["a", "fail"])
    assert out[0] == "{}" and isinstance(out[1], OSError) and seen[0] == (["system", "user"], "large", 0.3)


def test_usage_with_prices(spark):
    replies = spark.createDataFrame([(1000, 500), (1000, 0)], "prompt_tokens long, completion_tokens long")
    assert enrich.usage(replies).first().asDict() == {"prompt_tokens": 2000, "completion_tokens": 500, "total_tokens": 2500, "cost": None}
    assert enrich.usage(replies, 0.5, 2.0).first().cost == 2.0


def test_export_to_a_store_with_vectors(spark, tmp_path):
    from vellumspark.functions import embedding
    from vellumspark.plans import pipeline

    docs = spark.createDataFrame([(1, "a.txt", "One text.\n\nAnother text.")], "doc_id long, source string, text string")
    chunks = pipeline.process_text(docs).chunks

    def connect():
        def send(records):
            import json
            import uuid

            (tmp_path / uuid.uuid4().hex).write_text(json.dumps([(r["id"], len(r["values"]), sum(x * x for x in r["values"])) for r in records]))

        return send

    for kind in ("vectors", "collection"):
        for f in tmp_path.iterdir():
            f.unlink()
        sinks.export(chunks, kind, connect=connect, embed=embedding.hashed(16))
        import json

        got = [x for f in tmp_path.iterdir() for x in json.loads(f.read_text())]
        assert {g[0] for g in got} == {r.chunk_id for r in chunks.collect()} and all(g[1] == 16 and abs(g[2] - 1) < 1e-5 for g in got)
    with pytest.raises(ValueError):
        sinks.export(chunks, "vectors")


def test_a_broken_write_leaves_the_old_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    one = spark.createDataFrame([("a", "x")], "text_hash string, payload string")
    sinks.write_cache(one, path)
    (tmp_path / "cache").rename(tmp_path / "cache.old")
    assert sinks.read_cache(spark, path).count() == 1
    sinks.write_cache(one.union(one.selectExpr("'b'", "'y'")), path)
    assert sinks.read_cache(spark, path).count() == 2 and not (tmp_path / "cache.old").exists()


def test_fields_are_worked_out_once_for_all(spark):
    reply = '{"SUMMARY": "", "summary": "a \\"b\\"", "Summary": 0, "description": ["x", 1], "tags": "t", "keywords": [], "named entities": {"k": null}, "confidence": "NaN", "score": 7}'
    df = spark.createDataFrame([(reply,), ("[1]",), ("{}",), (None,)], "reply string").withColumn("f", enrich.fields(enrich.parsed(F.col("reply"))))
    assert [r.f for r in df.where("reply is not null and reply like '{\"%'").collect()] == [("a \"b\"", ["{\"k\":null}"], ["t"], 0.0)]
    shown = df.where("reply is null or reply not like '{\"%'").select("f.*").collect()
    assert len(shown) == 3 and all(v is None for r in shown for v in r)
    # reading all fields costs one reading of the reply
    plan = df.select("f.summary", "f.entities", "f.keywords", "f.confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") == 1 or plan.count("schemaOfVariant") == 1
