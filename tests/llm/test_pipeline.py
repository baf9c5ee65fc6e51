"""The pipeline's stages one after the other, against each operator on its own input."""

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.conftest import prose
from vellumspark.llm import common, registry

DOCS = [
    (1, prose(1, 100), "en", "a", 1),
    (2, prose(1, 100) + " tail", "en", "a", 1),
    (3, "spam spam spam " * 40, "en", "a", 1),
    (4, prose(4, 80) + " mail ann@x.example", "en", "b", 1),
    (5, None, "en", "b", None),
    (6, prose(6, 3000), "de", "b", 1),
]


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    folder = write(spark, tmp_path, DOCS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == common.DOCUMENT_COLUMNS, name
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == [1, 2, 4, 6] and ids[1] == [1, 4, 6] and ids[2] == [1, 4, 6]
    assert "ann@x.example" not in str(seen[2].where("doc_id = 4").first().text)
    assert set(ids[3]) <= {1, 4, 6} and seen[4].columns[0] == "bin_id"
    tokens = sum(len(r.text.split()) for r in seen[3].collect())
    assert seen[4].groupBy().sum("n_tokens").first()[0] == tokens
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, seen[4].collect()))


def test_stages_are_the_plain_twins(spark, tmp_path):
    """Every stage over the documents of a small table, against loops that share no code with the operators."""
    from collections import Counter, defaultdict

    import numpy as np

    from tests.llm.test_mixing_packing import slow_mix_texts
    from tests.llm.test_pii import slow_rewrite
    from tests.llm.test_quality import brute, brute_lines
    from tests.llm.test_simhash import slow_classes
    from vellumspark.llm import mixing, packing, pii, quality, simhash

    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set(pii.KEY_SETTING, "key")
    try:
        frames = [given]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, frames[-1], folder).write.parquet(f"{tmp_path}/{k}")
            frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    rows = [[(r.doc_id, r.text, r.source) for r in f.collect()] for f in frames[:5]]
    texts = [dict((i, t) for i, t, _ in x) for x in rows]
    # quality rules
    sound = {i for i, t in texts[0].items() if (t or "").split() and brute_lines(t) <= quality.LINE_LIMIT and all(brute(t, n) <= most for n, most in quality.GRAM_LIMITS.items())}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in sound} and 0 < len(sound) < len(texts[0])
    # near dedup: all pairs of fingerprints
    prints = {r.doc_id: np.array([r[c] for c in simhash.PRINT], np.int64).view(np.uint64) for r in simhash.fingerprints(frames[1]).collect()}
    classes = slow_classes(sorted(prints), [prints[i] for i in sorted(prints)], simhash.RADIUS)
    assert texts[2] == {i: t for i, t in texts[1].items() if classes[i][0] == i} and len(texts[2]) < len(texts[1])
    # pseudonyms
    assert texts[3] == {i: slow_rewrite(t, b"key") for i, t in texts[2].items()} and texts[3] != texts[2]
    # mixing
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    weight = {r.doc_id: {1: 2.0, 0: 0.5}.get(r.quality, 1.0) * (0.1 if r.toxic == 1 else 1.0) for r in labels}
    have = Counter()
    for _, t, s in rows[3]:
        have[s] += len(t.split())
    want = slow_mix_texts(rows[3], weight, {s: n**mixing.TEMPERATURE for s, n in have.items()}, sum(have.values()))
    assert Counter(i for i, _, _ in rows[4]) == want and all(t == texts[3][i] for i, t, _ in rows[4])
    # packing: every token of every copy once, in bins that aren't overfull and that no step improves
    spans, fill, bins = defaultdict(list), Counter(), defaultdict(list)
    for r in frames[5].collect():
        spans[r.doc_id, r.copy].append((r.first_token, r.n_tokens))
        fill[r.bin_id] += r.n_tokens
        bins[r.bin_id].append(r.n_tokens)
    sizes = Counter({i: n for i, n in want.items() if texts[3][i].split()})
    assert Counter(i for i, _ in spans) == sizes and max(fill.values()) <= packing.CAPACITY
    for (i, _), held in spans.items():
        at = 0
        for first, n in sorted(held):
            assert first == at
            at += n
        assert at == len(texts[3][i].split())
    assert len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + len({b >> 32 for b in fill})


def test_awkward_documents_go_through(crowded, empty, spark, tmp_path):
    """Nulls, blanks, repeated rows, a long text and clashing columns, in every stage."""
    folder = write(spark, tmp_path, DOCS)
    for docs in (crowded, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            assert k == 4 or tuple(docs.columns) == common.DOCUMENT_COLUMNS
            docs = common.Saved(spark, "test").put(docs, "stage")
            assert k or docs.where("trim(coalesce(text, '')) = ''").count() == 0


def test_empty_documents(spark, tmp_path):
    folder = write(spark, tmp_path, DOCS)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 11))}
    assert names <= set(entry.queries()) and set(registry.oracle_sql()) <= names
