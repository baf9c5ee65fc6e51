"""Chunkers against plain models, and the invariants of chunk rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumspark.config import ChunkerConfig
from vellumspark.operators import chunking, graph, rows
from vellumspark.plans import pipeline
from vellumspark.sources import markdown, plain
from vellumspark.tokenizers import TAKEN, TAKEN_BYTES, Tokenizer, WordCodec, by_parts


def sections(spark, *texts):
    return plain.as_sections(spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string"), text=F.col("text"))


def test_short_and_long(spark):
    got = chunking.recursive(sections(spark, "This is a sentence. " * 50, "short", "", "  "), ChunkerConfig(chunk_size=20, chunk_overlap=0)).collect()
    long = [r.text for r in got if r.doc_id == 0]
    assert len(long) > 5 and all(WordCodec().count(t) <= 20 for t in long)
    assert sum(WordCodec().count(t) for t in long) == 200
    assert [r.text for r in got if r.doc_id == 1] == ["short"] and not [r for r in got if r.doc_id > 1]


def test_overlap_once_and_per_level():
    split = chunking.Splitter(WordCodec(), 4, 2)
    assert split("a b c d. e f g") == ["a b c d", " c d e f g"]
    # the part that is split again repeats tails at its own level and at the level above
    nested = split("x y. a b c d e f g")
    assert nested[0] == "x y" and nested[1].startswith("x y a b") and "c d" in nested[2]
    once = chunking.Splitter(WordCodec(), 4, 2, overlap_mode="once")("x y. a b c d e f g")
    assert sum(len(c.split()) for c in nested) > sum(len(c.split()) for c in once)


def test_hard_windows():
    split = chunking.Splitter(WordCodec(), 3, 1, separators=("\n",))
    assert split("a b c d e") == ["a b c", " c d e", " e"]


def test_codec_pieces_add_up():
    codec = WordCodec()
    for text in ("", "  a, b!  ", "...", "x", "a b c. ", "\u00e9t\u00e9 \u00bd"):
        assert codec.join(codec.split(text)) == text
        assert codec.count(text) == len([p for p in codec.split(text) if any(c.isalnum() or c == "_" for c in p)])


def test_tables_stay_whole_only_where_recursive(spark):
    table = (["A", "B"], [["1", "2"], ["3", "4"]], "")
    df = sections(spark, "ignored").withColumn("content_type", F.lit("table")).withColumn("table_data", F.struct(F.array(F.lit("A"), F.lit("B")).alias("headers"), F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"), F.lit("4"))).alias("rows"), F.lit("").alias("caption")))
    whole = chunking.recursive(df, ChunkerConfig(chunk_size=1)).collect()
    assert len(whole) == 1 and whole[0].text.startswith("| A | B |") and list(whole[0].table_data.headers) == table[0]
    flat = chunking.structural(df, ChunkerConfig(chunk_size=50)).collect()
    assert (flat[0].text, flat[0].content_type, flat[0].table_data) == ("ignored", "text", None)


def _packed(items, size, overlap):
    out, held = [], []
    for s in items:
        n = len(s.split())
        if held and sum(len(x.split()) for x in held) + n > size:
            out.append(" ".join(held))
            tail, total = [], 0
            for x in reversed(held):
                if total + len(x.split()) > overlap:
                    break
                tail, total = [x, *tail], total + len(x.split())
            held = tail
        held = [*held, s]
    return [*out, " ".join(held)] if held else out


@pytest.mark.parametrize("overlap", [0, 3, 100])
def test_sentence_packing_is_the_plain_loop(spark, overlap):
    rng = random.Random(overlap)
    cases = [[" ".join(["w"] * rng.randint(1, 12)) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, s array<string>")
    got = {r.k: r.p for r in df.select("k", chunking.pack_sentences(F.col("s"), 10, overlap).alias("p")).collect()}
    assert got == {k: _packed(c, 10, overlap) for k, c in enumerate(cases)}


def test_semantic_cuts_where_vectors_turn(spark):
    text = "Cats sleep. Cats eat. Dogs bark. Dogs run."
    embed = lambda s: F.when(s.startswith("Cats"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    got = chunking.semantic(sections(spark, text, "One. Two.", "", "A a. B b. C c."), ChunkerConfig(chunk_size=5, chunk_overlap=0), embed).orderBy("doc_id", "chunk_ord").collect()
    assert [r.text for r in got if r.doc_id == 0] == ["Cats sleep. Cats eat.", "Dogs bark. Dogs run."]
    assert [r.text for r in got if r.doc_id == 1] == ["One. Two."]
    assert [r.text for r in got if r.doc_id == 3] == ["A a. B b.", "C c."]


def test_bpe_tokenizer(spark):
    bpe = Tokenizer("bpe", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "Hello there, <|endoftext|> is text. " * 20
    got = chunking.recursive(sections(spark, text), ChunkerConfig(chunk_size=16, chunk_overlap=0), bpe).collect()
    assert all(bpe.codec().count(r.text) <= 16 for r in got) and len(got) > 5


def slow_split(codec, text, size, overlap, separators=chunking.SEPARATORS):
    """The splitter as specified: each candidate is encoded whole."""
    if codec.count(text) <= size:
        return [text] if text.strip() else []
    for k, glue in enumerate(separators):
        if glue in text:
            break
    else:
        tokens = codec.split(text)
        return [c for i in range(0, len(tokens), max(1, size - overlap)) if (c := codec.join(tokens[i : i + size])).strip()]
    done, held = [], ""
    for part in text.split(glue):
        longer = held + glue + part if held else part
        if codec.count(longer) <= size:
            held = longer
            continue
        done += [held] if held else []
        held = ""
        if codec.count(part) <= size:
            held = part
        else:
            done += slow_split(codec, part, size, overlap, separators[k + 1 :])
    done += [held] if held else []
    tails = [codec.join(codec.split(c)[-overlap:]) for c in done[:-1]] if overlap else []
    return done[:1] + [f"{t} {c}" for t, c in zip(tails, done[1:], strict=True)] if overlap else done


@pytest.mark.parametrize(("size", "overlap"), [(3, 0), (10, 3), (40, 10)])
def test_splitting_is_the_plain_splitter(size, overlap):
    rng = random.Random(size)
    atoms = ["word", "l'été", "漢字", "don't", "12", "3.5", " ", "  ", "\n", "\n\n", ". ", "! ", "; ", ", ", "x" * 30, "-", "\u00a0", "..", "😀"]
    texts = ["".join(rng.choice(atoms) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for codec in (WordCodec(), Tokenizer("bpe", "/opt/tokenizers/byte_bpe_50k.tiktoken").codec()):
        for text in texts:
            assert chunking.Splitter(codec, size, overlap)(text) == slow_split(codec, text, size, overlap), text


def test_registered_chunk_queries_are_the_plain_splitter(spark):
    """recursive_chunks, structural_chunks_split and process_text over all documents of a small table."""
    from vellumspark.plans import catalog

    folder = "/root/testdata/sf0.001"
    config, codec = ChunkerConfig(), WordCodec()
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        blocks = [" ".join(b.split()) for b in (r.text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
        want[r.doc_id] = [p.strip() for b in blocks if b for p in slow_split(codec, b, config.chunk_size, config.chunk_overlap) if p.strip()]
    assert max(map(len, want.values())) > 3
    for name in ("recursive_chunks", "structural_chunks_split", "process_text"):
        got = {}
        order = "chunk_index" if name != "structural_chunks_split" else "chunk_ord"
        for r in sorted(catalog.queries()[name](spark, folder).collect(), key=lambda r: (r.doc_id, r.asDict().get("section_ord", 0), r[order])):
            got.setdefault(r.doc_id, []).append(r.text if name != "process_text" else r.contextual_text.split("\n", 1)[1])
        assert got == {i: c for i, c in want.items() if c}, name


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "d", "# A\none two\n## B\nthree"), (2, "e", "plain")], "doc_id long, source string, text string")
    raw = chunking.structural(markdown.markdown_sections(docs), ChunkerConfig())
    got = rows.build_chunks(raw, "structural").orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.parent_context, r.depth) for r in got] == [(0, 2, "A", 1), (1, 2, "A \u2192 B", 2), (0, 1, "", 0)]
    assert got[2].section_id is None and got[0].section_id != got[1].section_id
    assert len({r.chunk_id for r in got}) == 3 and got == rows.build_chunks(raw, "structural").orderBy("doc_id", "chunk_index").collect()


def test_contextual_text(spark):
    df = spark.createDataFrame([("T", "S", "Sum", "x"), ("<string>", "", "", "x"), (None, None, None, "x")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(rows.contextual_text(*map(F.col, "abcd"))).collect()] == ["Document: T\nSection: S\nSummary: Sum\nx", "x", "x"]


def test_graph(spark):
    data = [(1, k, f"c{k}", s, e) for k, (s, e) in enumerate([("a", ["X", "x "]), ("a", ["Y"]), (None, ["x"]), ("b", [])])] + [(2, 0, "z", "a", ["X"])]
    chunks = spark.createDataFrame(data, "doc_id long, chunk_index int, chunk_id string, section_id string, entities array<string>")
    got = {(r.src_id, r.dst_id, r.relation, r.weight) for r in graph.edges(chunks).collect()}
    follow = {(f"c{k + 1}", f"c{k}", "follows", 1.0) for k in range(3)} | {(f"c{k}", f"c{k + 1}", "precedes", 1.0) for k in range(3)}
    assert got == follow | {("c0", "c1", "same_section", 1.0), ("c1", "c0", "same_section", 1.0), ("c0", "c2", "shared_entity", 0.8), ("c2", "c0", "shared_entity", 0.8)}
    across = graph.entity_edges(chunks, scope=()).collect()
    assert ("c0", "z") in {(r.src_id, r.dst_id) for r in across}
    nested = {r.src_id: [(x.relation, x.target_id) for x in r.relationships] for r in graph.nested(graph.edges(chunks)).collect()}
    assert nested["c1"] == [("follows", "c0"), ("precedes", "c2"), ("same_section", "c0")]
    assert graph.section_edges(chunks, max_section=1).count() == 0


def test_process_text_links(spark):
    docs = spark.createDataFrame([(1, "d", "a b.\n\nc d."), (2, "<string>", "x")], "doc_id long, source string, text string")
    got = pipeline.process_text(docs).chunks.orderBy("doc_id", "chunk_index").collect()
    assert got[0].next_id == got[1].chunk_id and got[1].prev_id == got[0].chunk_id and got[0].prev_id is None
    assert got[0].contextual_text == "Document: d\na b." and got[2].contextual_text == "x"
    assert {r.cache_status for r in got} == {"DISABLED"}


def test_process_markdown_text(spark):
    docs = spark.createDataFrame([(1, "d", "# H\nbody")], "doc_id long, source string, text string")
    assert pipeline.process_text(docs, format="markdown").chunks.first().parent_context == "H"


def test_process_files(spark, tmp_path):
    (tmp_path / "note.md").write_text("# H\nbody")
    assert pipeline.process_files(spark, str(tmp_path)).chunks.first().contextual_text == "Document: note\nSection: H\nbody"
    with pytest.raises(Exception, match="(?i)path"):
        pipeline.process_files(spark, str(tmp_path / "none"))


def test_registered_structural_query_splits(spark, tmp_path):
    from vellumspark.plans import catalog

    long = " ".join(f"Word{k} and more words, as it goes." for k in range(400))
    texts = {1: "short text", 2: long, 3: "w " * 600, 4: ""}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.section_ord, r.chunk_ord): r.text for r in catalog.queries()["structural_chunks_split"](spark, str(tmp_path)).collect()}
    split = chunking.Splitter(WordCodec(), 512, 50)
    want = {(d, 0, k): c.strip() for d, t in texts.items() for k, c in enumerate(c for c in split(t.strip()) if c.strip())}
    assert got == want and len([k for k in got if k[0] == 2]) > 5


def test_batches_are_taken_out_of_arrow_in_parts(spark):
    texts = pa.array(["a b c", None] * 1000 + ["x " * 200_000] * 8)
    held = []
    parts = list(by_parts(texts, lambda t: held.append(t) or (0 if t is None else len(t.split())), pa.int32()))
    assert max(map(len, parts)) <= TAKEN and len(parts) >= 8 and held == texts.to_pylist()
    assert max(p.nbytes for p in by_parts(texts, lambda t: t, pa.string())) < 2 * TAKEN_BYTES + 8 * 400_000
    assert [n for p in parts for n in p.to_pylist()] == [3, 0] * 1000 + [200_000] * 8
    # a batch's parts come back beside their own rows
    df = spark.range(3000).coalesce(1).selectExpr("id as doc_id", "concat('s', id) as source", "repeat(concat('w', id, ' '), int(id % 900)) as text")
    made = chunking.recursive(plain.text_sections(df), ChunkerConfig(chunk_size=100, chunk_overlap=0)).select("doc_id", "text").collect()
    assert {r.doc_id for r in made} == {k for k in range(3000) if k % 900} and all(set(r.text.split()) == {f"w{r.doc_id}"} for r in made)
    assert sum(len(r.text.split()) for r in made) == sum(k % 900 for k in range(3000))
