"""Chunkers: sections to raw chunks (the section's columns, chunk_ord, text).

recursive   greedy packing on a list of separators, deeper separators for what is too long, token windows at last
structural  a section that fits is a chunk; others are split recursively
semantic    sentences, cut where neighbouring embeddings differ, packed where too long
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.config import ChunkerConfig
from vellumspark.functions import text as T
from vellumspark.operators import tables
from vellumspark.tokenizers import BpeCodec, Tokenizer, WordCodec, by_parts

SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def parent_context(parents: Column, heading: Column) -> Column:
    """The breadcrumb: headings above, then the own one if there is any."""
    return F.array_join(F.concat(F.coalesce(parents, F.array().cast("array<string>")), F.when(F.coalesce(heading, F.lit("")) != "", F.array(heading)).otherwise(F.array().cast("array<string>"))), " → ")


# --- recursive ------------------------------------------------------------------------------------------------


class Splitter:
    """Splits one text. overlap_mode "per_level" repeats the previous chunk's tail at each level of recursion that
    yields several chunks, as the specified behaviour does; "once" does so for the final chunks only."""

    def __init__(self, codec: WordCodec | BpeCodec, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, overlap_mode: str = "per_level"):
        self.codec, self.size, self.overlap, self.separators, self.mode = codec, size, overlap, separators, overlap_mode

    def __call__(self, text: str) -> list[str]:
        found = self._level(text, 0)
        return self._with_tails(found) if self.mode == "once" else found

    def _fits(self, text: str) -> bool:
        return self.codec.count(text) <= self.size

    def _grown(self, held: str, glue: str, part: str, known: tuple[int, int]) -> tuple[str, tuple[int, int]]:
        """held + glue + part, and (place, tokens before it) for counting what is added to that next.

        The place is a seam: no token reaches over it, whatever follows, so what lies before it is counted once.
        """
        longer = held + glue + part if held else part
        seam = self.codec.seam(longer, known[0])
        return longer, (seam, known[1] + self.codec.count(longer[known[0] : seam])) if seam > known[0] else known

    def _level(self, text: str, depth: int) -> list[str]:
        if self._fits(text):
            return [text] if text.strip() else []
        while depth < len(self.separators) and self.separators[depth] not in text:
            depth += 1
        if depth == len(self.separators):
            return self._windows(text)
        glue, done, held = self.separators[depth], [], ""
        # words never join over a separator that isn't of word characters, so their counts add up
        adds = isinstance(self.codec, WordCodec) and not self.codec.count(glue)
        total, known = 0, (0, 0)
        for part in text.split(glue):
            if adds:
                size = self.codec.count(part)
                longer, fits = (held + glue + part if held else part), total + size <= self.size
            else:
                size = 0
                longer, grown = self._grown(held, glue, part, known)
                fits = grown[1] + self.codec.count(longer[grown[0] :]) <= self.size
            if fits:
                held, total = longer, total + size
                known = known if adds else grown
                continue
            if held:
                done.append(held)
            held, total, known = "", 0, (0, 0)
            if size <= self.size if adds else self._fits(part):
                held, total = part, size
            else:
                done += self._level(part, depth + 1)
        if held:
            done.append(held)
        return self._with_tails(done) if self.mode == "per_level" else done

    def _windows(self, text: str) -> list[str]:
        tokens = self.codec.split(text)
        step = max(1, self.size - self.overlap)
        cut = (self.codec.join(tokens[k : k + self.size]) for k in range(0, len(tokens), step))
        return [c for c in cut if c.strip()]

    def _with_tails(self, chunks: list[str]) -> list[str]:
        if self.overlap <= 0:
            return chunks
        tails = (self.codec.join(self.codec.split(c)[-self.overlap :]) for c in chunks[:-1])
        return chunks[:1] + [f"{tail} {c}" for tail, c in zip(tails, chunks[1:], strict=True)]


def _split_udf(tokenizer: Tokenizer, config: ChunkerConfig, separators: tuple[str, ...], overlap_mode: str):  # noqa: ANN202
    size, overlap = config.chunk_size, config.chunk_overlap

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = Splitter(tokenizer.codec(), size, overlap, separators, overlap_mode)
        for texts in batches:
            yield from by_parts(texts, lambda t: [] if t is None else split(t), pa.list_(pa.string()))

    # the filter that the optimizer makes of an explode would run a deterministic function a second time
    return run.asNondeterministic()


def _pieces(sections: DataFrame, pieces: Column) -> DataFrame:
    """A row for each piece that isn't blank, stripped."""
    rows = sections.withColumn("_context", parent_context(F.col("parent_headings"), F.col("heading")))
    kept = F.filter(F.transform(pieces, T.strip), lambda p: p != "")
    return rows.withColumn("_pieces", kept).select("*", F.posexplode("_pieces").alias("chunk_ord", "_piece")).withColumn("text", F.col("_piece")).withColumnRenamed("_context", "parent_context").drop("_pieces", "_piece")


def recursive(sections: DataFrame, config: ChunkerConfig, tokenizer: Tokenizer | None = None, separators: tuple[str, ...] = SEPARATORS, overlap_mode: str = "per_level") -> DataFrame:
    """Tables stay whole, as Markdown; everything else keeps its content type and is split.

    The splitter counts a text's tokens once, where it is: measured, that is several times faster than counting them in an
    expression to spare short texts the way to Python.
    """
    tokenizer = tokenizer or Tokenizer()
    is_table = (F.col("content_type") == "table") & F.col("table_data").isNotNull()
    split = _split_udf(tokenizer, config, separators, overlap_mode)(F.when(~is_table, F.col("text")))
    whole = F.coalesce(T.nonempty(tables.to_markdown(F.col("table_data"))), F.col("text"))
    return _pieces(sections, F.when(is_table, F.array(whole)).otherwise(split))


def structural(sections: DataFrame, config: ChunkerConfig, tokenizer: Tokenizer | None = None, separators: tuple[str, ...] = SEPARATORS, overlap_mode: str = "per_level") -> DataFrame:
    """A chunk for each section that fits; tables and figures count as text here."""
    plain = sections.withColumns({"content_type": F.lit("text"), "table_data": F.lit(None).cast(sections.schema["table_data"].dataType), "figures": F.array().cast(sections.schema["figures"].dataType)})
    return recursive(plain, config, tokenizer, separators, overlap_mode)


# --- sentences ------------------------------------------------------------------------------------------------


def pack_sentences(sentences: Column, size: int, overlap: int = 0, count=T.word_count) -> Column:  # noqa: ANN001
    """Greedy packing as a fold: array of chunks. On overflow whole trailing sentences of at most `overlap` tokens are
    carried into the next chunk; a sentence longer than a chunk stays whole."""
    items = F.transform(sentences, lambda s: F.struct(s.alias("s"), count(s).cast("int").alias("n")))
    kind = "array<struct<s:string,n:int>>"
    start = F.struct(F.array().cast(kind).alias("held"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))

    def text(held: Column) -> Column:
        return F.array_join(F.transform(held, lambda x: x["s"]), " ")

    def carried(held: Column) -> Column:
        """The longest tail of whole sentences within the overlap."""
        begin = F.struct(F.array().cast(kind).alias("tail"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def back(acc: Column, x: Column) -> Column:
            go = acc["go"] & (acc["n"] + x["n"] <= overlap)
            return F.struct(F.when(go, F.concat(F.array(x), acc["tail"])).otherwise(acc["tail"]).alias("tail"), F.when(go, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"), go.alias("go"))

        return F.aggregate(F.reverse(held), begin, back, lambda acc: acc["tail"])

    def total(held: Column) -> Column:
        return F.aggregate(held, F.lit(0), lambda n, x: n + x["n"])

    def step(acc: Column, x: Column) -> Column:
        full = (acc["total"] + x["n"] > size) & (F.size(acc["held"]) > 0)
        tail = carried(acc["held"])
        held = F.concat(F.when(full, tail).otherwise(acc["held"]), F.array(x))
        return F.struct(held.alias("held"), (F.when(full, total(tail)).otherwise(acc["total"]) + x["n"]).alias("total"), F.when(full, F.concat(acc["out"], F.array(text(acc["held"])))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], F.array(text(acc["held"])))).otherwise(acc["out"]))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, with a small term against division by zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def boundaries(units: DataFrame, threshold: float, keys: tuple[str, ...] = ("doc_id", "section_ord"), order: str = "ord") -> DataFrame:
    """units (keys, ord, embedding) with similarity to the unit before, is_boundary and segment, counted from 0."""
    before = Window.partitionBy(*keys).orderBy(order)
    rows = units.withColumn("similarity", F.round(cosine(F.lag("embedding").over(before), F.col("embedding")), 10))
    rows = rows.withColumn("is_boundary", F.col("similarity").isNull() | (F.col("similarity") < threshold))
    return rows.withColumn("segment", (F.sum(F.col("is_boundary").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def merge_segments(units: DataFrame, config: ChunkerConfig, keys: tuple[str, ...] = ("doc_id", "section_ord"), order: str = "ord", count=T.word_count) -> DataFrame:  # noqa: ANN001
    """(keys, segment, part, text): each segment's sentences joined, or packed where they are too long together."""
    listed = units.groupBy(*keys, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "sentence"))), lambda x: x["sentence"]).alias("ss"))
    whole = F.array_join("ss", " ")
    parts = F.when(count(whole) > config.chunk_size, pack_sentences(F.col("ss"), config.chunk_size, config.chunk_overlap, count)).otherwise(F.array(whole))
    return listed.select(*keys, "segment", F.posexplode(parts).alias("part", "text"))


def semantic(sections: DataFrame, config: ChunkerConfig, embed, tokenizer: Tokenizer | None = None) -> DataFrame:  # noqa: ANN001
    """Sections of up to two sentences stay whole; others are cut by embeddings. embed: sentence column -> vector column
    (a pandas UDF around a model, or an expression). Tables and figures count as text here."""
    count = (tokenizer or Tokenizer()).count
    found = sections.withColumn("ss", T.sentences(F.col("text")))
    few = F.size("ss") <= 2
    units = found.where(~few).select("doc_id", "section_ord", F.posexplode("ss").alias("ord", "sentence")).withColumn("embedding", embed(F.col("sentence")))
    merged = merge_segments(boundaries(units, config.similarity_threshold), config, count=count)
    short = found.where(few).select("doc_id", "section_ord", F.lit(0).alias("segment"), F.lit(0).alias("part"), "text")
    texts = merged.unionByName(short).groupBy("doc_id", "section_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "part", "text"))), lambda x: x["text"]).alias("_texts"))
    plain = sections.withColumns({"content_type": F.lit("text"), "table_data": F.lit(None).cast(sections.schema["table_data"].dataType), "figures": F.array().cast(sections.schema["figures"].dataType)})
    return _pieces(plain.join(texts, ["doc_id", "section_ord"]), F.col("_texts")).drop("_texts")
