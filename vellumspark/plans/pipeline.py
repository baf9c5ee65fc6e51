"""From documents to chunks and edges, and small reports on search results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.config import PipelineConfig
from vellumspark.functions import embedding
from vellumspark.functions import text as T
from vellumspark.operators import chunking, enrich, graph, rows
from vellumspark.sources import files, markdown, plain
from vellumspark.tokenizers import Tokenizer

#: Chunkers by name: sections, configuration and tokenizer to raw chunks. Callers may add their own.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"recursive": chunking.recursive, "structural": chunking.structural}
#: Parsers of texts by format.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"text": plain.text_sections, "markdown": markdown.markdown_sections, "html": files.html_sections, "html_plain": plain.html_plain_sections}


@dataclass
class Processed:
    """chunks (with links and contextual text), edges, and the model's replies where enrichment ran."""

    chunks: DataFrame
    edges: DataFrame
    replies: DataFrame | None = None


def chunk(sections: DataFrame, config: PipelineConfig, tokenizer: Tokenizer | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The chunks table of sections, by the configured strategy. "semantic" goes by embed, or by hashed words without it."""
    name = config.chunker.strategy
    if name == "semantic":
        raw = chunking.semantic(sections, config.chunker, embed or embedding.hashed(), tokenizer)
    else:
        raw = CHUNKERS[name](sections, config.chunker, tokenizer)
    return rows.build_chunks(raw, name, tokenizer, config.enrich)


def process_sections(sections: DataFrame, config: PipelineConfig | None = None, tokenizer: Tokenizer | None = None, embed: Callable[[Column], Column] | None = None, model: enrich.Model | None = None, cache: DataFrame | None = None, title: Column | None = None) -> Processed:
    """Chunks, graph, enrichment (with a model) and contextual text; lazy but for the model's replies."""
    config = config or PipelineConfig(enrich=model is not None)
    chunks = chunk(sections, config, tokenizer, embed)
    replies = None
    if config.enrich and model is not None:
        spark = sections.sparkSession
        cache = spark.createDataFrame([], "text_hash string, payload string") if cache is None else cache
        chunks, replies = enrich.enrich(chunks, cache, model, config.enrichment)
    chunks = rows.with_context(graph.link_sequence(chunks), title)
    return Processed(chunks, graph.edges(chunks, entities=replies is not None), replies)


def process_text(docs: DataFrame, config: PipelineConfig | None = None, format: str = "text", **options: object) -> Processed:  # noqa: A002
    """Texts (doc_id, source, text) of a format. The title is the source, but for "<string>", which is none."""
    return process_sections(FORMATS[format](docs), config, **options)


def process_files(spark: SparkSession, *paths: str, config: PipelineConfig | None = None, **options: object) -> Processed:
    """Files or folders of all supported formats. The title is the file's name without its suffix."""
    sections = files.parse_files(files.read_files(spark, *paths))
    return process_sections(sections, config, title=T.file_stem(F.col("source")), **options)


# --- reports --------------------------------------------------------------------------------------------------


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context): hits' texts in order, numbered from 1, for a prompt. hits: query_id, rank, text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    blocks = F.transform(listed, lambda h: F.concat(F.lit("["), (h["rank"] + 1).cast("string"), F.lit("] "), h["text"]))
    return hits.groupBy("query_id").agg(F.array_join(blocks, "\n\n---\n\n").alias("context"))


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from these passages alone; say so if they don't hold the answer.\n\n"), context, F.lit("\n\nQuestion: "), question)


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Over queries with a relevant chunk: their number, Hit@3, Hit@5 and the mean reciprocal rank."""
    best = relevant.join(hits.select("query_id", "chunk_key", "rank"), ["query_id", "chunk_key"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    within = lambda k: F.round(F.avg(F.when(F.col("best") < k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}")
    return best.agg(F.count("*").alias("n_queries"), within(3), within(5), F.round(F.avg(F.coalesce(1.0 / (F.col("best") + 1), F.lit(0.0))), 6).alias("mrr"))
