"""From raw chunks to the chunks table: ordinals, ids, counts, section ids, contextual text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.tokenizers import Tokenizer


def chunk_id(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    """Deterministic, so a task that runs again gives the same ids."""
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws("\u001f", doc_id.cast("string"), chunk_index.cast("string"), text), 256), 1, 12))


def section_id(context: Column) -> Column:
    """A hash of the breadcrumb; null where that is blank."""
    bare = T.strip(context)
    return F.when(F.coalesce(bare, F.lit("")) != "", F.concat(F.lit("sec_"), F.substring(F.md5(bare), 1, 10)))


def depth(context: Column) -> Column:
    """Number of headings in the breadcrumb."""
    return F.size(F.filter(F.split(F.coalesce(context, F.lit("")), "→"), lambda p: T.strip(p) != ""))


def contextual_text(title: Column, context: Column, summary: Column, text: Column) -> Column:
    """The text under lines that say where it stands; lines without a value are left out."""
    label = F.when((F.coalesce(title, F.lit("")) != "") & (title != "<string>"), F.concat(F.lit("Document: "), title))
    section = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Section: "), context))
    about = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Summary: "), summary))
    return F.concat_ws("\n", label, section, about, text)


def embed_text(contextual: Column, text: Column) -> Column:
    return F.coalesce(T.nonempty(contextual), text)


def build_chunks(raw: DataFrame, strategy: str, tokenizer: Tokenizer | None = None, enrich: bool = False) -> DataFrame:
    """The chunks table. raw: doc_id, source, section_ord, chunk_ord, text, parent_context, page, content_type, ...

    One shuffle, by document; ordinals and totals share it.
    """
    doc = Window.partitionBy("doc_id")
    rows = raw.withColumn("chunk_index", (F.row_number().over(doc.orderBy("section_ord", "chunk_ord")) - 1).cast("int"))
    rows = rows.withColumn("total_chunks", F.count("*").over(doc).cast("int"))
    return rows.select(
        "doc_id",
        "source",
        "chunk_index",
        "total_chunks",
        chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        "text",
        "parent_context",
        section_id(F.col("parent_context")).alias("section_id"),
        depth(F.col("parent_context")).alias("depth"),
        F.length("text").alias("char_count"),
        (tokenizer or Tokenizer()).count(F.col("text")).cast("int").alias("token_count"),
        "page",
        "content_type",
        "table_data",
        "figures",
        F.lit(strategy).alias("strategy"),
        F.lit("MISS" if enrich else "DISABLED").alias("cache_status"),
        F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("entities"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(0.0).alias("confidence"),
        F.lit("").alias("prev_summary"),
        F.lit("").alias("next_summary"),
    )


def with_context(chunks: DataFrame, title: Column | None = None) -> DataFrame:
    """chunks with contextual_text; title: a document's own, else its source's stem for files and the source as it is."""
    return chunks.withColumn("contextual_text", contextual_text(F.col("source") if title is None else title, F.col("parent_context"), F.col("summary"), F.col("text")))
