"""Edges between chunks: sequence, common section, common entity. Edges are rows, each way one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T

EDGE = ("src_id", "dst_id", "relation", "weight", "ord")


def link_sequence(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """chunks with prev_id and next_id."""
    w = Window.partitionBy(doc).orderBy(order)
    return chunks.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))


def sequence_edges(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """FOLLOWS to the chunk before, PRECEDES to the one after."""
    linked = link_sequence(chunks, doc, order)
    pairs = F.array(F.struct(F.col("prev_id").alias("dst"), F.lit("follows").alias("relation"), F.lit(0).alias("k")), F.struct(F.col("next_id").alias("dst"), F.lit("precedes").alias("relation"), F.lit(1).alias("k")))
    rows = linked.select("chunk_id", F.explode(pairs).alias("e")).where("e.dst is not null")
    return rows.select(F.col("chunk_id").alias("src_id"), F.col("e.dst").alias("dst_id"), F.col("e.relation").alias("relation"), F.lit(1.0).alias("weight"), F.col("e.k").cast("long").alias("ord"))


def section_edges(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", max_section: int | None = None) -> DataFrame:
    """SAME_SECTION between all chunks of a document's section. Their number is the square of the section's chunks;
    sections of more than max_section chunks are left out where that is given."""
    own = chunks.where("section_id is not null").select(doc, "section_id", "chunk_id", order)
    if max_section is not None:
        small = own.groupBy(doc, "section_id").count().where(F.col("count") <= max_section).select(doc, "section_id")
        own = own.join(small, [doc, "section_id"])
    other = own.select(doc, "section_id", F.col("chunk_id").alias("dst_id"), F.col(order).cast("long").alias("ord"))
    rows = own.join(other, [doc, "section_id"]).where("chunk_id <> dst_id")
    return rows.select(F.col("chunk_id").alias("src_id"), "dst_id", F.lit("same_section").alias("relation"), F.lit(1.0).alias("weight"), "ord")


def entity_edges(chunks: DataFrame, scope: tuple[str, ...] = ("doc_id",), order: str = "chunk_index") -> DataFrame:
    """SHARED_ENTITY, weight 0.8, once for each pair of chunks of a scope that name an entity, whatever its case."""
    named = chunks.select(*scope, "chunk_id", F.col(order).cast("long").alias("o"), F.explode(F.array_distinct(F.transform("entities", lambda e: T.strip(F.lower(e))))).alias("entity")).where("entity <> ''")
    other = named.select(*scope, "entity", F.col("chunk_id").alias("dst_id"), F.col("o").alias("ord"))
    rows = named.join(other, [*scope, "entity"]).where("chunk_id <> dst_id")
    return rows.select(F.col("chunk_id").alias("src_id"), "dst_id", F.lit("shared_entity").alias("relation"), F.lit(0.8).alias("weight"), "ord").distinct()


def edges(chunks: DataFrame, entities: bool = True, max_section: int | None = None) -> DataFrame:
    found = sequence_edges(chunks).unionByName(section_edges(chunks, max_section=max_section))
    return found.unionByName(entity_edges(chunks)) if entities else found


_RELATION_ORDER = ("follows", "precedes", "same_section", "shared_entity")


def nested(found: DataFrame) -> DataFrame:
    """(src_id, relationships): each chunk's edges as an array, by kind, then in order of the other chunk."""
    kind: Column = F.array_position(F.array(*map(F.lit, _RELATION_ORDER)), F.col("relation"))
    listed = F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "ord", "dst_id", "relation", "weight")))
    return found.groupBy("src_id").agg(F.transform(listed, lambda x: F.struct(x["dst_id"].alias("target_id"), x["relation"].alias("relation"), x["weight"].alias("weight"))).alias("relationships"))


def neighbor_summaries(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """chunks with the summaries before and after, empty where there is none."""
    w = Window.partitionBy(doc).orderBy(order)
    return chunks.withColumns({"prev_summary": F.coalesce(F.lag("summary").over(w), F.lit("")), "next_summary": F.coalesce(F.lead("summary").over(w), F.lit(""))})
