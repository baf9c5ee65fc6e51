"""Chunks as JSON, JSON lines, dicts and vector-store records."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.rows import embed_text
from vellumspark.operators.search import batches_of

BATCH = 100


def nested(chunks: DataFrame) -> DataFrame:
    """One struct a chunk: its fields, and where it comes from under metadata. Empty fields are kept."""
    inner = [c for c in ("source", "page", "chunk_index", "total_chunks", "char_count", "token_count") if c in chunks.columns]
    outer = [c for c in chunks.columns if c not in (*inner, "doc_id")]
    return chunks.select("doc_id", "chunk_index", F.struct(*[F.col(c).alias({"chunk_id": "id", "table_data": "table"}.get(c, c)) for c in outer], F.struct(*inner).alias("metadata")).alias("chunk"))


def json_lines(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, value): each chunk as one JSON object, nulls included."""
    return nested(chunks).select("doc_id", "chunk_index", F.to_json("chunk", {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """A folder of text files, an object a line."""
    json_lines(chunks).select("value").write.mode("overwrite").text(path)


def write_json(chunks: DataFrame, path: str) -> None:
    """One pretty-printed array in one file of the driver, row by row; for results of a size to be read by people."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    rows = json_lines(chunks).orderBy("doc_id", "chunk_index").toLocalIterator()
    with target.open("w", encoding="utf-8") as f:
        f.write("[")
        k = -1
        for k, row in enumerate(rows):
            text = json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False)
            f.write(("," if k else "") + "\n  " + text.replace("\n", "\n  "))
        f.write("]" if k < 0 else "\n]")


def to_dicts(chunks: DataFrame) -> list[dict]:
    """Nested dicts, in document order; fetched a partition at a time."""
    return [r["chunk"].asDict(True) for r in nested(chunks).orderBy("doc_id", "chunk_index").toLocalIterator()]


_TEXTS = ("prev_id", "next_id", "parent_id", "section_id")


def _common(chunks: DataFrame) -> dict[str, Column]:
    have = set(chunks.columns)
    fields: dict[str, Column] = {k: F.coalesce(F.col(k), F.lit("")) if k in have else F.lit("") for k in ("summary", "parent_context", "prev_summary", "next_summary", *_TEXTS)}
    fields |= {k: F.col(k) for k in ("depth", "confidence", "source", "chunk_index", "total_chunks")}
    return fields | {"page": F.coalesce("page", F.lit(0))}


def _embedded(records: DataFrame, text: str, embed: Callable[[Column], Column] | None) -> DataFrame:
    """records with `values`, the vector of their text, where an embed function is given."""
    return records if embed is None else records.withColumn("values", embed(F.col(text)))


def vector_records(chunks: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, embed_text, metadata[, values]): lists stay lists, nothing is null. embed: a text column to a vector column."""
    fields = {"text": F.col("text"), "contextual_text": F.col("contextual_text"), "entities": F.col("entities"), "keywords": F.col("keywords")} | _common(chunks)
    found = chunks.select(F.col("chunk_id").alias("id"), embed_text(F.col("contextual_text"), F.col("text")).alias("embed_text"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("metadata"))
    return _embedded(found, "embed_text", embed)


def collection_records(chunks: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, document, metadata[, values]) of stores that take scalars only: lists are joined by a comma."""
    fields = {"raw_text": F.col("text"), "entities": F.array_join("entities", ", "), "keywords": F.array_join("keywords", ", ")} | _common(chunks)
    found = chunks.select(F.col("chunk_id").alias("id"), embed_text(F.col("contextual_text"), F.col("text")).alias("document"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("metadata"))
    return _embedded(found, "document", embed)


def upsert(records: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch: int = BATCH) -> None:
    """Send records to a store from the executors: connect() makes a partition's own client, a function of a batch.

    A task that runs again sends the same ids, so the store's upsert makes that harmless.
    """

    def send(rows) -> None:  # noqa: ANN001
        client = None
        for part in batches_of(rows, batch):
            client = client or connect()
            client([r.asDict(True) for r in part])

    records.foreachPartition(send)


def _paths(spark: SparkSession, *paths: str) -> tuple:
    jvm = spark.sparkContext._jvm
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *made


def write_cache(cache: DataFrame, path: str) -> None:
    """The enrichment cache, into a new folder that then takes the old one's place; until it has, the old one stays aside."""
    spark = cache.sparkSession
    cache.select("text_hash", "payload").write.mode("overwrite").parquet(path + ".new")
    fs, at, new, old = _paths(spark, path, path + ".new", path + ".old")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{path}.new can't take the place of {path}")
    fs.delete(old, True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, or what a broken write left aside of it, or an empty one."""
    fs, at, old = _paths(spark, path, path + ".old")
    for place, name in ((at, path), (old, path + ".old")):
        if fs.exists(place):
            return spark.read.schema("text_hash string, payload string").parquet(name)
    return spark.createDataFrame([], "text_hash string, payload string")


FORMATS = ("json", "jsonl", "dict", "vectors", "collection")


def export(chunks: DataFrame, kind: str, path: str = "", connect: Callable[[], Callable[[list[dict]], None]] | None = None, embed: Callable[[Column], Column] | None = None, batch: int = BATCH) -> list[dict] | None:
    """json, jsonl (both to path), dict, or to a store by connect (see upsert): vectors or a collection, with embed's vectors."""
    if kind == "dict":
        return to_dicts(chunks)
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {', '.join(FORMATS)}")
    if kind in ("json", "jsonl"):
        return {"json": write_json, "jsonl": write_jsonl}[kind](chunks, path)
    if connect is None:
        raise ValueError(f"{kind} needs connect")
    records = vector_records if kind == "vectors" else collection_records
    return upsert(records(chunks, embed), connect, batch)
