"""Structured Streaming over a folder of documents: the batch engine's own transformations, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumspark.config import PipelineConfig
from vellumspark.operators import enrich
from vellumspark.plans import pipeline

DOCUMENTS = "doc_id long, text string, source string, arrived timestamp"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fresh(docs: DataFrame, keep: str = "7 days") -> DataFrame:
    """Documents whose text wasn't seen within `keep` before: state is dropped as the watermark moves on."""
    hashed = docs.withColumn("text_hash", enrich.text_hash(F.col("text")))
    return hashed.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["text_hash"])


def write_chunks(docs: DataFrame, chunks_path: str, edges_path: str, checkpoint: str, config: PipelineConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Chunks and edges of each micro-batch, in a folder of the batch's number, so that a batch done again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        done = pipeline.process_text(batch.select("doc_id", "source", "text"), config)
        done.chunks.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        done.edges.write.mode("overwrite").parquet(f"{edges_path}/batch={number}")

    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts(docs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Documents and characters by source and window of arrival."""
    return docs.withWatermark("arrived", late).groupBy(F.window("arrived", window), "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


