"""A training-data pipeline over documents: filter, deduplicate, pseudonymise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars; other columns are left out,
whatever their names. An empty table gives an empty one in every stage. What each stage makes of nulls, blanks, ties and
repeated rows is said with it; texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm import common, mixing, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of repetition coverage.

    Null and blank texts are rejected. Rows without an id and repeated rows are judged each by itself.
    """
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    The least doc_id stays. Rows that repeat an id stay or go together; rows without an id, and null or blank texts, stay.
    """
    return simhash.deduplicate(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms under the session's key.

    Every row stays; null texts stay null; repeated rows stay equal; n_chars follows the text where it was changed.
    """
    return pii.pseudonymise_documents(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' budgets take them, a row a copy.

    A null source is one of its own, a null text has no tokens, a row without an id is told by its text; rows that repeat
    id, source and text are taken together. Ties in key go by id, then text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix_documents(docs, mixing.label_weights(labels))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their places in training sequences.

    Null and blank texts have no piece; rows without an id are packed under a null id; rows that repeat an id are told apart
    by copy. Ties in length go by id, then copy.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the fingerprints' tiles, the Feistel network or the local search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents of sf_dir, each written to the shared folder and read again."""
    saved = common.Saved(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            saved.drop(f"stage-{k - 1}")
    return docs
