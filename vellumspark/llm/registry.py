"""Queries of the training-data operators, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_templates, langmodel, licences, mixing, neighbours, packing, pii, quality, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived as WARC records and put together again."""
    return warc.archive_report(warc.records(_table(spark, sf_dir, "pages")))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents that holds licence wording."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document under the model of all documents."""
    return langmodel.score(_table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by format-preserving pseudonyms."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into training sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages without the templates of their hosts."""
    return html_templates.extract(_table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with their copies."""
    return mixing.sample(_table(spark, sf_dir, "documents"), mixing.label_weights(_table(spark, sf_dir, "labels")))


def op10_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours, among all vectors, of every vector whose id is divisible by 20."""
    return neighbours.neighbours(_table(spark, sf_dir, "embeddings"), every=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, with what was measured."""
    return quality.measure(_table(spark, sf_dir, "documents")).where("keep").drop("keep")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_warc_archive": op1_warc_archive,
        "op2_licence_scan": op2_licence_scan,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_pii_pseudonyms": op4_pii_pseudonyms,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_html_templates": op7_html_templates,
        "op8_source_mixing": op8_source_mixing,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_approximate_neighbours": op10_approximate_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": warc.oracle(), "op8_source_mixing": mixing.oracle()}
