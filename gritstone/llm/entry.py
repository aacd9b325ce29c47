"""Queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gritstone.llm import decontaminate, graph_ann, html_extract, license_scan, mixing, parity_join, quality_crf, secrets_dfa, sharding, substring_dedup


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.digest(table(spark, sf, "documents"))


def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.digest(table(spark, sf, "documents"))


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.digest(table(spark, sf, "documents"))


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.digest(table(spark, sf, "pages"))


def op5(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ann.nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality_crf.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8(spark: SparkSession, sf: str) -> DataFrame:
    return secrets_dfa.digest(secrets_dfa.scan_secrets(table(spark, sf, "documents")))


def op9(spark: SparkSession, sf: str) -> DataFrame:
    return parity_join.link_documents(table(spark, sf, "documents"))


def op10(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {"op1_sharding": op1, "op2_mixing": op2, "op3_licenses": op3, "op4_html": op4, "op5_repeats": op5, "op6_ann": op6, "op7_quality": op7, "op8_secrets": op8, "op9_jaccard": op9, "op10_decontamination": op10, "pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE_SQL, "op5_repeats": substring_dedup.ORACLE_SQL, "op8_secrets": secrets_dfa.ORACLE_SQL, "op9_jaccard": parity_join.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
