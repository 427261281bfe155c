"""Queries of this subpackage, thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann as op9
from . import chat_format as op2
from . import collocations as op11
from . import decontaminate as op5
from . import filter_audit as op12
from . import hnsw as op13
from . import html_extract as op10
from . import language_id as op8
from . import license_scan as op1
from . import minhash as op4
from . import oracles
from . import piece_codec as op6
from . import quality as op3
from . import suffix_dedup as op7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.digest(op1.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.near_duplicates(_table(spark, sf_dir, "documents"))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.digest(_table(spark, sf_dir, "documents"))


def language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.digest(_table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.digest(_table(spark, sf_dir, "pages"))


def chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.digest(_table(spark, sf_dir, "conversations"))


def quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.digest(_table(spark, sf_dir, "documents"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.nearest(_table(spark, sf_dir, "embeddings"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.digest(op5.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).drop("text"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.digest(_table(spark, sf_dir, "documents"))


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan,
    "op2_chat_perspectives": chat_perspectives,
    "op3_quality_co_training": quality_co_training,
    "op4_minhash_near_dedup": minhash_near_dedup,
    "op5_benchmark_decontamination": benchmark_decontamination,
    "op6_sentencepiece_codec": sentencepiece_codec,
    "op7_suffix_array_dedup": suffix_array_dedup,
    "op8_language_id": language_identification,
    "op9_nearest_neighbours": nearest_neighbours,
    "op10_html_extraction": html_extraction,
    "op11_phrase_collocations": phrase_collocations,
    "op12_filter_audit": filter_interactions,
    "op13_hnsw_near_dedup": hnsw_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_perspectives": op2.ORACLE,
    "op4_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op5_benchmark_decontamination": oracles.DECONTAMINATION,
    "op7_suffix_array_dedup": oracles.REPEATED_BYTES,
    "op11_phrase_collocations": op11.ORACLE,
    "op12_filter_audit": op12.ORACLE,
    "op13_hnsw_near_dedup": oracles.NEAR_VECTORS,
}
