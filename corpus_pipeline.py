"""Corpus pipeline: five stages, each an operator of ``quirelight.llm``.

``run`` applies them to the documents table.  A stage takes what its predecessor
kept, written as Parquet in the shared folder, and acts on it:

1. language ID: documents without a language (``und``) go, missing languages are filled in;
2. near duplicates: the document of the smallest id of each group stays;
3. repeated passages: bytes that also stand in a document of smaller id are cut out of the texts;
4. benchmark decontamination: documents with a benchmark window go;
5. SentencePiece: the texts' ids, each decoded again and compared.

Stages 1 to 4 return the columns of documents and ignore others.  Clean documents
stay.

Defined results: null and empty texts, and texts without a letter, go in stage 1;
a text that stage 3 leaves empty stays as an empty text.  A row without an id is
judged by its language and benchmark windows only, and never makes another row go.
Rows of one id and text become one in stage 2 (with the smallest of their other
columns, nulls first); rows of one id with different texts stay or go together.
Very long texts are read whole; ties go to the smaller id; an empty table gives no
rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import decontaminate as op5
from quirelight.llm import language_id as op8
from quirelight.llm import minhash as op4
from quirelight.llm import piece_codec as op6
from quirelight.llm import suffix_dedup as op7
from quirelight.llm.storage import dropped, may_contain, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    named = op8.identify(docs, op8.train(docs))
    return named.where("lang_pred != 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    judged = op4.near_duplicates(docs)
    # only documents that go, or whose id is repeated, are matched by id; all others pass without a shuffle
    touched = written(judged.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "touched")
    asked = F.col("doc_id").isNotNull() & may_contain(touched, "doc_id")
    passed = docs.where(~asked)
    single = docs.where(asked).groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return passed.unionByName(single.join(touched.where("not kept"), "doc_id", "left_anti").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7.suffix_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5.clean(op5.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6.encode(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language_id", languages),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece_codec", encoded),
]

#: No SQL expresses the trained classifier or the piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
