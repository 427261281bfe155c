"""Incremental runs: documents that arrive in a folder are segmented once and appended to a table of batches.

An extension of the batch resume: Structured Streaming's checkpoint says which
files were taken, and ``foreachBatch`` writes each micro-batch under its own
number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirelight.operators.segments import chunk_plan

SCHEMA = "doc_id long, text string"


def plan_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Plan batches of every Parquet document file under ``source`` that was not planned before."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
