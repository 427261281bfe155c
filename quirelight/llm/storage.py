"""Intermediate tables in the folder all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.sources.tables import scratch
from quirelight.sources.tables import spread as spread  # for the operators of this subpackage


def _path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files any executor can read.

    The table is deleted when the driver ends, or earlier by ``dropped``.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        made, store = _path(table.sparkSession, folder)
        if made.getName().startswith("quirelight-"):
            store.delete(made, True)


def buckets_for(df: DataFrame, *each: int, least: int = 16) -> list[int]:
    """Numbers of groups of about ``each`` bytes of text, as measured; they grow with the input."""
    size = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return [max(least, -(-size // n)) for n in each]


def may_contain(ids: DataFrame, column: str, *, bits: int = 1 << 26) -> Column:
    """A predicate on a long column that holds for every id of ``ids`` and for few others.

    The filter is a bitmap of at most ``bits`` bits (8 MB), however many ids there
    are; it is built with Spark's bitmap aggregate and broadcast.  A full bitmap
    lets more rows through, never fewer, so callers still join on the ids.
    """
    width = 8 * 4096
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits)) + 1
    rows = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map")).collect()
    table = np.zeros((bits // width, 4096), dtype=np.uint8)
    for r in rows:
        table[r.bucket - 1] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value.reshape(-1)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.pmod(F.xxhash64(F.col(column)), F.lit(bits)))
