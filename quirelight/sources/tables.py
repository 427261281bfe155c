"""Tables as the engine reads them, and the folder for intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and all executors are threads of this process, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where a scan gives so few partitions that most cores would have none (a small file of one row group).

    A large table that fills half of the cores or more is left as it is: shuffling it would cost more than it gains.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or 2 * plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_FALLBACK


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quirelight-{name}-{uuid.uuid4().hex}"
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)
    return path
