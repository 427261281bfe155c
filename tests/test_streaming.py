"""Keyed state of streams."""

import pytest
from pyspark.sql import functions as F

from quirelight.operators import ordered as O
from quirelight.streaming import limiter as L

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_slots_of_a_stream(spark, tmp_path):
    """Three batches with a restart between them: the slots are those of one schedule, failures run on, one key over all."""
    calls = spark.createDataFrame([("a" if i % 3 else "b", i, 1_000_000 * (i // 4) + i * 1000, i % 5 != 0) for i in range(60)], "service string, order long, now long, failed boolean")
    want = {(r.service, r.order): r["at"] for r in O.limiter_slots(calls, 700_000, "service").collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for k in range(3):
            calls.where((F.col("order") >= 20 * k) & (F.col("order") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = L.slots(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), 700_000, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            stream.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.service, r.order): r["at"] for r in got} == want and len(got) == 60
    streak, failed = {"a": 0, "b": 0}, {r.order: r.failed for r in calls.collect()}
    for r in sorted(got, key=lambda r: r.order):
        streak[r.service] = streak[r.service] + 1 if failed[r.order] else 0
        assert r.streak == streak[r.service] and r.tripped == (r.streak >= 3)
    assert any(r.tripped for r in got) and max(r.streak for r in got) > 3


def test_slots_need_an_order():
    with pytest.raises(TypeError):
        L.Slots()
