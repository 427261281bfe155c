"""Two-level running states against plain loops, with runs that cross blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quirelight.operators import ordered as O


def made(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(400), i, rng.choice([True, True, True, False]), rng.choice(["x", "y", None])) for i in range(n)]
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    return rows, by_key


SCHEMA = "key string, now long, order int, failed boolean, kind string"


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_limiter(spark, span):
    rows, by_key = made(span)
    got = {r.order: r["at"] for r in O.limiter_slots(spark.createDataFrame(rows, SCHEMA), 5, "key", span=span).collect()}
    want = {}
    for own in by_key.values():
        free = None
        for _, now, order, *_ in own:
            at = now if free is None else max(now, free)
            want[order], free = at, at + 5
    assert got == want


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_failure_runs(spark, span):
    rows, by_key = made(span + 1)
    calls = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.col("order")).withColumn("order", F.struct("now", "n"))
    for limit in (0, 2, 4):
        got = {r.n for r in O.failure_runs(calls, limit, "key", block=F.floor(F.col("now") / span)).collect()}
        want = set()
        for own in by_key.values():
            streak = 0
            for _, _, order, failed, _ in own:
                streak = streak + 1 if failed else 0
                if failed and streak == limit:
                    want.add(order)
        assert got == want


@pytest.mark.parametrize("skip", [True, False])
@pytest.mark.parametrize("span", [1, 7, 1000])
def test_last_before(spark, span, skip):
    rows, by_key = made(span + 2)
    got = {r.order: r.before for r in O.last_before(spark.createDataFrame(rows, SCHEMA), F.col("kind"), ("key",), ("now", "order"), F.floor(F.col("now") / span), skip_nulls=skip).collect()}
    want = {}
    for own in by_key.values():
        before = None
        for _, _, order, _, kind in own:
            want[order] = before
            before = kind if kind is not None or not skip else before
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert O.limiter_slots(none, 5, "key").count() == 0
    assert O.failure_runs(none, 2, "key", block=F.col("now")).count() == 0
    assert O.last_before(none, F.col("kind"), ("key",), ("now",), F.col("now")).count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_numbered(spark, span):
    """Places in a key's order, whatever the blocks; a null key is a key."""
    rows = [(b, k) for b, ks in {"a": [5, 1, 9, 2, 30, 31], "b": [7], None: [2, 0]}.items() for k in ks]
    table = spark.createDataFrame(rows, "book string, k int").repartition(3)
    got = {(r.book, r.k): (r.place, r.places) for r in O.numbered(table, ("book",), ("k",), F.floor(F.col("k") / span)).collect()}
    for book in ("a", "b", None):
        own = sorted(k for b, k in rows if b == book)
        assert all(got[book, k] == (i + 1, len(own)) for i, k in enumerate(own))
