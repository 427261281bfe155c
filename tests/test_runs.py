import pytest

from quirelight.operators import translate as T
from quirelight.operators.provider import Aborted, Limiter, ProviderError, Runner, capitals
from quirelight.streaming.resume import plan_stream


def runner(provider, **more):
    return Runner(provider, sleep=lambda s: None, limiter=Limiter(), **{"base_wait": 0.01} | more)


def test_capitals():
    r = runner(capitals)
    assert r.answers(["ab", "ß é"]) == ["AB", "ß é"] and (r.calls, r.usable) == (1, 1)


def test_splits_what_it_cannot_use():
    r = runner(lambda s: capitals(s)[:-1] if len(s) > 1 else capitals(s))
    assert r.answers(list("abcde")) == list("ABCDE") and r.streak == 0


def test_retries_then_gives_up_then_guards():
    def down(_):
        raise ProviderError("down", 503)

    r = runner(down, attempts=2, failure_limit=3)
    assert r.answers(["a"]) == [None] and r.calls == 2
    assert r.answers(["a"]) == [None]
    with pytest.raises(Aborted):
        r.answers(["a"])


def test_fatal_is_one_call():
    def refused(_):
        raise ProviderError("key", 401)

    r = runner(refused)
    with pytest.raises(Aborted):
        r.answers(["a"])
    assert r.calls == 1


def test_limiter_banks_nothing():
    now, slept = [0.0], []
    limit = Limiter(2.0, now=lambda: now[0], sleep=slept.append)
    assert [limit.wait(), limit.wait()] == [0.0, 2.0]
    now[0] = 100.0
    assert [limit.wait(), limit.wait()] == [100.0, 102.0] and slept == [2.0, 2.0]


def _docs(spark):
    return spark.createDataFrame([(1, "one line\nsecond line\nBAD third"), (2, "BAD only"), (3, "1234\n\n"), (4, None)], "doc_id long, text string")


def test_run_salvage_and_resume(spark, tmp_path):
    def _blank_on_bad():  # local, so that it travels to the workers by value
        return lambda sources: ["" if "BAD" in s else a for s, a in zip(sources, capitals(sources), strict=True)]

    docs = _docs(spark)
    out = {r.doc_id: r for r in T.translate(docs, _blank_on_bad, str(tmp_path / "a"), options=T.Options(budget=20, most=2)).collect()}
    assert set(out) == {1, 2}
    assert out[1].text == "ONE LINE\nSECOND LINE\nBAD third" and list(out[1].pending) == [2] and out[1].status == "done"
    assert out[2].status == "failed" and out[2].text == "BAD only"
    second = {r.doc_id: r for r in T.translate(docs, _blank_on_bad, str(tmp_path / "b"), salvage=lambda: capitals).collect()}
    assert second[1].text.endswith("BAD THIRD") and list(second[1].pending) == []
    cache = spark.read.parquet(str(tmp_path / "a" / "verdicts"))
    third = {r.doc_id: r for r in T.translate(docs, lambda: capitals, str(tmp_path / "c"), cache=cache).collect()}
    assert third[1].text == "ONE LINE\nSECOND LINE\nBAD THIRD" and third[2].text == "BAD ONLY"
    asked = spark.read.parquet(str(tmp_path / "c" / "attempts")).collect()
    assert sum(len(r.answers) for r in asked) == 2  # the pending segments only


def test_recipe_depends_on_every_setting(spark):
    docs = _docs(spark)
    base = {"provider": "x", "model": "m", "titles": True}
    key = lambda **s: T.recipe(docs, **s).orderBy("doc_id").first().recipe
    keys = {key(**base), key(**base | {"provider": "y"}), key(**base | {"model": "n"}), key(**base | {"titles": False})}
    assert len(keys) == 4 and key(**base) in keys


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in (1, 2):
        spark.createDataFrame([(k, "some words\nmore words")], "doc_id long, text string").write.mode("append").parquet(source)
        plan_stream(spark, source, sink, mark).awaitTermination()
        assert spark.read.parquet(sink).count() == k
