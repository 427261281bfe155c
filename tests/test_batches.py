"""Few rows are Python values at a time, however many Spark hands over at once."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.functions import markup as M
from quirelight.operators import books as B
from quirelight.operators import segments as G
from quirelight.operators import translate as T
from quirelight.operators.log import Log
from quirelight.operators.provider import capitals
from quirelight.sources import epub as E


@pytest.fixture
def workers(spark, monkeypatch):
    """The functions that are given to ``mapInArrow``, by the order of the calls."""
    taken, kind = [], type(spark.range(0))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: (taken.append(run), own(self, run, schema))[1])
    return taken


def first(run, rows, *columns):
    """The first batch that leaves a worker which is given all rows at once, and how many rows it had."""
    return next(run(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list(columns))])))


def test_containers_leave_a_few_at_a_time(spark, workers):
    frame = spark.createDataFrame([], "book_id string, title string, language string, chapters array<struct<name:string,title:string,data:string>>")
    E.documents(E.bound(frame))
    bind, read = workers
    body = "".join(chr(97 + (i * i * 7919 + i // 3) % 26) for i in range(200_000))
    out = first(bind, [(str(i), "t", "en", [{"name": "c.xhtml", "title": "c", "data": body}]) for i in range(200)], "book_id", "title", "language", "chapters")
    assert out.nbytes < 4 << 20
    content = out.column(1)[0].as_py()
    out = first(read, [(str(i), content) for i in range(2000)], "book_id", "content")
    assert 2 <= out.num_rows < 20 and out.column("data")[0].as_py() == body.encode()


def test_segments_leave_a_few_at_a_time(spark, workers):
    M.page_segments(spark.createDataFrame([], "page_id long, html string"))
    B.segments(spark.createDataFrame([], "book_id string, path string, data binary"))
    page = b"".join(b"<p>some words of paragraph %d</p>" % i for i in range(500))
    assert first(workers[0], [(i, page) for i in range(2000)], "page_id", "html").num_rows < 10_000
    assert first(workers[1], [(page, f"b{i}!/p", f"b{i}", "p") for i in range(2000)], "data", "doc_id", "book_id", "path").num_rows < 10_000


def test_refused_and_empty_documents_stay_one_row(spark):
    docs = spark.createDataFrame([("b", "x", b"<p>a</b></p>"), ("b", "y", b"<p>1</p>"), ("b", "z", None), ("b", "w", b"<p>word</p>")], "book_id string, path string, data binary")
    rows = {r.path: r for r in B.segments(docs).collect()}
    assert len(rows) == 4 and rows["x"].error and rows["x"].seg is None and (rows["y"].error, rows["y"].seg, rows["z"].seg) == (None, None, None) and (rows["w"].seg, rows["w"].source, rows["w"].block) == (0, "word", True)


def test_waves_do_not_grow_in_number_with_the_run(spark, tmp_path, monkeypatch):
    """Batches that are answered at once go in few waves; slow ones in waves that are no larger than they have to be."""
    made = []
    own = Log.add
    monkeypatch.setattr(Log, "add", lambda self, rows: (made.append(1), own(self, rows))[1])
    docs = spark.createDataFrame([(i, f"Paragraph {i}") for i in range(400)], "doc_id long, text string")
    out = T.run(G.line_segments(docs), lambda: capitals, str(tmp_path / "r"), options=T.Options(wave=2))  # 50 parts
    assert out.where("verdict = 'ok' and answer = upper(source)").count() == 400 and len(made) <= 8
    assert T.larger(4, 1.0) == 16 and T.larger(4, 30.0) == 8 and T.larger(4, 600.0) == 1


def test_a_fresh_start_moves_no_replies(spark, tmp_path):
    """Only replies of several starts have to meet; those of one are read as they were written, without their sources."""
    schema = T._log_schema("long")
    fresh = Log(spark, str(tmp_path / "log"), "o", schema)
    fresh.add(spark.createDataFrame([], schema))
    plan = fresh.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "sources" not in fresh.rows().columns
    again = Log(spark, str(tmp_path / "log"), "o", schema)
    assert again.before and "Exchange" in again.rows()._jdf.queryExecution().executedPlan().toString()


def test_waves_start_at_the_lowest_share_that_is_open(spark, tmp_path, monkeypatch):
    """Nothing stays unasked where the first share of the waves is empty: one long document, or a start after the first share is in the log."""
    long = spark.range(50).where("pmod(xxhash64(id), 10) > 0").first().id
    docs = spark.createDataFrame([(long, "\n".join(f"Line {i}" for i in range(40)))], "doc_id long, text string")
    out = T.run(G.line_segments(docs), lambda: capitals, str(tmp_path / "long"), options=T.Options(wave=1, most=1))  # 10 shares
    assert out.where("verdict = 'ok' and answer = upper(source)").count() == 40
    monkeypatch.setattr(T, "PARTS", 2)
    last, alive = spark.range(400).where("pmod(xxhash64(id), 2) = 1").orderBy(F.col("id").desc()).first().id, tmp_path / "alive"
    docs = spark.createDataFrame([(i, f"Paragraph {i}") for i in range(400)], "doc_id long, text string")

    def make(needle=f"Paragraph {last}", alive=str(alive)):
        def provider(sources):
            if needle in sources and not os.path.exists(alive):
                raise SystemExit("killed")
            return capitals(sources)

        return provider

    start = lambda: T.run(G.line_segments(docs), make, str(tmp_path / "r"), options=T.Options(wave=1))
    spark.sparkContext.setLogLevel("OFF")
    with pytest.raises(Exception):  # noqa: B017
        start()
    spark.sparkContext.setLogLevel("ERROR")
    assert 1 < T.committed(spark, str(tmp_path / "r"), T.Options(wave=1), "long").count() < 400
    alive.write_text("")
    assert start().where("verdict = 'ok' and answer = upper(source)").count() == 400
