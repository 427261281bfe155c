"""Table functions in SQL."""

import pytest

from quirelight.functions import markup, tables


def test_segments_in_sql(spark):
    tables.register(spark)
    page = "<html><head><title>T</title></head><body><p>One &amp; <b>two</b></p>bare<script>x</script></body></html>"
    spark.createDataFrame([(1, page), (2, None), (3, "<p>open"), (4, "")], "id long, html string").createOrReplaceTempView("pages_given")
    got = spark.sql("SELECT id, s.* FROM pages_given, LATERAL segments(encode(html, 'utf-8'), 'html') AS s ORDER BY id, seg").collect()
    want = [(1, k, s.kind, s.elem, s.start, s.end, s.source, s.is_title) for k, s in enumerate(markup.extract(page.encode(), "html"))]
    assert [tuple(r) for r in got if r.id == 1] == want and len(want) >= 3
    strict = spark.sql("SELECT id, count(*) n FROM pages_given, LATERAL segments(html) GROUP BY id").collect()
    assert {r.id for r in strict} == {1}  # a document that is refused has none
    for wrong in ("segments(1)", "segments('x', 'wild')", "batches(TABLE(SELECT 1), 10, 2)"):
        with pytest.raises(Exception, match="takes|mode is"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_batches_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([("a", k, "x" * n) for k, n in enumerate((5, 5, 11, 1, 1, 1))] + [("b", 0, None), (None, 3, "é")], "d string, k int, s string").createOrReplaceTempView("lines_given")
    got = spark.sql("SELECT * FROM batches(TABLE(SELECT d, k, s FROM lines_given DISTRIBUTE BY k), 10, 2) ORDER BY d NULLS FIRST, chunk").collect()
    assert [tuple(r) for r in got] == [(None, 0, 1, 0, 1, 2), ("a", 0, 4, 0, 2, 10), ("a", 1, 4, 2, 3, 11), ("a", 2, 4, 3, 5, 2), ("a", 3, 4, 5, 6, 1), ("b", 0, 1, 0, 1, 0)]
