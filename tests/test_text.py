"""Text functions as Columns against plain code, and the two forms of one operator against each other."""

import re

import pytest
from pyspark.sql import functions as F

from quirelight.functions import markup as M
from quirelight.functions import messages
from quirelight.functions import text as X
from quirelight.operators import views as W
from quirelight.operators.prompt import byte_excerpt, continuity


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r.y for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_references(spark):
    """Numbers at every edge of what XML allows, in both writings."""
    edges = [0, 8, 9, 10, 11, 13, 14, 31, 32, 99, 100, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0xFFFFF, 0x100000, 0x10FFFF, 0x110000, 9999999, 55290, 57343, 57344, 65529, 65530, 65533, 65534, 65536, 65599, 65600, 66000, 1099999, 1109999, 1113999, 1114099, 1114111, 1114112]
    texts = [f"a&{form};" for n in edges for form in (f"#{n}", f"#x{n:x}", f"#X{n:X}", f"#000{n}", f"#x00{n:x}")] + ["&amp;", "& ", "&&amp", "&#;", "&#x;", "&nope;", "&a b;", "&#12a;"]
    assert column(spark, texts, X.repair_ampersands) == [M.repair_ampersands(t) for t in texts]


def test_strip_tags(spark):
    texts = ["a <b>c</b>", "a <b <c> d> e", "a > b", "<a", "a < b > c", "<<x>>y", "", "x <<<", "a>>b<c>d", "p <i>q <j <k>>> r"]

    def plain(text):
        out, depth = "", 0
        for c in text:
            depth += (c == "<") - (c == ">" and depth > 0)
            out += c if depth == 0 and c != ">" else ""
        return " ".join(out.split())

    assert column(spark, texts, X.strip_tags) == [plain(t) for t in texts] == [X.plain_strip(t) for t in texts]


def test_letters_and_blank(spark):
    texts = ["a", "1", "<a>", "<a>b", "&amp;", "& a; b", "é", "", "   ", "x <1", "&#65;"]
    assert column(spark, texts, X.has_letter) == [M.has_letter(t) for t in texts]
    assert column(spark, texts, X.blank) == [not t.strip() for t in texts]


def test_excerpts(spark):
    texts = ["a  b\nc", "é" * 150, "x" * 200, "x" * 201, "😀" * 70, "a" + "😀" * 70, "", "aé" * 101]
    assert column(spark, texts, lambda c: X.byte_excerpt(c, 200)) == [byte_excerpt(t, 200) for t in texts]
    assert continuity(0) == -1 and continuity(400) == 400


def test_attributes(spark):
    assert column(spark, ['a "b" <c> & d'], X.xml_attribute) == ["a &quot;b&quot; &lt;c> &amp; d"]


def test_windows(spark):
    for total in (0, 1, 5, 30):
        for budget in (-1, 1, 3, 8, 40):
            rows = spark.range(total + 2).withColumn("c", F.col("id").cast("int"))
            start, end = W.scroll_window(F.col("c"), F.lit(total), F.lit(budget))
            for r in rows.select("c", start.alias("a"), end.alias("b"), W.clamp_index(F.col("c"), F.lit(total)).alias("i")).collect():
                n = max(1, budget - 2 if total > budget else budget)
                a = max(0, min(r.c - n // 2, max(0, total - n)))
                assert (r.a, r.b, r.i) == (a, min(total, a + n), min(max(r.c, 0), max(total - 1, 0)))


def test_durations(spark):
    assert column(spark, ["0", "59.6", "61", "3600", "7325.4"], lambda c: W.duration(c.cast("double"))) == ["0s", "1m0s", "1m1s", "1h0m0s", "2h2m5s"]


def test_messages(spark):
    assert messages.message("run.more", "fr", 3) == "et 3 de plus" and messages.message("run.more", "xx", 3) == "and 3 more" and messages.message("no key", "fr") == "no key"
    table = messages.table(spark)
    assert messages.unmatched(table, "en", "fr").count() == 0  # both languages say everything
    keys = spark.createDataFrame([("fr", "run.more"), ("xx", "run.more"), ("fr", "plain text")], "locale string, key string")
    assert sorted(r.text for r in messages.looked_up(keys, table).collect()) == ["and %s more", "et %s de plus", "plain text"]
    counts = lambda t: len(re.findall("%s", t))
    assert all(counts(t) == counts(messages.MESSAGES["fr"][k]) for k, t in messages.MESSAGES["en"].items())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100])
def test_bisect_goes_to_the_bottom(spark, n):
    """A bad segment is found whatever the size of its batch, and no range is asked beside it."""
    from quirelight.operators.segments import bisect_plan

    bad = n - 1
    chunks = spark.createDataFrame([(1, 0, 0, n), (2, 0, 0, n)], "doc_id long, chunk int, lo int, hi int")
    got = sorted((r.depth, r.lo, r.hi, r.ok) for r in bisect_plan(chunks, F.expr(f"doc_id = 1 and r.lo <= {bad} and {bad} < r.hi")).collect() if r.doc_id == 1)

    def ask(lo, hi, depth=0):
        here = lo <= bad < hi
        out = [(depth, lo, hi, not here)]
        if here and hi - lo > 1:
            mid = lo + (hi - lo) // 2
            out += ask(lo, mid, depth + 1) + ask(mid, hi, depth + 1)
        return out

    assert got == sorted(ask(0, n))
