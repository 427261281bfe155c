import io
import zipfile

import pytest

from quirelight.operators.selection import parse_ranges
from quirelight.sources import epub as E


def book():
    return E.encode([
        ("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'),
        ("O/p.opf", b'<package><metadata/><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
         b'<item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.css" media-type="text/css"/></manifest>'
         b'<spine><itemref idref="a"/><itemref idref="c"/><itemref idref="s"/><itemref idref="gone"/></spine></package>'),
        ("O/nav.xhtml", b'<nav><a href="a%20b.xhtml#x">First</a><a href="a%20b.xhtml">Again</a></nav>'),
        ("O/a b.xhtml", b"<html><body><h1>One</h1><p>words</p></body></html>"),
        ("O/c.xhtml", b"<html><body><p>no heading</p></body></html>"),
        ("O/s.css", b"p {}"),
    ])


def test_round_trip_and_structure():
    raw = book()
    files = E.unzip(raw)
    assert files[0][0] == "mimetype" and files[0][2] == zipfile.ZIP_STORED
    again = E.unzip(E.encode([(n, d) for n, d, _ in files]))
    assert [(n, d) for n, d, _ in again] == [(n, d) for n, d, _ in files]
    assert E.structure({n: d for n, d, _ in files})[1] == [("O/a b.xhtml", "First"), ("O/c.xhtml", "Section 2")]


def test_limits():
    with pytest.raises(E.BookError):
        E.unzip(b"no zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", b"\0" * 100_000)
    with pytest.raises(E.BookError):
        E.unzip(buffer.getvalue(), most=1000)


def test_tables(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"junk")
    found = E.books(spark, str(tmp_path))
    entries = E.entries(found).toPandas()
    assert len(entries) == 8 and entries["error"].notna().sum() == 1
    assert [(r.k, r.title) for r in E.chapters(found).orderBy("k").collect()] == [(0, "First"), (1, "Section 2")]
    back = E.rebuilt(E.entries(found)).collect()
    assert len(back) == 1 and E.unzip(bytes(back[0].content))[0][0] == "mimetype"


@pytest.mark.parametrize("spec,want", [("1-3,7", [1, 2, 3, 7]), ("9-", [9, 10]), (" 2 , 2 ", [2]), ("", None), ("  ", None), ("1-1", [1])])
def test_ranges(spec, want):
    assert parse_ranges(spec, 10) == want


@pytest.mark.parametrize("spec", ["0", "11", "3-1", "a", "-3", ",", "1,,2", "1-11", "1.5", "2-x"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        parse_ranges(spec, 10)


def plain(title, chapters):
    """The reference's rule, one book after another."""
    out = title and title + "\n" + "=" * len(title)
    for own, label, body in chapters:
        body = (body or "").strip()
        if not body:
            continue
        out += "\n\n" if out else ""
        name = (own or "").strip() or (label or "").strip()
        out += f"{name}\n{'-' * len(name)}\n\n" if name and not body.startswith(name) else ""
        out += body
    return out and out + "\n"


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_book_text(spark, span):
    few = [("One", "First", "words é😀"), ("", "Label", " \u00a0body\n"), (None, None, "bare"), ("Two", "x", "Two begins"), ("T", "t", "  "), ("T", "t", None), ("é😀", "", "x")]
    want = {"a": ("A tale é", few * 3), "b": ("", few[::-1]), "c": ("", [("T", "t", "")]), "d": ("Alone", []), "e": ("", few[4:])}
    rows = [(b, k, *c) for b, (_, cs) in want.items() for k, c in enumerate(cs)]
    chapters = spark.createDataFrame(rows, "book_id string, k int, title string, label string, body string").repartition(3)
    titles = spark.createDataFrame([(b, t or None) for b, (t, _) in want.items()], "book_id string, title string")
    got = dict.fromkeys(want, "")
    for r in E.book_text(chapters, titles, span).orderBy("book_id", "k").collect():
        assert r.at == len(got[r.book_id])
        got[r.book_id] += r.piece
    assert got == {b: plain(*w) for b, w in want.items()}


def test_last_entry_counts(spark):
    """Of files with one name the last is read, and is the one that is written."""
    import warnings

    buffer = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(buffer, "w") as z:
        warnings.simplefilter("ignore")
        for name, data in [("a/", b""), ("x", b"old"), ("mimetype", b"m"), ("x", b"new")]:
            z.writestr(name, data)
    files = E.unzip(buffer.getvalue())
    assert [(n, d) for n, d, _ in files] == [("x", b"old"), ("mimetype", b"m"), ("x", b"new")] and dict((n, d) for n, d, _ in files)["x"] == b"new"
    assert [(n, d) for n, d, _ in E.unzip(E.encode([(n, d) for n, d, _ in files]))] == [("mimetype", b"m"), ("x", b"new")]


def test_save_and_packages(spark, tmp_path):
    found = spark.createDataFrame([("b0", book()), ("b1", b"junk"), ("b2", None)], "book_id string, content binary")
    rows = {r.book_id: r for r in E.packages(found).collect()}
    assert (rows["b0"].package, rows["b0"].chapters, rows["b0"].error) == ("O/p.opf", 2, None) and rows["b1"].error and rows["b2"].error
    assert [(r.k, r.path, r.navigation) for r in E.documents(found).orderBy("k").collect()] == [(0, "O/a b.xhtml", False), (1, "O/c.xhtml", False), (2, "O/nav.xhtml", True)]
    named = found.selectExpr("book_id", "book_id as name", "content")
    saved = {r.book_id: r.path for r in E.save(named, str(tmp_path)).collect()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b0.epub", "b1.epub"] and (tmp_path / "b0.epub").read_bytes() == book() and set(saved) == {"b0", "b1"}


def test_reading_order(spark):
    refs = spark.createDataFrame([("b", 2, "a"), ("b", 1, "c"), ("b", 3, "s"), ("b", 4, "gone"), ("b", 5, "d")], "book string, ordinal int, idref string")
    items = spark.createDataFrame([("b", 1, "a", "old", "text/html"), ("b", 2, "a", "a.x", "text/html"), ("b", 3, "c", "c.x", "application/xhtml+xml"), ("b", 4, "s", "s.css", "text/css"), ("b", 5, "d", "nofile", "text/html")], "book string, ordinal int, item_id string, path string, media_type string")
    files = spark.createDataFrame([("b", p) for p in ("old", "a.x", "a.x", "c.x", "s.css")], "book string, path string")
    assert [(r.path, r.k) for r in E.reading_order(refs, items, files).orderBy("k").collect()] == [("c.x", 0), ("a.x", 1)]
