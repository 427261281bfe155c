"""Containers as a data source: read by seek, written with a commit protocol."""

import io
import os
import pickle
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelight.sources import containers as D
from quirelight.sources import epub as E

PACKAGE = b'<package version="3.0"><metadata><title>A tale</title><language>en</language></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>'


def container(extra=()):
    return E.encode([
        ("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'), ("O/p.opf", PACKAGE), ("O/nav.xhtml", b'<nav><a href="c.xhtml">One</a></nav>'),
        ("O/c.xhtml", b"<html><body><p>text</p></body></html>"), *extra,
    ])


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_scans_read_what_they_need():
    """A container of 30 MB: its package costs kilobytes, a list of its files no more than the directory."""
    raw = container([(f"O/i{k}.png", os.urandom(1 << 20)) for k in range(30)])
    assert len(raw) > 30 << 20
    file = Counted(raw)
    assert E.package(E.Files(file)).chapters == [("O/c.xhtml", "One")] and file.taken < 64 << 10
    file = Counted(raw)
    assert len(list(D.entries(file, None, False))) == 35 and file.taken < 64 << 10
    file = Counted(raw)
    (found,) = D.entries(file, frozenset(["O/i7.png"]), True)
    assert len(found[3]) == 1 << 20 and file.taken < (1 << 20) + (64 << 10)


def test_refusals():
    with pytest.raises(E.BookError, match="more than"):
        E.Files(container([("O/big", b"x" * 5000)]), most=4000)
    with pytest.raises(E.BookError, match="zip"):
        E.Files(b"junk")
    raw = bytearray(container())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        at = z.getinfo("O/c.xhtml").header_offset + 45
    raw[at] ^= 0xFF
    files = E.Files(bytes(raw))
    assert E.package(files).title == "A tale"  # only the file that is broken is refused
    with pytest.raises(E.BookError, match="c.xhtml"):
        files["O/c.xhtml"]


def test_tables(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in" / f"d{k}").mkdir(parents=True)
        (tmp_path / "in" / f"d{k}" / "b.epub").write_bytes(container() if k < 2 else b"junk")
    (tmp_path / "in" / "x.txt").write_text("no container")
    path = str(tmp_path / "in")
    packages = D.read(spark, path, "packages").orderBy("book_id").collect()
    assert [(r.title, r.chapters, r.error) for r in packages] == [("A tale", 1, None)] * 2 + [(None, 0, "not a zip container")]
    assert packages[0].book_id.endswith("/d0/b.epub")
    docs = D.read(spark, path, "documents").orderBy("book_id", "k").collect()
    assert [(r.path, r.title, r.navigation) for r in docs] == [("O/c.xhtml", "One", False), ("O/nav.xhtml", E.NAVIGATION, True)] * 2 and bytes(docs[0].data).startswith(b"<html>")
    every = D.read(spark, path)
    assert every.count() == 11 and every.where("error is not null").count() == 1
    some = every.where(F.col("name").isin("O/c.xhtml", "none") & (F.col("book_id") == packages[1].book_id))
    assert [(r.book_id, r.name, bytes(r.data)) for r in some.collect()] == [(packages[1].book_id, "O/c.xhtml", b"<html><body><p>text</p></body></html>")]
    sizes = D.read(spark, path, columns="name string, size long").where("name = 'O/c.xhtml'").collect()
    assert [tuple(r) for r in sizes] == [("O/c.xhtml", 37)] * 2


def test_pushed_conditions():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = D.Reader(type("S", (), {"names": ["name", "data"]}), {"path": "x"})
    left = list(reader.pushFilters([EqualTo(("name",), "a"), In(("name",), ("a", "b")), GreaterThan(("size",), 3)]))
    assert reader.wanted == frozenset("a") and left == [GreaterThan(("size",), 3)]


def test_writes_are_committed_or_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"b{k}", f"content {k}".encode()) for k in range(6)] + [("none", None)], "name string, content binary").repartition(3)
    D.save(rows, out)
    assert sorted(os.listdir(out)) == [f"b{k}.epub" for k in range(6)] and open(f"{out}/b3.epub").read() == "content 3"
    D.save(rows.where("name = 'b3'").withColumn("content", F.lit(b"again")), out)  # nothing is overwritten
    assert open(f"{out}/b3.epub").read() == "content 3" and open(f"{out}/b3.2.epub").read() == "again"

    @F.udf("binary")
    def fails(name):
        if name == "b5":
            raise ValueError("no content")
        return b"x"

    spark.sparkContext.setLogLevel("OFF")
    with pytest.raises(Exception, match="no content"):
        D.save(rows.withColumn("content", fails("name")), out)
    spark.sparkContext.setLogLevel("ERROR")
    assert sorted(os.listdir(out)) == sorted([f"b{k}.epub" for k in range(6)] + ["b3.2.epub"])  # what the other tasks wrote is gone
    with pytest.raises(Exception, match="overwritten"):
        rows.write.format("containers").mode("overwrite").save(out)
    back = D.read(spark, f"file://{out}", "packages")
    assert back.count() == 7 and back.where("error is null").count() == 0


def test_the_driver_holds_no_list_of_files(tmp_path):
    """What tasks report to the driver does not grow with their files, and the parts of a scan hold a few bytes a file."""
    out = str(tmp_path / "a folder whose name is by far longer than what a part may hold for each of its files" / "out")
    schema = type("S", (), {"names": ["name", "content"]})
    writer = D.Writer(schema, {"path": out})
    said = [writer.write(iter([(f"b{t}-{k}\n.epub" if k == 5 else f"b{t}-{k}.epub", b"%d" % k) for k in range(1500)] + [("same.epub", b"%d" % t)])) for t in range(2)]
    assert len(pickle.dumps(said)) < 1000 and len(pickle.dumps(writer.write(iter([("none", None)])))) < 1000
    reader = D.Reader(schema, {"path": out})
    writer.commit([*said, None])
    assert len(os.listdir(out)) == 3002 and open(f"{out}/b1-7.epub").read() == "7" and open(f"{out}/b1-5\n.epub").read() == "5"
    assert [open(f"{out}/same{n}.epub").read() for n in ("", ".2")] == ["0", "1"]
    parts = reader.partitions()
    assert len(pickle.dumps(parts)) < 10 * 3002 and [len(p.paths) for p in parts] == [1000, 1000, 1000, 2]
    assert sorted(p for part in parts for p in part.paths) == sorted(os.path.join(out, f) for f in os.listdir(out))
