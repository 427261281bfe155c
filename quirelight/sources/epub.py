"""Book containers: zip entries, package structure and the way back.

``entries`` reads containers with ``binaryFile`` and opens each in an Arrow
batch; package documents are parsed where they are.  Every table carries its
ordinals, as row order means nothing in a DataFrame.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html import escape
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.functions import markup, text
from quirelight.functions.batches import ddl, mapped
from quirelight.operators import ordered as O

#: Uncompressed bytes of one container that are read at most; a larger one is refused as a whole.
MOST_BYTES = 512 << 20
ENTRIES = "book_id string, ordinal int, name string, data binary, method short, error string"
CHAPTERS = "book_id string, k int, path string, title string, n_bytes long"
_XHTML = ("application/xhtml+xml", "text/html")


class BookError(ValueError):
    """A container that can't be read."""


def unzip(raw: bytes, most: int = MOST_BYTES) -> list[tuple[str, bytes, int]]:
    """(name, bytes, method) of the files, in order."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise BookError("not a zip container") from e
    out, total = [], 0
    for info in archive.infolist():
        if info.is_dir():
            continue
        with archive.open(info) as f:
            data = f.read(most - total + 1)
        total += len(data)
        if total > most:
            raise BookError(f"more than {most} bytes")
        out.append((info.filename, data, info.compress_type))
    return out


class Files(Mapping):
    """The files of a container by name (of equal names the last), inflated as they are asked for.  ``file``: bytes, or a file that can seek."""

    def __init__(self, file, most: int = MOST_BYTES) -> None:
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(file) if isinstance(file, bytes) else file)
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise BookError("not a zip container") from e
        self.infos = [i for i in self.archive.infolist() if not i.is_dir()]
        if sum(i.file_size for i in self.infos) > most:
            raise BookError(f"more than {most} bytes")
        self.last = {i.filename: i for i in self.infos}

    def sizes(self) -> list[tuple[str, int]]:
        """(name, size) of all, in order."""
        return [(i.filename, i.file_size) for i in self.infos]

    def __getitem__(self, name: str) -> bytes:
        try:
            return self.archive.read(self.last[name])
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
            raise BookError(f"{name}: {e}") from e

    def __iter__(self) -> Iterator[str]:
        return iter(self.last)

    def __len__(self) -> int:
        return len(self.last)

    def __contains__(self, name) -> bool:
        return name in self.last


def encode(files: list[tuple[str, bytes]]) -> bytes:
    """A container: mimetype first and stored, the rest deflated; of equal names the last counts."""
    last = dict(files)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr(zipfile.ZipInfo("mimetype"), last.pop("mimetype", b"application/epub+zip"), zipfile.ZIP_STORED)
        for name, data in last.items():
            archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def resolve(base: str, href: str) -> str:
    """Path of ``href`` seen from the file ``base``, without query and fragment."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0].split("?")[0])))


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


@dataclass(frozen=True)
class Package:
    """What a container says about its book."""

    path: str
    title: str
    language: str
    version: str
    chapters: list[tuple[str, str]]  # (path, title) in reading order
    nav: str | None
    ncx: str | None

    def worklist(self) -> list[tuple[str, str, bool]]:
        """(path, title, navigation) of the documents to work on: chapters, then both tables of contents, each path once."""
        titles: dict[str, str] = {}
        for path, title in self.chapters:
            titles.setdefault(path, title)
        order = dict.fromkeys([p for p, _ in self.chapters] + [p for p in (self.nav, self.ncx) if p])
        return [(p, titles.get(p, NAVIGATION), p in (self.nav, self.ncx)) for p in order]


#: Title of a document that is no chapter.
NAVIGATION = "Navigation"


def package(files: Mapping[str, bytes]) -> Package:
    """The package document of a container: the first root file, the first title and language, items by id (of equal ones the last)."""
    try:
        roots = [n.get("full-path") for n in ElementTree.fromstring(files["META-INF/container.xml"]).iter() if _local(n) == "rootfile" and n.get("full-path")]
        root = ElementTree.fromstring(files[roots[0]])
    except (KeyError, IndexError, ElementTree.ParseError) as e:
        raise BookError(f"no package: {e}") from e
    said = {name: next((" ".join("".join(n.itertext()).split()) for n in root.iter() if _local(n) == name), "") for name in ("title", "language")}
    items = {n.get("id"): n for n in root.iter() if _local(n) == "item"}
    spine = next((n for n in root.iter() if _local(n) == "spine"), None)
    place = lambda n: resolve(roots[0], n.get("href", ""))
    ncx = [n for n in items.values() if n.get("media-type") == "application/x-dtbncx+xml"]
    if not ncx and spine is not None and spine.get("toc") in items:
        ncx = [items[spine.get("toc")]]
    nav = [n for n in items.values() if "nav" in (n.get("properties") or "").split()]
    labels: dict[str, str] = {}
    for node, find in ((ncx, _ncx_labels), (nav, _nav_labels)):
        for n in node[-1:]:
            for href, label in find(files.get(place(n), b"")):
                labels.setdefault(resolve(place(n), href), label)  # the first wins, contents before navigation
    chapters = []
    for ref in (n for n in root.iter() if _local(n) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or item.get("media-type") not in _XHTML:
            continue
        path = place(item)
        if path in files:
            chapters.append((path, labels.get(path) or markup.document_title(files[path]) or f"Section {len(chapters) + 1}"))
    held = [next((place(n) for n in node[-1:] if place(n) in files), None) for node in (nav, ncx)]
    return Package(roots[0], said["title"], said["language"], root.get("version", ""), chapters, *held)


def structure(files: Mapping[str, bytes]) -> tuple[str, list[tuple[str, str]]]:
    """(package path, [(path, title)] of the chapters in reading order)."""
    found = package(files)
    return found.path, found.chapters


def _ncx_labels(doc: bytes) -> Iterator[tuple[str, str]]:
    try:
        points = [n for n in ElementTree.fromstring(doc).iter() if _local(n) == "navPoint"]
    except ElementTree.ParseError:
        return
    for p in points:
        label = next((" ".join("".join(n.itertext()).split()) for n in p if _local(n) == "navLabel"), "")
        href = next((n.get("src", "") for n in p if _local(n) == "content"), "")
        if label and href:
            yield href, label


def _nav_labels(doc: bytes) -> Iterator[tuple[str, str]]:
    try:
        links = [n for n in ElementTree.fromstring(doc).iter() if _local(n) == "a"]
    except ElementTree.ParseError:
        return
    for n in links:
        label = " ".join("".join(n.itertext()).split())
        if label and n.get("href"):
            yield n.get("href"), label


def books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content) of the containers under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("book_id"), "content")


def entries(found: DataFrame) -> DataFrame:
    """Files of the containers; a refused container is one row with its error."""

    def rows(book: str, raw: bytes | None) -> list[tuple]:
        try:
            return [(book, k, name, data, method, None) for k, (name, data, method) in enumerate(unzip(raw or b""))]
        except BookError as e:
            return [(book, -1, None, None, None, str(e))]

    return mapped(found.select("book_id", "content"), rows, ENTRIES)


def chapters(found: DataFrame) -> DataFrame:
    """Chapters of the containers in reading order; books without a package have none."""

    def rows(book: str, raw: bytes | None) -> list[tuple]:
        try:
            files = Files(raw or b"")
            return [(book, k, path, title, len(files[path])) for k, (path, title) in enumerate(structure(files)[1])]
        except BookError:
            return []

    return mapped(found.select("book_id", "content"), rows, CHAPTERS)


def bound(books: DataFrame) -> DataFrame:
    """(book_id, content): containers made of ``books`` (book_id, title, language, chapters: array<struct<name,title,data>>), with a table of contents."""

    def rows(book, title: str | None, language: str | None, chapters: list[dict]) -> list[tuple]:
        return [(book, _bound(title or "", language or "", [(c["name"], c["title"], c["data"].encode()) for c in chapters]))]

    return mapped(books.select("book_id", "title", "language", "chapters"), rows, f"{ddl(books, 'book_id')}, content binary")


def _bound(title: str, language: str, chapters: list[tuple[str, str, bytes]]) -> bytes:
    kind = 'media-type="application/xhtml+xml"'
    items = "".join(f'<item id="c{k}" href="{quote(name)}" {kind}/>' for k, (name, _, _) in enumerate(chapters))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    links = "".join(f'<li><a href="{quote(name)}">{escape(label)}</a></li>' for name, label, _ in chapters)
    return encode([
        ("META-INF/container.xml", b'<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/package.opf", f'<package version="3.0" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" {kind} properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'.encode()),
        ("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol>{links}</ol></nav></body></html>'.encode()),
        *[(f"OEBPS/{name}", data) for name, _, data in chapters],
    ])


def packages(found: DataFrame) -> DataFrame:
    """A row a container: path of the package, title, language, version, number of chapters, or the reason of its refusal."""

    def rows(book: str, raw: bytes | None) -> list[tuple]:
        try:
            p = package(Files(raw or b""))
            return [(book, p.path, p.title, p.language, p.version, len(p.chapters), None)]
        except BookError as e:
            return [(book, None, None, None, None, 0, str(e))]

    return mapped(found.select("book_id", "content"), rows, "book_id string, package string, title string, language string, version string, chapters int, error string")


DOCUMENTS = "book_id string, book_title string, k int, path string, title string, navigation boolean, data binary"


def documents(found: DataFrame, places: bool = False) -> DataFrame:
    """The documents of each book to work on, numbered in that order; refused containers have none.  ``places``: with place (from 1) and places beside."""

    def rows(book: str, raw: bytes | None) -> list[tuple]:
        try:
            files = Files(raw or b"")
            p = package(files)
            own = p.worklist()
            return [(book, p.title, k, path, title, navigation, files[path], *((k + 1, len(own)) if places else ())) for k, (path, title, navigation) in enumerate(own)]
        except BookError:
            return []

    return mapped(found.select("book_id", "content"), rows, f"{DOCUMENTS}, place int, places int" if places else DOCUMENTS)


def reading_order(refs: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """(book, ordinal, path, k) of the chapters: references (book, ordinal, idref) whose item is markup and whose file is there, numbered from 0 after that.

    ``items``: book, ordinal, item_id, path, media_type; of equal ids the last counts.  ``files``: book, path.
    """
    last = items.groupBy("book", "item_id").agg(F.max_by(F.struct("path", "media_type"), "ordinal").alias("i")).select("book", F.col("item_id").alias("idref"), "i.*")
    joined = refs.join(last.where(F.col("media_type").isin(*_XHTML)), ["book", "idref"]).join(files.select("book", "path").distinct(), ["book", "path"], "left_semi")
    return O.numbered(joined, ("book",), ("ordinal",), F.floor(F.col("ordinal") / O.SPAN)).select("book", "ordinal", "path", (F.col("place") - 1).alias("k"))


def book_text(chapters: DataFrame, titles: DataFrame, span: int = 1024) -> DataFrame:
    """Plain text of whole books in reading order: book_id, k, at (code points before), piece.

    ``chapters``: book_id, k (from 0, once in a book), title (of the document), label (of the table of contents), body;
    ``titles``: book_id, title, a row a book.  The pieces of a book by k, joined by nothing, are its text: the title
    underlined (k -1), then every chapter that has a body, under its title or else its label, unless the body begins with
    that.  Places are carried along blocks of ``span`` chapters, so a book is never gathered into one row.
    """
    ends = rf"^{text.SPACES}|{text.SPACES}$"
    clean = lambda c: F.coalesce(F.regexp_replace(c, ends, ""), F.lit(""))
    under = lambda c, line: F.concat(c, F.lit("\n"), F.repeat(F.lit(line), F.length(c)))
    named = chapters.select("book_id", F.col("k").cast("long").alias("k"), clean(F.col("body")).alias("body"), clean(F.col("title")).alias("own"), clean(F.col("label")).alias("label"))
    named = named.where("body <> ''").withColumn("name", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("label")))
    head = F.when((F.col("name") != "") & ~F.startswith("body", "name"), F.concat(under(F.col("name"), "-"), F.lit("\n\n"))).otherwise("")
    rows = titles.where("title <> ''").select("book_id", F.lit(-1).cast("long").alias("k"), under(F.col("title"), "=").alias("piece"))
    rows = rows.unionByName(named.select("book_id", "k", F.concat(head, "body").alias("piece"))).withColumns({O.BLOCK: F.floor(F.col("k") / span), "_size": F.length("piece").cast("long")})
    by = ("book_id",)
    sums = rows.groupBy(*by, O.BLOCK).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    before = lambda c: F.coalesce(F.sum(c).over(O.earlier(O.along(by))), F.lit(0))
    carry = sums.select(*by, O.BLOCK, before("_n").alias("_n0"), before("_sum").alias("_sum0"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    placed = rows.withColumns({"_i": F.row_number().over(O.inside(by, "k")) - 1, "_own": F.coalesce(F.sum("_size").over(O.earlier(O.inside(by, "k"))), F.lit(0))})
    nth = F.col("_n0") + F.col("_i")
    piece = F.concat(F.when(nth > 0, "\n\n").otherwise(""), "piece", F.when(nth + 1 == F.col("_all"), "\n").otherwise(""))
    return O.with_carry(placed, carry, by).select("book_id", "k", (F.col("_sum0") + F.col("_own") + 2 * F.greatest(nth - 1, F.lit(0))).alias("at"), piece.alias("piece"))


def rebuilt(parts: DataFrame) -> DataFrame:
    """(book_id, content) of containers made of ``parts`` (book_id, ordinal, name, data)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ordinal")
        return pd.DataFrame({"book_id": [group["book_id"].iloc[0]], "content": [encode([(n, bytes(d)) for n, d in zip(rows["name"], rows["data"], strict=True)])]})

    return parts.where("ordinal >= 0").groupBy("book_id").applyInPandas(run, "book_id string, content binary")


def replaced(found: DataFrame, changed: DataFrame, target_code: str) -> DataFrame:
    """(book_id, content, error) of the containers with the documents of ``changed`` (book_id, path, data) in them and the package's language set.

    A container and its changes meet in one group, as the container is one value of the reader already.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for raw in left["content"]:
            try:
                files = [(name, data) for name, data, _ in unzip(bytes(raw or b""))]
                new = dict(zip(right["path"], map(bytes, right["data"]), strict=True))
                at, error = package(dict(files)).path, None
                try:
                    new[at] = markup.set_package_language(dict(files)[at], target_code)
                except markup.MarkupError as e:
                    error = str(e)
                rows.append((key[0], encode([(name, new.get(name, data)) for name, data in files]), error))
            except BookError as e:
                rows.append((key[0], None, str(e)))
        return pd.DataFrame(rows, columns=["book_id", "content", "error"])

    return found.select("book_id", "content").groupBy("book_id").cogroup(changed.select("book_id", "path", "data").groupBy("book_id")).applyInPandas(run, "book_id string, content binary, error string")


def save(contents: DataFrame, folder: str, suffix: str = ".epub") -> DataFrame:
    """Write each (book_id, name, content) under ``folder`` by the container sink; (book_id, path) of the files, where their names were free."""
    from quirelight.sources import containers

    containers.save(contents, folder, suffix)
    return contents.where("content is not null").select("book_id", F.concat(F.lit(f"{folder}/"), "name", F.lit(suffix)).alias("path"))
