"""Book containers as a data source of Spark: read by seek, written with a commit protocol.

``spark.read.format("containers").option("table", ...).load(path)`` gives, for every container under a path:

* ``packages``: a row a container; reads its directory, the package document and the tables of contents;
* ``documents``: a row a document to work on; reads those beside;
* ``entries`` (the default): a row a file; reads the directory, and the bytes only if the schema that is asked for has
  ``data``.  Conditions on ``name`` and ``book_id`` are pushed into the scan, so other files are never inflated.

``contents.write.format("containers").mode("append").save(folder)`` writes (name, content) rows as files.  Tasks write into a
temporary folder of the job, the commit moves the files to their names, and a name that is taken gets ``.2``, ``.3`` before
its ending: nothing is overwritten.  A failed job takes its temporary folder with it.

The driver never holds a list of all files: a listing goes into packed parts as it comes, and the commit reads the names that each
task has left beside its files.

Files are reached through Arrow's file systems (local paths, and HDFS, S3 or GCS where their libraries are), on the executors.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quirelight.sources import epub as E

TABLES = {
    "entries": "book_id string, ordinal int, name string, size long, data binary, error string",
    "packages": "book_id string, package string, title string, language string, version string, chapters int, error string",
    "documents": E.DOCUMENTS,
}
#: Bytes of containers that one task reads, and containers at most.
TASK_BYTES, TASK_FILES = 256 << 20, 1000


def file_system(path: str):
    """(Arrow's file system, path in it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")


@dataclass
class Part(InputPartition):
    """Paths of the containers that one task reads, packed, as the driver has the parts of all tasks."""

    packed: bytes

    @classmethod
    def of(cls, paths: list[str]) -> Part:
        return cls(zlib.compress(json.dumps(sorted(paths)).encode()))

    @property
    def paths(self) -> list[str]:
        return json.loads(zlib.decompress(self.packed))


def listed(store, root: str, suffix: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files under ``root`` with this ending, without those of writes under way; of a local folder an entry at a time, else a folder at a time."""
    from pyarrow import fs

    def folder(at: str) -> Iterator[tuple[str, int]]:
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(at) as held:
                for f in held:
                    if f.is_dir():
                        yield from folder(f.path)
                    elif f.name.endswith(suffix) and f.is_file():
                        yield f.path, f.stat().st_size
        else:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.Directory:
                    yield from folder(f.path)
                elif f.is_file and f.base_name.endswith(suffix):
                    yield f.path, f.size

    info = store.get_file_info(root)
    if info.is_file:
        yield info.path, info.size
    else:
        yield from (f for f in folder(root.rstrip("/") or "/") if "/_temporary-" not in f[0])


def entries(file, wanted: frozenset[str] | None, with_data: bool) -> Iterator[tuple[int, str, int, bytes | None]]:
    """(ordinal, name, size, bytes) of a container's files, inflating only what is wanted."""
    files = E.Files(file)
    for k, (name, size) in enumerate(files.sizes()):
        if wanted is None or name in wanted:
            yield k, name, size, files[name] if with_data else None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.table, self.suffix = schema.names, options["path"], options.get("table", "entries"), options.get("suffix", ".epub")
        self.wanted: frozenset[str] | None = None
        self.books: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = None
            if isinstance(f, EqualTo):
                values = frozenset((f.value,))
            elif isinstance(f, In):
                values = frozenset(f.value)
            if values is not None and f.attribute == ("name",) and self.table == "entries":
                self.wanted = values if self.wanted is None else self.wanted & values
            elif values is not None and f.attribute == ("book_id",):
                self.books = values if self.books is None else self.books & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, root = file_system(self.path)
        parts, paths, total = [], [], 0
        for path, size in listed(store, root, self.suffix):
            if self.books is not None and path not in self.books:
                continue
            if paths and (total + size > TASK_BYTES or len(paths) >= TASK_FILES):
                parts.append(Part.of(paths))
                paths, total = [], 0
            paths.append(path)
            total += size
        return [*parts, Part.of(paths)]

    def read(self, part: Part) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        at = [TABLES[self.table].split(", ").index(c) for c in TABLES[self.table].split(", ") if c.split()[0] in self.names]
        for path in part.paths:
            with store.open_input_file(path) as file:
                for row in self._rows(path, file):
                    yield tuple(row[k] for k in at)

    def _rows(self, book: str, file) -> Iterator[tuple]:
        try:
            if self.table == "entries":
                for k, name, size, data in entries(file, self.wanted, "data" in self.names):
                    yield book, k, name, size, data, None
            elif self.table == "packages":
                p = E.package(E.Files(file))
                yield book, p.path, p.title, p.language, p.version, len(p.chapters), None
            else:
                files = E.Files(file)
                p = E.package(files)
                for k, (path, title, navigation) in enumerate(p.worklist()):
                    yield book, p.title, k, path, title, navigation, files[path]
        except E.BookError as e:
            if self.table == "entries":
                yield book, -1, None, None, None, str(e)
            elif self.table == "packages":
                yield book, None, None, None, None, 0, str(e)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that has written files: 0, 1, ..., and their names, a line each in JSON, in NAMES; None without any."""

    folder: str | None


NAMES = "names"


class Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("containers are written from the columns name and content")
        self.place, self.path = (schema.names.index("name"), schema.names.index("content")), options["path"].rstrip("/")
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = file_system(self.job)
        own, k = f"{root}/{uuid.uuid4().hex}", 0  # an attempt that is repeated writes anew; only the one that counts is moved
        names = None
        try:
            for row in rows:
                name, content = row[self.place[0]], row[self.place[1]]
                if content is None:
                    continue
                if names is None:
                    store.create_dir(own, recursive=True)
                    names = store.open_output_stream(f"{own}/{NAMES}")
                with store.open_output_stream(f"{own}/{k}") as out:
                    out.write(content.encode() if isinstance(content, str) else bytes(content))
                names.write(f"{json.dumps(name)}\n".encode())
                k += 1
        finally:
            if names is not None:
                names.close()
        return Written(own if k else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            if message is None or message.folder is None:
                continue
            with store.open_input_stream(f"{message.folder}/{NAMES}") as names:
                for k, line in enumerate(io.BufferedReader(names)):
                    store.move(f"{message.folder}/{k}", free(store, root, json.loads(line)))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        store, root = file_system(self.job)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def free(store, root: str, name: str) -> str:
    """A path for ``name`` under ``root`` that is not taken."""
    from pyarrow import fs

    stem, ending = posixpath.splitext(name)
    k, path = 1, f"{root}/{name}"
    while store.get_file_info(path).type != fs.FileType.NotFound:
        k += 1
        path = f"{root}/{stem}.{k}{ending}"
    return path


class Containers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "entries")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("containers are never overwritten")
        return Writer(schema, dict(self.options))


def read(spark: SparkSession, path: str, table: str = "entries", columns: str | None = None, suffix: str = ".epub") -> DataFrame:
    """A table of the containers under ``path``; ``columns``: a schema of some of its columns."""
    spark.dataSource.register(Containers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("containers").option("table", table).option("suffix", suffix)
    return (reader.schema(columns) if columns else reader).load(path)


def save(contents: DataFrame, folder: str, suffix: str = ".epub") -> None:
    """Write each (name, content) as a file under ``folder``."""
    from pyspark.sql import functions as F

    contents.sparkSession.dataSource.register(Containers)
    contents.select(F.concat("name", F.lit(suffix)).alias("name"), "content").write.format("containers").mode("append").save(folder)
