"""Table functions for SQL: ``segments`` of a document, and greedy ``batches`` of an ordered table.

    SELECT page_id, s.* FROM pages, LATERAL segments(encode(html, 'utf-8'), 'html') AS s
    SELECT * FROM batches(TABLE(SELECT doc_id, seg, source FROM lines), 4000, 40)

``batches`` asks for its own partitioning and order (by the table's first and second column), so SQL need not name them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quirelight.functions import markup


class Segments:
    """(seg, kind, elem, start, end, source, is_title) of each segment of a document; a document that is refused has none."""

    SCHEMA = StructType().add("seg", IntegerType()).add("kind", StringType()).add("elem", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("source", StringType()).add("is_title", BooleanType())

    @staticmethod
    def analyze(doc: AnalyzeArgument, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
        if doc.isTable or not isinstance(doc.dataType, (BinaryType, StringType)):
            raise ValueError("segments takes the bytes or the text of a document")
        if mode is not None and mode.isConstantExpression and mode.value not in ("strict", "html"):
            raise ValueError("the mode is strict or html")
        return AnalyzeResult(Segments.SCHEMA)

    def eval(self, doc, mode="strict"):
        if doc is None:
            return
        try:
            found = markup.extract(doc.encode() if isinstance(doc, str) else bytes(doc), mode)
        except markup.MarkupError:
            return
        for k, s in enumerate(found):
            yield k, s.kind, s.elem, s.start, s.end, s.source, s.is_title


class Batches:
    """(key, chunk, n_chunks, lo, hi, n_bytes) of greedy batches: rows of one key, in order, up to a budget of bytes and a number of rows.

    The table has the key, the order and the text as its first three columns.  Rows stream through; only bounds are held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 3:
            raise ValueError("batches takes a table of key, order and text")
        key, order = rows.dataType.fields[0], rows.dataType.fields[1]
        schema = StructType([StructField(key.name, key.dataType)]).add("chunk", IntegerType()).add("n_chunks", IntegerType()).add("lo", IntegerType()).add("hi", IntegerType()).add("n_bytes", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(order.name)])

    def __init__(self) -> None:
        self.bounds: list[list[int]] = []
        self.key, self.at = None, 0

    def eval(self, row, budget: int, most: int):
        self.key, size = row[0], len((row[2] or "").encode())
        last = self.bounds[-1] if self.bounds else None
        if last is None or last[2] + size > budget or last[1] - last[0] >= most:
            self.bounds.append([self.at, self.at + 1, size])
        else:
            last[1], last[2] = self.at + 1, last[2] + size
        self.at += 1

    def terminate(self):
        for k, (lo, hi, size) in enumerate(self.bounds):
            yield self.key, k, len(self.bounds), lo, hi, size


def register(spark: SparkSession) -> None:
    """Make ``segments`` and ``batches`` known to the session's SQL."""
    spark.udtf.register("segments", udtf(Segments))
    spark.udtf.register("batches", udtf(Batches))
