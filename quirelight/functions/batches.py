"""Rows to rows in Arrow batches, a few at a time.

Spark hands over up to 10,000 rows at once, however long they are; here only a few of them are Python values at a time, and what
comes of them leaves the worker once it is about a MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are Python values at once, and bytes of a batch that leaves.
ROWS, BYTES = 16, 1 << 20
_TYPES = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "short": pa.int16(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}


def ddl(frame: DataFrame, *columns: str) -> str:
    """The columns with their types."""
    return ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in columns)


def mapped(frame: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows`` makes of each row of ``frame`` (its columns as arguments); ``schema``: flat columns."""
    made = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out), made, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for given in zip(*[c.to_pylist() for c in whole.slice(at, ROWS).columns], strict=True):
                    for row in rows(*given):
                        out.append(row)
                        size += 32 * len(row) + sum(len(v) for v in row if isinstance(v, (str, bytes)))
                        if size > BYTES:
                            yield batch(out)
                            out, size = [], 0
        if out:
            yield batch(out)

    return frame.mapInArrow(run, schema)
