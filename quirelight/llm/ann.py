"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: iterative quantisation (a principal rotation, then alternating sign codes
and orthogonal Procrustes steps) fitted to a bounded sample (``sample`` rows in
expectation); further rotations from other seeds give as many bits as are asked
for.  A code is cut into substrings of about log2(rows) + 3 bits, and each
substring is indexed: a directory for each place and range of values, spread
over the tasks, holds the rows by value.

A query looks up the ball of ``reach`` bits around its substring in every
directory.  By the pigeonhole principle this retrieves every code within
``parts * (reach + 1) - 1`` bits of the query's; the other rows that share such
a ball come along, and all that is retrieved is ranked by the exact Euclidean
distance of the float vectors in double precision.  ``reach`` and ``parts`` are
the least for which ``recall`` of the sample's true neighbours are retrieved
(near ones in the sample's density, so that they stand for k of all rows).  A
query that retrieves fewer than k rows is compared with all rows, in blocks.

Rows of one vector are one node with its k + 1 smallest ids, so a vector that a
third of the rows repeat is indexed once.  Entries, lookups and retrieved pairs
travel as packed arrays; only k rows a query and block leave the ranking.

Defined results: vectors that are null, empty, all zero, of another length than
most, or hold null or non-finite components take no part, nor do null ids.
Repeated rows (same id and vector) count once.  An id with several vectors is a
candidate with each of them, never of a query with its own id; as a query it
stands for the smallest of its vectors (compared component by component).  Ties
go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import written

RECALL, SAMPLE = 0.97, 8_000
ROW_BLOCK, QUERY_BLOCK, DIRECTORY_ROWS = 4_096, 16_384, 1 << 20
#: Substrings at most before the ball grows, bits of a substring at least and at most.
MOST_PARTS, LEAST_BITS, MOST_BITS = 320, 8, 20
_EMPTY = np.zeros(0, dtype=np.int64)


def fit(x: np.ndarray, bits: int, *, steps: int = 8, rows: int = 2_000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x bits projection) of the learned codes."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    centred = (x - mean)[:rows]
    width = min(d, 256)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:width].T
    if axes.shape[1] < width:
        axes = np.linalg.qr(np.concatenate((axes, rng.normal(size=(d, width - axes.shape[1]))), axis=1))[0]
    flat = centred @ axes
    columns = []
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat, full_matrices=False)
            turn = (u @ v).T
        columns.append(axes @ turn)
    return mean, np.concatenate(columns, axis=1)[:, :bits]


@dataclass
class Learned:
    mean: np.ndarray
    projection: np.ndarray
    bits: int  # of a substring
    parts: int
    reach: int

    def values(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """rows x parts: the value of each substring."""
        weight = 1 << np.arange(self.bits, dtype=np.int64)[::-1]
        out = [(((x[i : i + rows] - self.mean) @ self.projection) >= 0).reshape(-1, self.parts, self.bits) @ weight for i in range(0, len(x), rows)]
        return np.concatenate(out) if out else np.zeros((0, self.parts), dtype=np.int64)


def learn(x: np.ndarray, n: int, k: int, *, recall: float = RECALL, probes: int = 400) -> Learned:
    """Codes, ball and number of substrings for ``n`` rows, from a sample of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 2))) + 3))
    mean, projection = fit(x, MOST_PARTS * bits)
    near = max(1, math.ceil(k * len(x) / max(n, 1)))
    whole = Learned(mean, projection, bits, MOST_PARTS, bits)
    values, pairs = whole.values(x), []
    for i in range(min(probes, len(x)) if len(x) > 1 else 0):
        distance = ((x - x[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        pairs += [(i, j) for j in np.argsort(distance, kind="stable")[: min(near, len(x) - 1)].tolist()]
    if pairs:
        a, b = np.array(pairs).T
        apart = np.bitwise_count(values[a] ^ values[b])
        for reach in range(bits + 1):
            share = np.logical_or.accumulate(apart <= reach, axis=1).mean(axis=0)
            if share[-1] >= recall:
                parts = int(np.argmax(share >= recall)) + 1
                return Learned(mean, projection[:, : parts * bits], bits, parts, reach)
    return Learned(mean, projection[:, :bits], bits, 1, bits)


def masks(bits: int, reach: int) -> list[np.ndarray]:
    """All values of ``bits`` bits with 0, 1, ... ``reach`` bits set."""
    every = np.arange(1 << bits, dtype=np.int64)
    count = np.bitwise_count(every)
    return [every[count == k] for k in range(min(bits, reach) + 1)]


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def valid(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(payloads: list[bytes], *kinds) -> list[np.ndarray]:
    """The columns of all payloads, one after another, as 64-bit numbers."""
    parts: list[list[np.ndarray]] = [[_EMPTY] for _ in kinds]
    for p in payloads:
        n, at = int(np.frombuffer(p, dtype=np.int64, count=1)[0]), 8
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(p, dtype=kind, count=n, offset=at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


_ENTRY = "directory long, kind int, payload binary"
_PAIRS = "block long, query_block long, kind int, payload binary"
_FOUND = "query_id long, vec_id long, score double, touched long"


def _rows(rows: list[tuple], schema: tuple[tuple[str, pa.DataType], ...]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


_ENTRY_ARROW = (("directory", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()))
_PAIRS_ARROW = (("block", pa.int64()), ("query_block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()))


def _posted(shared, ranged: int, kind: int):
    """Rows (node, embedding; or query, its block, embedding) as entries or lookups for the directories; a lookup goes to every range its ball meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tops = np.arange(1 << ranged, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [batch.column(c).to_numpy() for c in range(batch.num_columns - 1)]
            values, rows = own.values(_vectors(batch.column(batch.num_columns - 1))), []
            for p in range(own.parts):
                top = values[:, p] >> (own.bits - ranged)
                for t in (np.unique(top) if kind == 0 else tops).tolist():
                    at = np.flatnonzero(top == t if kind == 0 else np.bitwise_count(top ^ t) <= own.reach)
                    if len(at):
                        rows.append((p << ranged | t, kind, _pack(values[at, p].astype(np.uint32), *(c[at] for c in given))))
            yield _rows(rows, _ENTRY_ARROW)

    return run


def _looked_up(shared, ranged: int, blocks: int):
    """Per directory: the rows in the ball of each query, packed by blocks."""

    def run(key, table):
        own = shared.value
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        value, node = _unpack([p for p, k in zip(payloads, kinds, strict=True) if k == 0], np.uint32, np.int64)
        asked, query, query_block = _unpack([p for p, k in zip(payloads, kinds, strict=True) if k == 1], np.uint32, np.int64, np.int64)
        out: list[tuple] = []
        if len(value) and len(asked):
            low = own.bits - ranged
            order = np.argsort(value, kind="stable")
            node = node[order]
            block = node % blocks
            first = np.searchsorted(value[order] & ((1 << low) - 1), np.arange((1 << low) + 1))
            left = own.reach - np.bitwise_count((asked >> low) ^ (key[0].as_py() & ((1 << ranged) - 1))).astype(np.int64)
            balls = masks(low, own.reach)
            for room in np.unique(left).tolist():
                ball = np.concatenate(balls[: room + 1])
                same = np.flatnonzero(left == room)
                for i in range(0, len(same), max(1, (1 << 20) // len(ball))):
                    at = same[i : i + max(1, (1 << 20) // len(ball))]
                    target = ((asked[at] & ((1 << low) - 1))[:, None] ^ ball[None]).reshape(-1)
                    count = first[target + 1] - first[target]
                    hit = np.flatnonzero(count)
                    place = tb.ranges(first[target[hit]], count[hit])
                    who = at[np.repeat(hit // len(ball), count[hit])]
                    by = np.lexsort((block[place], query_block[who]))
                    place, who = place[by], who[by]
                    change = np.flatnonzero(np.concatenate(([True], (block[place][1:] != block[place][:-1]) | (query_block[who][1:] != query_block[who][:-1])))).tolist() if len(by) else []
                    for a, b in zip(change, [*change, len(by)][1:]):
                        out.append((int(block[place[a]]), int(query_block[who[a]]), 0, _pack(query[who[a:b]], node[place[a:b]])))
        return pa.Table.from_batches([_rows(out, _PAIRS_ARROW)])

    return run


def _ranked(k: int, everything: bool = False):
    """Per pair of blocks: the k nearest of the retrieved rows (or of all rows) for each query."""

    def run(key, left, right):
        kinds, payloads = right.column("kind").to_pylist(), right.column("payload").to_pylist()
        given = [p for p, kind in zip(payloads, kinds, strict=True) if kind == 1]
        out: list[tuple] = []
        if left.num_rows and given:
            n = [int(np.frombuffer(p, dtype=np.int64, count=1)[0]) for p in given]
            query = np.concatenate([np.frombuffer(p, dtype=np.int64, count=m, offset=8) for p, m in zip(given, n, strict=True)])
            wanted = np.concatenate([np.frombuffer(p, dtype=np.float64, offset=8 + 8 * m).reshape(m, -1) for p, m in zip(given, n, strict=True)])
            node, x, ids = left.column("node").to_numpy(), _vectors(left.column("embedding")), left.column("ids").combine_chunks()
            own, edge = ids.values.to_numpy(), ids.offsets.to_numpy()
            order = np.argsort(query, kind="stable")
            query, wanted = query[order], wanted[order]
            place = np.argsort(node, kind="stable")
            if everything:
                pairs = np.arange(len(query) * len(node))
            else:
                q, r = _unpack([p for p, kind in zip(payloads, kinds, strict=True) if kind == 0], np.int64, np.int64)
                pairs = np.unique(np.searchsorted(query, q) * len(node) + np.searchsorted(node[place], r))
            bounds = np.searchsorted(pairs, np.arange(len(query) + 1) * len(node))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                rows = place[pairs[bounds[i] : bounds[i + 1]] - i * len(node)]
                distance = np.sqrt(np.cumsum((x[rows] - wanted[i]) ** 2, axis=1)[:, -1])  # summed in order
                size = edge[rows + 1] - edge[rows]
                who, distance = own[tb.ranges(edge[rows], size)], np.repeat(distance, size)
                other = who != query[i]
                who, distance = who[other], distance[other]
                best = np.lexsort((who, distance))[:k].tolist()
                out += [(int(query[i]), int(who[b]), float(distance[b]), 0 if t else len(rows)) for t, b in enumerate(best)]
        return pa.Table.from_batches([_rows(out, (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("touched", pa.int64())))])

    return run


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with their vectors, packed by block."""
    for batch in batches:
        query, block, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))
        yield _rows([(int(b), 1, np.int64((block == b).sum()).tobytes() + query[block == b].tobytes() + np.ascontiguousarray(x[block == b]).tobytes()) for b in np.unique(block)], (("query_block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())))


def _numbered(n: int, name: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)


def nearest(vectors: DataFrame, *, k: int = 10, every: int = 100, sample: int = SAMPLE, recall: float = RECALL, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, n_candidates) for every id divisible by ``every``; n_candidates: vectors ranked for the query."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    # the k + 1 smallest ids of each vector; the limit on the rank prunes before the shuffle
    smallest = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    folded = smallest.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(folded, "nodes")
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_candidates long")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "queries")
    blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-asked.count() // query_block))
    nodes = nodes.withColumn("block", F.pmod("node", F.lit(blocks)))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    share = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) / (1 << 30)
    drawn = nodes.where(share < min(1.0, sample / n)).select("embedding", F.col("ids")[0].alias("id")).orderBy("id", "embedding").collect() or nodes.select("embedding").limit(1).collect()
    learned = learn(np.array([r.embedding for r in drawn], dtype=np.float64), n, k, recall=recall)
    shared = spark.sparkContext.broadcast(learned)
    ranged = min(learned.bits, max(0, math.ceil(math.log2(n / directory_rows)))) if n > directory_rows else 0

    entries = nodes.select("node", "embedding").mapInArrow(tb.trimmed(_posted(shared, ranged, 0)), _ENTRY)
    lookups = asked.select("query_id", "query_block", "embedding").mapInArrow(tb.trimmed(_posted(shared, ranged, 1)), _ENTRY)
    pairs = entries.unionByName(lookups).groupBy("directory").applyInArrow(_looked_up(shared, ranged, blocks), _PAIRS)
    keys = ("block", "query_block")

    def ranked(pairs: DataFrame | None, queries: DataFrame) -> DataFrame:
        parcels = queries.select("query_id", "query_block", "embedding").mapInArrow(_parcels, "query_block long, kind int, payload binary").select(_numbered(blocks, "block"), "query_block", "kind", "payload")
        data = nodes.select("node", "ids", "embedding", "block", _numbered(query_blocks, "query_block"))
        return data.groupBy(*keys).cogroup((parcels if pairs is None else parcels.unionByName(pairs)).groupBy(*keys)).applyInArrow(_ranked(k, pairs is None), _FOUND)

    found = written(ranked(pairs, asked), "found")
    few = asked.join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
    if few.limit(1).count():
        few = written(few, "few")
        found = found.join(few, "query_id", "left_anti").unionByName(ranked(None, few))
    whole = Window.partitionBy("query_id")
    order = whole.orderBy("score", "vec_id")
    placed = found.withColumn("rank", F.row_number().over(order)).withColumn("n_candidates", F.sum("touched").over(whole))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_candidates")


def brute_force(rows: list[tuple[int, list | None]], k: int = 10, every: int = 100) -> dict[int, list[tuple[float, int]]]:
    """Reference answer by comparing every query with every row, for tests."""
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    sizes = [len(v) for _, v in good]
    common = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    good = [(i, np.array(v)) for i, v in good if len(v) == common]
    queries: dict[int, np.ndarray] = {}
    for i, v in good:
        if i % every == 0:
            queries.setdefault(i, v)
    return {q: sorted((float(np.sqrt(np.cumsum((v - x) ** 2)[-1])), i) for i, v in good if i != q)[:k] for q, x in queries.items()}
