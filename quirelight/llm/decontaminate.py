"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every training text is cut into words, each window of ``n`` words is hashed and
looked up in the hash set of the benchmark's windows, hits are verified word by
word, and the words inside verified occurrences become spans to remove (or the
document is dropped).  The scan is one narrow pass: no shuffle.

The broadcast set has a checked bound: long items are first cut into runs of
words that overlap by a window, the runs' text is measured, and they are dealt
into slices of at most about ``slice_bytes`` of text.  Each slice is one broadcast
set of flat arrays (the text, and 32 bytes a window: under 20 times the text for
words of one letter, 6 times for ordinary ones) and one link in a chain of narrow
scans over the same rows, so a benchmark of any size runs with the same memory
per worker.

Defined results: a null or empty text has no words and no hit; an item without
words has no window; null item ids take no part; repeated items and repeated
documents each keep their row; hits that overlap or touch are one span; very long
texts are read whole; an empty table gives no rows, an empty benchmark no hits;
extra columns pass through, columns named n_words, n_hit, hit_spans or hit_items
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .storage import spread

WINDOW = 10
SLICE_BYTES = 8 << 20
#: Words of a run of a long item.
RUN_WORDS = 65_536

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def item_runs(benchmark: DataFrame, n: int = WINDOW, words: int = RUN_WORDS) -> DataFrame:
    """(item_id, text): canonical words of the items, long ones in runs that share n - 1 words with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (text or "").encode().translate(tb.ALNUM_CANON).split()
                for k in range(0, max(1, len(found) - n + 1), words) if found else ():
                    ids.append(item)
                    texts.append(b" ".join(found[k : k + words + n - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["item_id", "text"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(run, "item_id long, text string")


class WindowSet:
    """Hash set of the windows of canonical item texts, by window length: flat arrays sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], n: int = WINDOW) -> None:
        raw = [(text or "").encode() for _, text in items]
        off = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        w = tb.words(buf, off, tb.ALNUM)
        hashed = tb.span_hash(tb.prefix(buf), w.start, w.end) if len(w) else np.zeros(0, dtype=tb.U64)
        owner = np.array([item for item, _ in items], dtype=np.int64)
        self.text = buf.tobytes()
        self.sets = {}
        for size in range(1, n + 1):
            at = tb.within(w, size)
            at = at[w.counts[w.doc[at]] >= n if size == n else w.counts[w.doc[at]] == size]
            if not len(at):
                continue
            gram = tb.gram_hash(hashed, size)[at]
            order = np.argsort(gram, kind="stable")
            near = np.zeros(1 << 20, dtype=bool)
            near[(gram >> tb.U64(44)).astype(np.int64)] = True
            at = at[order]
            self.sets[size] = (gram[order], w.start[at], w.end[at + size - 1], owner[w.doc[at]], near)

    def scan(self, buf: np.ndarray, off: np.ndarray) -> tuple[tb.Words, np.ndarray, dict[int, set[int]]]:
        """Words of the run, which of them are hit, and the items of documents with hits."""
        low = tb.LOWER[buf]
        w = tb.words(low, off, tb.ALNUM)
        cover = np.zeros(len(w) + 1, dtype=np.int64)
        items: dict[int, set[int]] = {}
        if len(w) and self.sets:
            hashed = tb.span_hash(tb.prefix(low), w.start, w.end)
            raw = low.tobytes()
            for size, (hashes, start, end, owner, near) in self.sets.items():
                grams = tb.gram_hash(hashed, size)
                at = np.flatnonzero(near[(grams >> tb.U64(44)).astype(np.int64)])
                at = at[w.doc[at] == w.doc[at + size - 1]]
                first = np.searchsorted(hashes, grams[at])
                same = hashes[np.minimum(first, len(hashes) - 1)] == grams[at]
                at, first = at[same], first[same]
                last = np.searchsorted(hashes, grams[at], side="right")
                for i, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                    own = b" ".join(raw[w.start[i] : w.end[i + size - 1]].translate(tb.ALNUM_CANON).split())
                    found = {int(owner[k]) for k in range(a, b) if self.text[start[k] : end[k]] == own}  # word for word
                    if found:
                        cover[i] += 1
                        cover[i + size] -= 1
                        items.setdefault(int(w.doc[i]), set()).update(found)
        return w, np.cumsum(cover[:-1]) > 0, items


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans_of(w: tb.Words, hit: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of hit words of each document that has any."""
    out: dict[int, list[tuple[int, int]]] = {}
    at = np.flatnonzero(hit)
    if len(at):
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(w.doc[at]) != 0)))
        head = at[new]
        last = at[np.concatenate((np.flatnonzero(new)[1:], [len(at)])) - 1]
        for d, a, b in zip(w.doc[head].tolist(), (head - w.first[w.doc[head]]).tolist(), (last + 1 - w.first[w.doc[head]]).tolist(), strict=True):
            out.setdefault(d, []).append((a, b))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    _, start, end = tb.merge_intervals(np.zeros(len(spans), dtype=np.int64), *(np.array(x, dtype=np.int64) for x in zip(*spans, strict=True)))
    return list(zip(start.tolist(), end.tolist(), strict=True))


def _scan_batches(sets, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sets.value
        for batch in batches:
            buf, off = tb.flat(batch.column("text"))
            n = batch.num_rows
            counts, spans, items = [np.zeros(0, dtype=np.int64)], {}, {}
            for i, j in tb.slices(off):
                w, hit, found = own.scan(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts.append(w.counts)
                spans |= {i + d: x for d, x in _spans_of(w, hit).items()}
                items |= {i + d: x for d, x in found.items()}
            before = batch.column("n_hit").to_numpy()
            for d in np.flatnonzero(before).tolist():  # hits of the slices before
                spans[d] = _union([(x["start"], x["end"]) for x in batch.column("hit_spans")[d].as_py()] + spans.get(d, []))
                items[d] = {*batch.column("hit_items")[d].as_py(), *items.get(d, ())}
            hits = np.zeros(n, dtype=np.int64)
            for d, x in spans.items():
                hits[d] = sum(b - a for a, b in x)
            none: list = []
            yield tb.extend(
                batch,
                carried,
                n_words=pa.array(np.concatenate(counts), pa.int64()),
                n_hit=pa.array(hits, pa.int64()),
                hit_spans=pa.array([[{"start": a, "end": b} for a, b in spans[d]] if d in spans else none for d in range(n)], _ARROW_SPANS),
                hit_items=pa.array([sorted(items[d]) if d in items else none for d in range(n)], pa.list_(pa.int64())),
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, slice_bytes: int = SLICE_BYTES, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word ranges) and hit_items (sorted item ids).

    docs needs ``text``; benchmark needs ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    clash = {"n_words", "n_hit", "hit_spans", "hit_items"} & set(docs.columns)
    docs = docs.drop(*clash)
    runs = item_runs(benchmark, n, run_words)
    total = runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // slice_bytes))
    out = spread(docs).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_spans": F.array().cast(_SPANS), "hit_items": F.array().cast("array<bigint>")})
    carried = docs.columns
    for part in range(parts):
        own = runs.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else runs
        sets = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.text) for r in own.distinct().collect()], n))
        schema = T.StructType([*docs.schema.fields, *[T.StructField(c, out.schema[c].dataType) for c in ("n_words", "n_hit", "hit_spans", "hit_items")]])
        out = out.mapInArrow(tb.trimmed(_scan_batches(sets, carried)), schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``decontaminate``'s result."""
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(found: DataFrame, columns: list[str], *, how: str = "documents") -> DataFrame:
    """Act on the hits: drop contaminated documents, or cut the hit words out of their texts (``how='spans'``)."""
    if how == "documents":
        return found.where("n_hit = 0").select(*columns)
    carried = [c for c in found.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, text = batch.column("n_hit").to_numpy(), batch.column("text")
            if hit.any():
                texts = text.to_pylist()
                for d in np.flatnonzero(hit).tolist():
                    texts[d] = cut_words(texts[d], batch.column("hit_spans")[d].as_py())
                text = pa.array(texts, pa.string())
            yield tb.extend(batch, carried, text=text)

    schema = T.StructType([*[found.schema[c] for c in carried], T.StructField("text", T.StringType())])
    return found.mapInArrow(tb.trimmed(run), schema).select(*columns)


def cut_words(text: str | None, spans: list) -> str | None:
    """``text`` without the bytes from the first to the last word of each span."""
    if not text or not spans:
        return text
    raw = text.encode()
    buf = tb.LOWER[np.frombuffer(raw, dtype=np.uint8)]
    w = tb.words(buf, np.array([0, len(buf)]), tb.ALNUM)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : w.start[s["start"]]])
        at = int(w.end[s["end"] - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def brute_force(text: str | None, items: list[tuple[int, str | None]], n: int = WINDOW) -> tuple[int, int, list[int]]:
    """Reference answer for one document, for tests."""
    def split(x):
        return (x or "").encode().translate(tb.ALNUM_CANON).split()

    own, hit, found = split(text), set(), set()
    for item, other in items:
        theirs = split(other)
        size = min(n, len(theirs))
        wanted = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1) if size else ():
            if tuple(own[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add(item)
    return len(own), len(hit), sorted(found)


def sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
