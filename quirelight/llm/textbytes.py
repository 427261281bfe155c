"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Everything here works on one flat
``uint8`` buffer holding a bounded run of whole documents, so the cost per byte
is a handful of numpy passes and no Python loop touches single words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once by one Python worker (a longer document is handled alone).
SLICE_BYTES = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, a bijection of 64-bit words."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUE = splitmix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN)) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

#: For canonical word strings: every byte that is no word byte becomes a space.
ALNUM_CANON = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
NONSPACE_CANON = bytes(int(LOWER[b]) if NONSPACE[b] else 32 for b in range(256))

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, step in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            values = np.full(size, step, dtype=U64)
            values[0] = 1
            globals()[name] = np.multiply.accumulate(values)
    return _powers, _inverses


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, budget: int = SLICE_BYTES, most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``budget`` bytes and ``most`` rows; a longer document comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + budget, side="right")) - 1
        j = min(max(j, i + 1), n, i + most)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of documents: byte ranges, document of each, first word of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(docs) + 1

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of word bytes that don't cross documents; ``buf`` is already lower-cased if need be."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(len(off), dtype=np.int64))
    inside = table[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, first)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of ``buf``."""
    powers, _ = _grow(len(buf))
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[buf] * powers[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, the same wherever its bytes stand."""
    _, inverses = _grow(len(sums))
    return splitmix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U64) * U64(_GOLDEN))


def gram_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (runs across documents included; the caller masks them)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(m, dtype=U64)
    for k in range(n):
        total += word_hash[k : k + m] * U64(pow(_BASE, k + 1, 1 << 64))
    return splitmix(total)


def within(w: Words, n: int) -> np.ndarray:
    """Starts of runs of ``n`` words that stay in one document."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])


def merge_intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals by document: sorted, disjoint and not touching."""
    if len(doc) == 0:
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # ends are made comparable across documents by shifting each document beyond the one before
    rank = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    shift = rank * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start[1:] + shift[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
    head = np.flatnonzero(new)
    last = np.concatenate((head[1:], [len(doc)])) - 1
    return doc[head], start[head], reach[last] - shift[last]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start[i], start[i] + count[i])``."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = count > 0
    start, count = start[keep].astype(np.int64), count[keep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(count)[:-1]))
    out[at] = start
    out[at[1:]] -= start[:-1] + count[:-1] - 1
    return np.cumsum(out)


def extend(batch: pa.RecordBatch, carried: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The carried columns of ``batch`` with new ones after them."""
    kept = [batch.column(c) for c in carried]
    return pa.RecordBatch.from_arrays([*kept, *new.values()], names=[*carried, *new])


def release() -> None:
    """Give freed memory back, so that idle Python workers stay small beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A batch iterator function that releases memory when it is done."""

    @functools.wraps(run)
    def batches(given):
        try:
            yield from run(given)
        finally:
            release()

    return batches
