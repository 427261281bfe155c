"""Exact removal of repeated byte strings with two-stage suffix sorting.

Every byte inside a 50-byte string that also starts in a document with a smaller
id is removed.  Whole texts, all windows:

1. Each window of 50 bytes is represented by the smallest hash of its 16-byte
   grams.  A *piece* is a run of windows of one document with one smallest hash;
   equal windows always meet under the same hash.  Documents are dealt into
   groups; each group sends every hash once to the bucket of that hash and gets
   back those that stand in several documents.  Hashes only choose candidates.
2. Each group sends the bytes of its pieces under those hashes to the hash's
   bucket, one of each content: copies inside a group are compared byte by byte
   and settled against the one of the smallest id, so a passage that stands in a
   third of all documents costs one piece a group.  A hash with more than ``hot``
   contents (a short common line between different surroundings) is split: its
   windows are sent one by one, each under the hash of its 50 bytes.
3. In each bucket the suffixes of the distinct contents are sorted in two stages:
   suffixes smaller than their successors are sorted directly, the others are
   induced by a scan over the buckets of first bytes.  Adjacent common prefixes
   of 50 bytes or more give the groups of equal windows, and the smallest id of a
   group decides what the others lose.
4. The lost byte runs go back to their documents.

The texts are shuffled once, by a hash of the id (the exchange is reused by all
steps); all other traffic is packed arrays, and nothing reaches the driver.  The
first exchange has a row for each group and bucket that meet, so never more than
there are hashes; groups and buckets are counted from the bytes of the texts.

Defined results: null and empty texts have no bytes; texts under 50 bytes lose
nothing; a null id neither loses nor claims bytes; equal ids don't claim bytes
from each other; ``doc_id`` identifies a text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .storage import buckets_for

LENGTH, GRAM = 50, 16
#: Bytes of text for each group of documents and each bucket of hashes; their numbers follow the input.
GROUP_BYTES, BUCKET_BYTES = 10 << 20, 10 << 20
#: Contents under one hash, over all groups, from which its windows go one by one; contents a group counts from.
HOT, COUNTED = 4096, 16
_SORTED = 1 << 20  # bytes of pieces whose suffixes are sorted at once
_SLICE = 1 << 19  # bytes of text whose windows are hashed at once
_SCHEMA = "bucket long, kind int, payload binary"


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, windows) of every piece of a run of documents, in order of place; at most 255 windows each."""
    parts = []
    for i, j in tb.slices(off, _SLICE):
        hashed, doc, start, count = _pieces(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append((hashed, doc + i, start, count))
    if not parts:
        return np.zeros(0, dtype=tb.U64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    hashed, doc, start, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    more = (count - 1) // 255
    if more.any():
        row = np.repeat(np.arange(len(count)), more + 1)
        step = tb.ranges(np.zeros(len(count), dtype=np.int64), more + 1)
        hashed, doc, start, count = hashed[row], doc[row], start[row] + 255 * step, np.minimum(255, count[row] - 255 * step)
    return tb.splitmix(hashed), doc, start, count


def _pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=tb.U64), none, none, none
    sums = tb.prefix(buf)
    low = sums[GRAM:] - sums[:-GRAM]
    low *= tb._grow(len(buf))[1][: len(low)]
    low ^= low >> tb.U64(32)
    low *= tb.U64(0xD6E8FEB86659FD93)
    low ^= low >> tb.U64(29)
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    room = np.diff(off) - LENGTH + 1
    valid = np.zeros(len(buf) + 1, dtype=np.int8)
    own = np.flatnonzero(room > 0)
    valid[off[own]] = 1
    valid[off[own] + room[own]] -= 1
    valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
    head = valid.copy()
    head[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    head[off[own]] = True
    start = np.flatnonzero(head)
    doc = np.searchsorted(off, start, side="right") - 1
    end = np.minimum(np.concatenate((start[1:], [n])), (off[:-1] + room)[doc])
    return low[start], doc, start - off[doc], end - start


def _pack(*columns: np.ndarray) -> bytes:
    """Columns one after another, so that each compresses well; the count comes first."""
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, dtype=np.int64, count=1)[0])
    out, at = [], 8
    for kind in kinds:
        out.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    out.append(np.frombuffer(payload, dtype=np.uint8, offset=at))
    return out


def _squeezed(payload: bytes) -> bytes:
    """Text goes through the shuffle at about half the size that the shuffle's own codec leaves it."""
    return np.int64(len(payload)).tobytes() + pa.compress(payload, codec="zstd", asbytes=True)


def _unsqueezed(payload: bytes) -> bytes:
    size = int(np.frombuffer(payload, dtype=np.int64, count=1)[0])
    return pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)


def _split(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by part of ``key``, in their order."""
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, order[bounds[k] : bounds[k + 1]]


def _bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> tb.U64(32)) * tb.U64(buckets) >> tb.U64(32)).astype(np.int64)


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return _bucket_of(tb.splitmix(doc.astype(tb.U64)), groups)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "payload"])


_LOW = tb.U64((1 << 40) - 1)


def _five(hashed: np.ndarray) -> bytes:
    """The low 40 bits of each hash (its bucket holds the high ones)."""
    return np.ascontiguousarray((hashed & _LOW).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _contents(buf: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run; rows ascend."""
    out = np.zeros(len(row), dtype=tb.U64)
    for i, j in tb.slices(off):
        lo, hi = np.searchsorted(row, (i, j))
        begin = off[row[lo:hi]] - off[i] + start[lo:hi]
        out[lo:hi] = tb.span_hash(tb.prefix(buf[off[i] : off[j]]), begin, begin + size[lo:hi])
    return out


def _heads(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal neighbours."""
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, dtype=np.int64)
    return head, np.diff(np.concatenate((head, [len(value)])))


def _announce(buckets: int):
    """Per group of documents and bucket: its hashes, first those of one document, then those of several; those of many contents also with their number."""

    def run(key, docs):
        buf, off = tb.flat(docs.column("text"))
        hashed, doc, start, count = pieces(buf, off)
        content = _contents(buf, off, doc, start, count + LENGTH - 1)
        rows = []
        for k, own in _split(_bucket_of(hashed, buckets), buckets):
            order = own[np.lexsort((doc[own], hashed[own] & _LOW))]
            value = hashed[order] & _LOW
            head, size = _heads(value)
            several = doc[order[head]] != doc[order[head + size - 1]]
            one, two = value[head[~several]], value[head[several]]
            many = []
            for at in np.flatnonzero(size > COUNTED).tolist():
                n = len(np.unique(content[order[head[at] : head[at] + size[at]]]))
                if n > COUNTED:
                    many.append((int(value[head[at]]), n))
            more = np.array(many, dtype=np.uint64).reshape(-1, 2)
            rows.append((k, key[0].as_py(), np.array([len(one), len(two)], dtype=np.int64).tobytes() + _five(one) + _five(two) + more.tobytes()))
        tb.release()
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()), "payload": pa.array(cols[2], pa.binary())})

    return run


def _answer(hot: int):
    """Per bucket: to each group those of its hashes that stand in several documents, first the others, then the hot ones."""

    def run(key, table):
        parts, hashed, flags, counted = [], [], [], []
        for part, payload in zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True):
            n, m = np.frombuffer(payload, dtype=np.int64, count=2).tolist()
            own = _from_five(np.frombuffer(payload, dtype=np.uint8, offset=16, count=5 * (n + m)))
            hashed.append(own)
            parts.append(np.full(len(own), part, dtype=np.int64))
            flags.append(np.arange(len(own)) >= n)
            counted.append(np.frombuffer(payload, dtype=np.uint64, offset=16 + 5 * (n + m)).reshape(-1, 2))
        hashed, parts, flags, counted = np.concatenate(hashed), np.concatenate(parts), np.concatenate(flags), np.concatenate(counted)
        names, at = np.unique(counted[:, 0], return_inverse=True)
        heavy = names[np.bincount(at, weights=counted[:, 1].astype(np.float64), minlength=len(names)) > hot]
        order = np.argsort(hashed, kind="stable")
        head, size = _heads(hashed[order])
        several = (size > 1) | np.logical_or.reduceat(flags[order], head)  # a hash comes once from a group
        keep = order[np.repeat(several, size)]
        is_hot = np.isin(hashed[keep], heavy)
        rows = []
        for name in np.unique(parts[keep]).tolist():
            own = parts[keep] == name
            plain, split = hashed[keep[own & ~is_hot]], hashed[keep[own & is_hot]]
            rows.append((name, np.array([key[0].as_py(), len(plain)], dtype=np.int64).tobytes() + _five(plain) + _five(split)))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _among(wanted: np.ndarray, low: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low if len(wanted) else np.zeros(len(low), dtype=bool)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of ``size`` bytes at ``a`` and at ``b`` are the same, byte by byte."""
    out = np.ones(len(a), dtype=bool)
    step = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + _SLICE, side="right")))
        differs = raw[tb.ranges(a[lo:hi], size[lo:hi])] != raw[tb.ranges(b[lo:hi], size[lo:hi])]
        out[lo:hi][np.repeat(np.arange(hi - lo), size[lo:hi])[differs]] = False
        lo = hi
    return out


def _send(buckets: int, groups: int):
    """Per group: its pieces under repeated hashes, one of each content with its bytes (kind 0); copies settled here (kind 2)."""

    def run(key, docs, answers):
        rows: list[tuple[int, int, bytes]] = []
        plain, split = ([np.zeros(0, dtype=tb.U64) for _ in range(buckets)] for _ in range(2))
        for payload in answers.column("payload").to_pylist():
            k, n = np.frombuffer(payload, dtype=np.int64, count=2).tolist()
            own = _from_five(np.frombuffer(payload, dtype=np.uint8, offset=16))
            plain[k], split[k] = np.sort(own[:n]), np.sort(own[n:])
        if docs.num_rows and answers.num_rows:
            ids = docs.column("doc_id").to_numpy().astype(np.int64)
            buf, off = tb.flat(docs.column("text"))
            hashed, row, start, count = pieces(buf, off)
            kept, hot = [], []
            for k, at in _split(_bucket_of(hashed, buckets), buckets):
                low = hashed[at] & _LOW
                kept.append(at[_among(plain[k], low)])
                hot.append(at[_among(split[k], low)])
            kept, hot = (np.sort(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for x in (kept, hot))
            size = count + LENGTH - 1
            if len(hot):  # window by window
                first, n = start[hot], count[hot]
                row, start = np.concatenate((row[kept], np.repeat(row[hot], n))), np.concatenate((start[kept], tb.ranges(first, n)))
                size = np.concatenate((size[kept], np.full(len(row) - len(kept), LENGTH)))
                windows = np.concatenate((np.zeros(len(kept), dtype=bool), np.ones(len(row) - len(kept), dtype=bool)))
                hashed = np.concatenate((hashed[kept], np.zeros(len(row) - len(kept), dtype=tb.U64)))
                order = np.argsort(row, kind="stable")
                row, start, size, windows, hashed = row[order], start[order], size[order], windows[order], hashed[order]
            else:
                hashed, row, start, size = hashed[kept], row[kept], start[kept], size[kept]
                windows = np.zeros(len(row), dtype=bool)
            content = _contents(buf, off, row, start, size)
            hashed = np.where(windows, tb.splitmix(content), hashed)
            bucket, doc, place = _bucket_of(hashed, buckets), ids[row], off[row] + start
            if len(row):
                order = np.lexsort((doc, size, content))
                same = np.concatenate(([False], (content[order][1:] == content[order][:-1]) & (size[order][1:] == size[order][:-1])))
                lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = same & (doc[order] > doc[lead])
                later[later] = _equal(buf, place[order[later]], place[lead[later]], size[order[later]])
                gone, sent = order[later], np.sort(order[~later])
                rows += _spans(doc[gone], start[gone], start[gone] + size[gone], groups)
                for k, at in _split(bucket[sent], buckets):
                    at = sent[at]
                    rows.append((k, 0, _squeezed(_pack(doc[at], start[at].astype(np.int32), size[at].astype(np.uint16)) + _five(hashed[at]) + buf[tb.ranges(place[at], size[at])].tobytes())))
        tb.release()
        return pa.Table.from_batches([_batch(rows)])

    return run


def _rows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return order, ids[order]


def _expand(order: np.ndarray, sorted_ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into doc, row) for every row that has the id."""
    lo, hi = np.searchsorted(sorted_ids, doc), np.searchsorted(sorted_ids, doc, side="right")
    return np.repeat(np.arange(len(doc)), hi - lo), order[tb.ranges(lo, hi - lo)]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> list[tuple[int, int, bytes]]:
    doc, start, end = tb.merge_intervals(doc, start, end)
    return [(-1 - k, 2, _pack(doc[at], start[at].astype(np.int32), end[at].astype(np.int32))) for k, at in _split(_group_of(doc, groups), groups)]


def _refine(order: np.ndarray, group: np.ndarray, key_at, depth: int) -> np.ndarray:
    """Sort ``order`` by successive 8-byte keys, ties only, down to ``depth`` bytes."""
    for at in range(0, depth, 8):
        tied = np.zeros(len(order), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = key_at(order[where], at)
        by = np.lexsort((key, group[where]))
        order[where] = order[where][by]
        key = key[by]
        rank = group[where]
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])))
        # a group's number is the place of its first member, so that refined groups stay ordered
        group[where] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
    return order


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes (0 is the terminator of a piece).

    Two stages: suffixes smaller than their successors are sorted directly,
    bucket scans over the first bytes induce the others from them.  ``wanted``
    marks the suffixes that are asked for; only they, and those that induce
    them, are sorted and returned.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    following = np.concatenate((text[1:], [0])).astype(np.int16)
    own = text.astype(np.int16)
    # larger than the successor (stage two), resolved from the right over runs of one byte; the last suffix counts as larger
    differs = own != following
    differs[-1] = True
    places = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    larger = own[nearest] > following[nearest]
    larger[nearest == n - 1] = True
    used = np.ones(n, dtype=bool)
    if wanted is not None:  # a wanted suffix is induced along its successors, up to the first one sorted directly
        anchor = np.minimum.accumulate(np.where(larger, n - 1, np.arange(n))[::-1])[::-1]
        cover = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(wanted)
        np.add.at(cover, at, 1)
        np.add.at(cover, anchor[at] + 1, -1)
        used = np.cumsum(cover[:n]) > 0
    padded = np.concatenate((text, np.zeros(depth + 8, dtype=np.uint8)))
    shifts = (tb.U64(56) - np.arange(8, dtype=tb.U64) * tb.U64(8))

    def key_at(at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=tb.U64)
        for b in range(8):
            out |= padded[np.minimum(at + k + b, n + depth)].astype(tb.U64) << shifts[b]
        return out

    direct = np.flatnonzero(~larger & used)
    larger &= used
    first = key_at(direct, 0)
    by = np.argsort(first, kind="stable")
    direct, first = direct[by], first[by]
    group = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(direct) else np.zeros(0, dtype=np.int64)
    if len(direct):
        group = np.repeat(group, np.diff(np.concatenate((group, [len(direct)]))))
    direct = _refine(direct, group, lambda at, k: key_at(at, k + 8), depth - 8)
    direct_of = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, dtype=np.int64)

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if used[n - 1]:
        induced[int(text[n - 1])].append(np.array([n - 1]))  # its successor is the empty suffix, smaller than all
    done: list[np.ndarray] = []
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        own_bucket = []
        while len(level):  # suffixes of this bucket induced by the bucket itself: runs of one byte
            own_bucket.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & larger[before]]
        bucket = np.concatenate([*own_bucket, direct[direct_of[c] : direct_of[c + 1]]]) if own_bucket else direct[direct_of[c] : direct_of[c + 1]]
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            for k, at in _split(text[before].astype(np.int64), 256):
                induced[k].append(before[at])
    return np.concatenate(done)


def repeated(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Group numbers along ``sa``: neighbours with a common prefix of ``length`` bytes or more share one."""
    padded = np.concatenate((text, np.zeros(length + 8, dtype=np.uint8)))
    same = np.ones(max(len(sa) - 1, 0), dtype=bool)
    for k in range(length):
        at = np.flatnonzero(same)
        if not len(at):
            break
        same[at] = padded[sa[at] + k] == padded[sa[at + 1] + k]
    return np.concatenate(([0], np.cumsum(~same)))


def _lost(doc: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray, groups: int) -> list[tuple[int, int, bytes]]:
    """Runs that documents lose to equal windows of other pieces: suffix sort, common prefixes, smallest ids."""
    begin = np.cumsum(size) - size
    # distinct contents, each with its smallest id; equal by their bytes, not by a hash
    hashed = tb.span_hash(tb.prefix(raw), begin, begin + size)
    order = np.lexsort((doc, size, hashed))
    same = np.concatenate(([False], (hashed[order][1:] == hashed[order][:-1]) & (size[order][1:] == size[order][:-1])))
    at = np.flatnonzero(same)
    same[at] = _equal(raw, begin[order[at]], begin[order[at - 1]], size[order[at]])
    new = ~same
    content = np.empty(len(doc), dtype=np.int64)
    content[order] = np.cumsum(new) - 1
    lead = order[new]
    # terminated texts of the distinct pieces; byte values move up by one, 255 stays (it is no UTF-8 byte)
    edge = np.concatenate(([0], np.cumsum(size[lead] + 1)))
    text = np.zeros(int(edge[-1]), dtype=np.uint8)
    text[tb.ranges(edge[:-1], size[lead])] = raw[tb.ranges(begin[lead], size[lead])] + np.uint8(1)
    owner = np.repeat(np.arange(len(lead)), size[lead] + 1)
    wanted = np.arange(len(text)) - edge[owner] + LENGTH <= size[lead][owner]
    sa = suffix_array(text, LENGTH, wanted)
    sa = sa[wanted[sa]]
    group = repeated(text, sa, LENGTH)
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[lead][owner[sa]])
    claim = np.full(len(text), np.iinfo(np.int64).max)
    claim[sa] = least[group]
    # every occurrence of every content against the claims of its windows
    windows = size - LENGTH + 1
    at = tb.ranges(edge[content], windows)
    who = np.repeat(np.arange(len(doc)), windows)
    lost = claim[at] < doc[who]
    who, place = who[lost], (at - edge[content[who]])[lost]
    return _spans(doc[who], start[who] + place, start[who] + place + LENGTH, groups) if len(who) else []


def _judge(groups: int):
    """Per bucket: two-stage suffix sort of the distinct pieces, then the byte runs that each document loses."""

    def run(key, table):
        if key[0].as_py() < 0:
            return pa.table({"part": pa.array([-1 - key[0].as_py()] * table.num_rows, pa.int64()), "payload": table.column("payload").combine_chunks()})
        parts = [_unpack(_unsqueezed(p), np.int64, np.int32, np.uint16) for p in table.column("payload").to_pylist()]
        doc, start, size = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(3))
        hashed = np.concatenate([_from_five(p[3][: 5 * len(p[0])]) for p in parts])
        raw = np.concatenate([p[3][5 * len(p[0]) :] for p in parts])
        del parts
        begin = np.cumsum(size) - size
        # equal windows share a hash, so runs of whole hashes are sorted one after another in bounded memory
        order = np.argsort(hashed, kind="stable")
        total = np.cumsum(size[order])
        last = np.concatenate((hashed[order][1:] != hashed[order][:-1], [True]))
        rows: list[tuple[int, int, bytes]] = []
        at = 0
        for end in (np.flatnonzero(last) + 1).tolist():
            if end == len(order) or total[end - 1] - (total[at - 1] if at else 0) >= _SORTED:
                own = order[at:end]
                rows += _lost(doc[own], start[own], size[own], raw[tb.ranges(begin[own], size[own])], groups)
                at = end
        tb.release()
        return pa.table({"part": pa.array([-1 - k for k, _, _ in rows], pa.int64()), "payload": pa.array([p for _, _, p in rows], pa.binary())})

    return run


def _finish(carried: list[str]):
    """Per group of documents: union of the lost runs and what is left of each text."""

    def run(key, docs, spans):
        ids = docs.column("doc_id").to_numpy().astype(np.int64)
        buf, off = tb.flat(docs.column("text"))
        parts = [_unpack(p, np.int64, np.int32, np.int32) for p in spans.column("payload").to_pylist()]
        lost: dict[int, list[tuple[int, int]]] = {}
        if parts and len(ids):
            doc, start, end = tb.merge_intervals(*(np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(3)))
            index, row = _expand(*_rows_of(ids), doc)
            for r, a, b in zip(row.tolist(), start[index].tolist(), end[index].tolist(), strict=True):
                lost.setdefault(r, []).append((a, b))
        kept = _kept(buf, off, lost)
        out = {c: docs.column(c) for c in carried}
        if "text" in carried:
            out["text"] = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string())
        out["n_bytes"] = pa.array(np.diff(off), pa.int64())
        out["spans"] = pa.array([[{"start": a, "end": b} for a, b in lost.get(r, ())] for r in range(len(ids))], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        out["kept"] = pa.array(kept, pa.binary())
        tb.release()
        return pa.table(out)

    return run


def _kept(buf: np.ndarray, off: np.ndarray, lost: dict[int, list[tuple[int, int]]]) -> list[bytes]:
    out = []
    for r in range(len(off) - 1):
        raw, at, left = buf[off[r] : off[r + 1]].tobytes(), 0, []
        for a, b in lost.get(r, ()):
            left.append(raw[at:a])
            at = b
        out.append(b"".join([*left, raw[at:]]))
    return out


def suffix_dedup(docs: DataFrame, *, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text, more) with the text that is left (whole characters only), n_bytes, spans (the lost byte runs) and kept (the bytes that stay)."""
    docs = docs.drop("part", "n_bytes", "spans", "kept")
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    done = _through(plain, _finish(plain.columns), f"{fields}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary", group_bytes, bucket_bytes, hot)
    text = F.coalesce("text", F.lit(""))
    none = plain.where("doc_id is null").withColumns({"text": text, "n_bytes": F.octet_length(text).cast("long"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "kept": text.cast("binary")})
    return done.unionByName(none)


def _through(docs: DataFrame, last, schema: str, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """All steps on the rows with an id; ``last`` gets each group's documents and lost runs."""
    groups, buckets = buckets_for(docs, group_bytes, bucket_bytes)
    grouped = docs.where("doc_id is not null").withColumn("part", _group_column(groups)).groupBy("part")
    answers = grouped.applyInArrow(_announce(buckets), "bucket long, part long, payload binary").groupBy("bucket").applyInArrow(_answer(hot), "part long, payload binary")
    sent = grouped.cogroup(answers.groupBy("part")).applyInArrow(_send(buckets, groups), _SCHEMA)
    spans = sent.groupBy("bucket").applyInArrow(_judge(groups), "part long, payload binary")
    return grouped.cogroup(spans.groupBy("part")).applyInArrow(last, schema)


def _group_column(groups: int):
    """``_group_of`` of the id column."""

    @F.pandas_udf("long")
    def group(ids: pd.Series) -> pd.Series:
        return pd.Series(_group_of(ids.to_numpy(), groups))

    return group("doc_id")


def _digest_group(key, docs, spans):
    t = _finish(["doc_id"])(key, docs, spans)
    runs = t.column("spans").to_pylist()
    return pa.table({
        "doc_id": t.column("doc_id"),
        "n_bytes": t.column("n_bytes"),
        "n_removed": pa.array([sum(s["end"] - s["start"] for s in r) for r in runs], pa.int64()),
        "n_spans": pa.array([len(r) for r in runs], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in t.column("kept").to_pylist()], pa.string()),
    })


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: the last step hashes what is left instead of returning it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = _through(docs, _digest_group, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    none = docs.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return done.unionByName(none)


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """Reference answer by a table of all windows, for tests."""
    least: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, b in raw.items():
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        keep = np.frombuffer(b, dtype=np.uint8)[~gone[: len(b)]].tobytes()
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest())
    return out
