"""SentencePiece encoding and decoding by suffix-array matching.

For a BPE piece model with byte fallback (identity normaliser, dummy prefix):

1. Text splits exactly where no piece can cross: before a run of spaces, and at
   characters that no piece holds (line feeds).  The distinct units of a batch
   are concatenated into one text.
2. Its suffix array (two-stage sort, to the longest piece) is searched by
   bisection for every piece; each gives its range of occurrences.
3. The occurrences become edges (place, length, piece), sorted by place.
4. Relaxation: in every unit the adjacent pair of symbols with the best edge
   over both is merged, until no edge spans a pair; that is the model's own
   merge order.  Symbols without a piece fall back to bytes.

Every run of documents is indexed anew: nothing is remembered from run to run.
Units are relaxed side by side; units of more than 64 characters (text without
spaces) take the same merges from a heap over the same edges, as a round of all
units for each merge of the longest would be slow.

Decoding maps ids to piece bytes and spaces and drops the dummy prefix; every
row is decoded again and compared with its text.  The model file is read by the
driver and sent to the workers.

Defined results: null and empty texts have no ids and round-trip to empty; a
U+2581 in the text is the model's space and comes back as one, as in the
sentencepiece library; pairs of one rank merge from the left; repeated rows keep
their row; a text longer than a run is a run of its own, its units are indexed in
bounded parts; an empty table gives no rows; extra columns pass through, columns
named n_tokens, ids, ids_sha256 or round_trip are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import spread
from .suffix_dedup import suffix_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_LONG, _BATCH_BYTES = 64, 1 << 20
#: Text of the distinct units that are indexed at once; edges take several hundred bytes for each byte of it.
_INDEX_BYTES = 128 << 10
#: Bits of a piece's id in a sorted edge; with 6 bits of length they leave 37 for the place.
_PIECE_BITS = 20


class Model:
    """Pieces of a model file: bytes with real spaces, ranks and byte ids."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        if self.size >= 1 << _PIECE_BITS:
            raise ValueError("too many pieces")
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, dtype=np.int64)
        ids = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                ids.append(i)
        if any(" " in self.bytes[i].decode().lstrip(" ") for i in ids):
            raise ValueError("a piece crosses a space")
        self.ids = np.array(ids)
        self.rank = np.array([-sp.get_score(i) for i in range(self.size)])
        self.length = np.array([len(b) for b in self.bytes])
        self.longest = int(self.length[self.ids].max())
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.begin = np.cumsum(self.length) - self.length
        self.breaks = not any(b"\n" in self.bytes[i] for i in ids)
        words = -(-self.longest // 8)
        self.low = np.array([_words(self.bytes[i], words, 0) for i in ids], dtype=tb.U64)
        self.high = np.array([_words(self.bytes[i], words, 255) for i in ids], dtype=tb.U64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, the dummy prefix included."""
        return self.flat[tb.ranges(self.begin[ids], self.length[ids])]


def _words(piece: bytes, n: int, fill: int) -> list[int]:
    padded = piece + bytes([fill]) * (8 * n - len(piece))
    return [int.from_bytes(padded[8 * k : 8 * k + 8], "big") for k in range(n)]


@cache
def model(proto: bytes) -> Model:
    return Model(proto)


def load(path: str = MODEL) -> bytes:
    """The model file, for the driver to send on."""
    with open(path, "rb") as f:
        return f.read()


def _bisect(columns, n: int, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Places of rows of big-endian words among n sorted suffixes (``columns(at, k)``: their k-th word)."""
    lo, hi = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), n, dtype=np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less, open_ = np.zeros(len(wanted), dtype=bool), lo < hi
        tie = open_.copy()
        for k in range(wanted.shape[1]):
            at = np.flatnonzero(tie)
            if not len(at):
                break
            have = columns(mid[at], k)
            less[at[have < wanted[at, k]]] = True
            tie[at] = have == wanted[at, k]
        less |= tie & right
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def edges(own: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place << 6 | length, piece id) of every occurrence of every piece in ``text``, sorted by place."""
    starts = (text & 0xC0) != 0x80
    sa = suffix_array(text, own.longest, starts & (text != 255))
    sa = sa[(starts & (text != 255))[sa]]
    if not len(sa):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    padded = np.concatenate((text, np.zeros(own.longest + 16, dtype=np.uint8)))

    def columns(at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=tb.U64)
        for b in range(8):
            out = out << tb.U64(8) | padded[sa[at] + 8 * k + b].astype(tb.U64)
        return out

    first = columns(np.arange(len(sa)), 0)
    lo, hi = np.searchsorted(first, own.low[:, 0]), np.searchsorted(first, own.high[:, 0], side="right")
    long = np.flatnonzero((own.length[own.ids] > 8) & (hi > lo))
    if len(long):
        lo[long] = _bisect(columns, len(sa), own.low[long], False)
        hi[long] = _bisect(columns, len(sa), own.high[long], True)
    count = hi - lo
    place = sa[tb.ranges(lo, count)]
    piece = np.repeat(own.ids, count)
    # place, length and piece in one number each, so that they are sorted together
    both = np.sort((place << 6 | own.length[piece]) << _PIECE_BITS | piece)
    return both >> _PIECE_BITS, both & ((1 << _PIECE_BITS) - 1)


def _heap(own: Model, text: np.ndarray, place: np.ndarray, end: int, key: np.ndarray, piece: np.ndarray) -> list[int]:
    """Ids of one long unit (places of its characters, its end): the same merges from a heap over its edges."""
    lo, hi = np.searchsorted(key, (place[0] << 6, end << 6))
    keys, ids = memoryview(np.ascontiguousarray(key[lo:hi])), piece[lo:hi]
    rank = memoryview(own.rank[ids])
    at, length = place.tolist(), np.diff(place, append=end).tolist()
    before, after = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
    heap: list[tuple[float, int, int]] = []

    def edge(i: int, size: int) -> int:
        """Index of the edge at a symbol, -1 if there is none."""
        want = at[i] << 6 | size
        k = bisect_left(keys, want) if size < 63 else len(keys)
        return k if k < len(keys) and keys[k] == want else -1

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (k := edge(i, length[i] + length[j])) >= 0:
            heapq.heappush(heap, (rank[k], i, length[i] + length[j]))

    for i in range(len(at)):
        push(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if length[i] else -1
        if j < 0 or length[i] + length[j] != size:
            continue
        length[i], length[j] = size, 0
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out: list[int] = []
    for i, size in enumerate(length):
        if size:
            k = edge(i, size)
            out += [int(ids[k])] if k >= 0 else own.byte_id[text[at[i] : at[i] + size]].tolist()
    return out


def encode_units(own: Model, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each unit) of distinct units with real spaces."""
    size = np.array([len(u) for u in units], dtype=np.int64)
    text = np.frombuffer(b"\xff".join(units) + b"\xff", dtype=np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    chars = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 255))
    unit = np.searchsorted(begin, chars, side="right") - 1
    per = np.bincount(unit, minlength=len(units))
    short = per[unit] <= _LONG
    key, piece = edges(own, text)

    def edge(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of the edge, -1 if there is none."""
        want = at << 6 | np.minimum(length, 63)
        where = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        return np.where((key[where] == want) & (length < 63), where, -1) if len(key) else np.full(len(at), -1)

    place = chars[short]
    owner = unit[short]
    n = len(place)
    length = np.diff(np.concatenate((chars, [len(text)])))[short]
    bounds = begin[owner] + size[owner]
    length = np.minimum(length, bounds - place)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    if n:
        edge_of_unit = np.concatenate((owner[1:] != owner[:-1], [True]))
        after[edge_of_unit] = -1
        before[np.concatenate(([True], owner[1:] != owner[:-1]))] = -1
    alive = np.ones(n, dtype=bool)
    rank = np.full(n, np.inf)

    def update(at: np.ndarray) -> None:
        nxt = after[at]
        has = nxt >= 0
        rank[at] = np.inf
        at, nxt = at[has], nxt[has]
        found = edge(place[at], length[at] + length[nxt])
        good = found >= 0
        rank[at[good]] = own.rank[piece[found[good]]]

    update(np.arange(n))
    live = np.flatnonzero(np.isfinite(np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))))[np.cumsum(np.concatenate(([True], owner[1:] != owner[:-1]))) - 1])) if n else np.zeros(0, dtype=np.int64)
    while len(live):
        own_rank, own_unit = rank[live], owner[live]
        head = np.flatnonzero(np.concatenate(([True], own_unit[1:] != own_unit[:-1])))
        least = np.minimum.reduceat(own_rank, head)
        width = np.diff(np.concatenate((head, [len(live)])))
        best = np.flatnonzero((own_rank == np.repeat(least, width)) & np.isfinite(own_rank))
        if not len(best):
            break
        best = best[np.concatenate(([True], own_unit[best][1:] != own_unit[best][:-1]))]  # leftmost
        at = live[best]
        gone = after[at]
        length[at] += length[gone]
        after[at] = after[gone]
        alive[gone] = False
        rank[gone] = np.inf
        follow = after[at]
        before[follow[follow >= 0]] = at[follow >= 0]
        prev = before[at]
        update(np.concatenate((at, prev[prev >= 0])))
        # units without a merge left, and symbols that are gone, leave the loop
        open_ = np.repeat(np.isfinite(least), width) & alive[live]
        live = live[open_]
    symbol = np.flatnonzero(alive)
    found = edge(place[symbol], length[symbol])
    count = np.where(found >= 0, 1, length[symbol])
    ids = np.empty(int(count.sum()), dtype=np.int32)
    at = np.cumsum(count) - count
    ids[at[found >= 0]] = piece[found[found >= 0]]
    fall = found < 0
    ids[tb.ranges(at[fall], count[fall])] = own.byte_id[text[tb.ranges(place[symbol][fall], count[fall])]]
    total = np.bincount(owner[symbol], weights=count, minlength=len(units)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(total)))
    long = np.flatnonzero(per > _LONG)
    if len(long):
        head_of = np.concatenate(([0], np.cumsum(per)))  # first character of each unit
        parts, at, new = [], 0, total.copy()
        for u in long.tolist():
            own_ids = np.array(_heap(own, text, chars[head_of[u] : head_of[u + 1]], int(begin[u] + size[u]), key, piece), dtype=np.int32)
            parts += [ids[first[at] : first[u]], own_ids]
            new[u] = len(own_ids)
            at = u + 1
        ids = np.concatenate([*parts, ids[first[at] :]])
        first = np.concatenate(([0], np.cumsum(new)))
    return ids, first


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each unit, unit of each place): units are equal by their bytes and by whether they lead a document."""
    hashed = tb.span_hash(tb.prefix(buf), start, end) ^ np.where(lead, tb.U64(0x9E3779B97F4A7C15), tb.U64(0))
    _, sample, unit = np.unique(hashed, return_index=True, return_inverse=True)
    size, like = end - start, sample[unit]
    odd = (size != size[like]) | (lead != lead[like])
    at = np.flatnonzero(~odd)
    differs = buf[tb.ranges(start[at], size[at])] != buf[tb.ranges(start[like[at]], size[at])]
    odd[at[np.repeat(np.arange(len(at)), size[at])[differs]]] = True
    if odd.any():  # of one hash, yet not equal: units of their own
        own = np.flatnonzero(odd)
        unit[own] = len(sample) + np.arange(len(own))
        sample = np.concatenate((sample, own))
    return sample, unit


def encode_run(own: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each document) of a run of documents (flat UTF-8 bytes without U+2581)."""
    n = len(buf)
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(len(off), dtype=np.int64)
    space = buf == 32
    head = space & ~np.concatenate(([False], space[:-1]))
    if own.breaks:
        line = buf == 10
        head |= line
        head[1:] |= line[:-1]
    head = np.concatenate((head, [True]))
    head[off] = True
    start = np.flatnonzero(head)
    end, start = start[1:], start[:-1]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    leads = np.zeros(n + 1, dtype=bool)
    leads[off[:-1]] = True
    lead, raw = leads[start], buf.tobytes()
    sample, unit = _distinct(buf, start, end, lead)
    units = [(b" " if first else b"") + raw[a:b] for a, b, first in zip(start[sample].tolist(), end[sample].tolist(), lead[sample].tolist(), strict=True)]
    size = np.concatenate(([0], np.cumsum([len(u) + 1 for u in units])))
    parts = [encode_units(own, units[i:j]) for i, j in tb.slices(size, _INDEX_BYTES)]
    ids = np.concatenate([p for p, _ in parts])
    count = np.concatenate([np.diff(f) for _, f in parts])
    first = np.cumsum(count) - count
    out = ids[tb.ranges(first[unit], count[unit])]
    return out, np.concatenate(([0], np.cumsum(np.bincount(doc, weights=count[unit], minlength=len(off) - 1).astype(np.int64))))


def _plain(column: pa.Array) -> pa.Array:
    return pc.replace_substring(column, SPACE, " ")


def round_trips(own: Model, ids: np.ndarray, first: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each document's decoded ids are its text."""
    raw = own.decode(ids)
    edge = np.concatenate(([0], np.cumsum(own.length[ids])))[first]
    size = np.diff(off)
    same = np.diff(edge) == size + (size > 0)
    at = edge[:-1] + (size > 0)  # past the dummy prefix
    good = np.flatnonzero(same & (size > 0))
    differs = raw[tb.ranges(at[good], size[good])] != buf[tb.ranges(off[good], size[good])]
    bad = np.unique(np.repeat(good, size[good])[differs])
    same[bad] = False
    return same


def _encoding(shared, carried: list[str], fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in batches:
            text = batch.column("text")
            size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for i, j in tb.slices(size, _BATCH_BYTES):  # each slice leaves before the next is read
                buf, off = tb.flat(_plain(text.slice(i, j - i)))
                ids, first = encode_run(own, buf, off)
                new = {"n_tokens": pa.array(np.diff(first), pa.int64())}
                if fold:
                    raw = ids.astype("<i4").tobytes()
                    new["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string())
                else:
                    new["ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield tb.extend(batch.slice(i, j - i), carried, **new, round_trip=pa.array(round_trips(own, ids, first, buf, off), pa.bool_()))

    return run


def encode(docs: DataFrame, *, path: str = MODEL, fold: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids and round_trip; ``fold`` gives ids_sha256 (of little-endian int32 ids) for ids and drops the text."""
    docs = spread(docs.drop("n_tokens", "ids", "ids_sha256", "round_trip"))
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    carried = [c for c in docs.columns if not (fold and c == "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in carried)
    return docs.mapInArrow(tb.trimmed(_encoding(shared, carried, fold)), f"{fields}, n_tokens long, {'ids_sha256 string' if fold else 'ids array<int>'}, round_trip boolean")


def decode(rows: DataFrame, *, path: str = MODEL) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids``; null ids give null, ids outside the model are left out."""
    rows = rows.drop("text")
    carried = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                raw = own.decode(np.array([i for i in ids if i is not None and 0 <= i < own.size], dtype=np.int64)).tobytes()
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield tb.extend(batch, carried, text=pa.array(texts, pa.string()))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(tb.trimmed(run), f"{fields}text string")


def digest(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", F.col("text")), fold=True)
