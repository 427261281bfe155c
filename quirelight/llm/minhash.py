"""Near-duplicate detection with HyperMinHash registers.

A document's five-word shingles are hashed once.  The first bits of a hash name
one of 128 buckets; of each bucket's smallest hash the register keeps the count
of leading zeros and ten mantissa bits (16 bits in all).  Empty buckets borrow
from seeded donors, so that short documents band as well as long ones.

1. Documents with the same word sequence form one class (128-bit digest); only
   one representative each goes on, so groups of copies cost one row.
2. 25 bands of five registers are grouped; each member of a band is paired with
   the band's smallest id (linear in the band, whatever its size).
3. Pairs whose collision-corrected estimate is far under the threshold are
   dropped, unless one text has so few shingles that its registers are no
   independent ones; the rest are confirmed on the full shingle sets of both texts.
4. Links become components by large-star/small-star rounds.
5. Bands that still hold several components give the pairs *between* those
   components, which are estimated and confirmed the same way; then 4 again.
   In bands of more than 64 members those outside the largest component are
   compared with all, block against block inside tasks of bounded size (so a
   component of any size is read once for each block of strays): estimates first,
   on codes alone; then, for the members that have a partner by estimate, exact
   intersections as products of incidence matrices, each pair only in the first
   band it shares, and only links that join two components leave the task.

A pair at Jaccard 0.85 shares no band with probability (1 - 0.85**5)**25 = 4e-7.
No all-pairs expansion inside a component, no cap on bands or candidates.

Defined results: null and empty texts (or texts without words) have an empty set
and link with nothing; fewer than five words make one shingle; a null id takes
part in no link (component null, kept); repeated rows give repeated results;
``doc_id`` identifies a text; ties in a bucket are one value; very long texts are
a run of their own; an empty table gives no rows; extra columns are ignored.
Set sizes and confirmations count 64-bit hashes of shingles, of which a run of
many short documents keeps the upper 48 to 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .storage import dropped, may_contain, spread, written

SHINGLE, REGISTERS, BANDS, ROWS, MANTISSA = 5, 128, 25, 5, 10
PERCENT = 85
#: Estimates under the threshold by more than this are not confirmed: over six standard deviations of 128 registers ...
MARGIN = 0.20
#: ... where both texts have as many shingles as this; smaller sets fill few registers, and all their pairs are confirmed.
FULL = 64
#: Bands with more members than this are compared in blocks; members and shingles of a block.
JOINED, BLOCK, BLOCK_SHINGLES = 64, 256, 1 << 18
_VALUE_BITS = 48 - 7


def shingles(buf: np.ndarray, off: np.ndarray, bits: int | None = None) -> tuple[tb.Words, np.ndarray, np.ndarray, int]:
    """(words, word hashes, sorted distinct shingle keys, bits) of a run of documents.

    A key is the document in the upper ``bits`` bits (as few as the run needs, so none in a very long document, which is
    a run of its own) and the upper bits of the shingle's 64-bit hash under them.
    """
    bits = (len(off) - 2).bit_length() if bits is None else bits
    low = tb.LOWER[buf]
    w = tb.words(low, off, tb.NONSPACE)
    hashed = tb.span_hash(tb.prefix(low), w.start, w.end) if len(w) else np.zeros(0, dtype=tb.U64)
    at = tb.within(w, SHINGLE)
    docs, values = [w.doc[at]], [tb.gram_hash(hashed, SHINGLE)[at]]
    for c in range(1, SHINGLE):
        own = np.flatnonzero(w.counts == c)
        if len(own):
            docs.append(own)
            values.append(tb.gram_hash(hashed, c)[w.first[own]])
    keys = np.concatenate(values) >> tb.U64(bits)
    if bits:
        keys |= np.concatenate(docs).astype(tb.U64) << tb.U64(64 - bits)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return w, hashed, keys, bits


def owners(keys: np.ndarray, bits: int) -> np.ndarray:
    """Document of each key."""
    return (keys >> tb.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def sizes(keys: np.ndarray, bits: int, n_docs: int) -> np.ndarray:
    """Number of keys of each document."""
    return np.bincount(owners(keys, bits), minlength=n_docs)


@cache
def _donors() -> np.ndarray:
    return np.random.default_rng(7).integers(0, REGISTERS, (96, REGISTERS))


def registers(keys: np.ndarray, bits: int, n_docs: int) -> np.ndarray:
    """n_docs x REGISTERS codes (leading zeros << MANTISSA | mantissa) of sorted shingle keys; rows without shingles are empty."""
    out = np.full((n_docs, REGISTERS), 0xFFFF, dtype=np.uint16)
    if not len(keys):
        return out
    hashed = keys << tb.U64(bits)
    cell = owners(keys, bits) * REGISTERS + (hashed >> tb.U64(57)).astype(np.int64)
    head = np.concatenate(([True], cell[1:] != cell[:-1]))  # sorted: the first of a bucket is its smallest
    value = (hashed[head] >> tb.U64(16) & tb.U64((1 << _VALUE_BITS) - 1)).astype(np.float64)
    fraction, length = np.frexp(value)
    zeros = np.where(value > 0, _VALUE_BITS - length, _VALUE_BITS)
    mantissa = np.where(value > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out.reshape(-1)[cell[head]] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    filled = out != 0xFFFF
    rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    for donor in _donors():
        if not len(rows):
            break
        need = (out[rows] == 0xFFFF) & filled[np.ix_(rows, donor)]
        r, c = np.nonzero(need)
        out[rows[r], c] = out[rows[r], donor[c]]  # a bucket filled from the start; borrowed codes are not lent on
        rows = rows[(out[rows] == 0xFFFF).any(axis=1)]
    for shift in range(1, REGISTERS):
        if not len(rows):
            break
        donor = (np.arange(REGISTERS) + shift) % REGISTERS
        r, c = np.nonzero((out[rows] == 0xFFFF) & filled[np.ix_(rows, donor)])
        out[rows[r], c] = out[rows[r], donor[c]]
        rows = rows[(out[rows] == 0xFFFF).any(axis=1)]
    return out


@cache
def collision_rates() -> np.ndarray:
    """Chance that two registers of unequal minima get one code, by the binary orders of magnitude of both bucket loads."""
    zeros = np.arange(_VALUE_BITS + 1)
    loads = 2.0 ** np.arange(-6, 22)
    cells = []
    for k in loads:
        low = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in zeros])
        width = np.concatenate([np.full(1 << MANTISSA, 2.0 ** -(z + 1) / (1 << MANTISSA)) for z in zeros])
        cells.append(np.exp(k * np.log1p(-np.minimum(low, 1 - 1e-12))) - np.exp(k * np.log1p(-np.minimum(low + width, 1 - 1e-12))))
    cells = np.array(cells)
    return cells @ cells.T


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    load = lambda n: np.clip(np.round(np.log2(np.maximum(n, 1) / REGISTERS)) + 6, 0, 27).astype(np.int64)
    chance = collision_rates()[load(n_a), load(n_b)]
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def promising(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs of register rows are to be confirmed."""
    least = np.minimum(n_a, n_b)
    return (100 * least >= PERCENT * np.maximum(n_a, n_b)) & ((least < FULL) | (estimate(a, b, n_a, n_b) >= PERCENT / 100 - MARGIN))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tb.flat(batch.column(1))
        counts, digests, codes = [], [], []
        for i, j in tb.slices(off):
            w, hashed, keys, bits = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            counts.append(sizes(keys, bits, j - i))
            codes.append(registers(keys, bits, j - i))
            both = []
            for salt in (1, 2):
                powers, inverses = tb._grow(len(hashed))
                total = np.concatenate((np.zeros(1, dtype=tb.U64), np.cumsum(tb.splitmix(hashed + tb.U64(salt)) * powers[: len(hashed)], dtype=tb.U64)))
                both.append(tb.splitmix((total[w.first[1:]] - total[w.first[:-1]]) * inverses[w.first[:-1]] + w.counts.astype(tb.U64)))
            digests.append(np.stack(both, axis=1))
        n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        empty = n == 0
        fixed = lambda rows, width: pa.array([None if e else r for e, r in zip(empty, _rows(rows, width), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), fixed(digests, 16), fixed(codes, 2 * REGISTERS)], names=["doc_id", "n_shingles", "digest", "codes"])


def _rows(parts: list[np.ndarray], width: int) -> list[bytes]:
    raw = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return [raw[k : k + width] for k in range(0, len(raw), width)]


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        side = [np.frombuffer(tb.flat(batch.column(c))[0], dtype=np.uint16).reshape(-1, REGISTERS) for c in ("codes_a", "codes_b")]
        keep = promising(*side, *(batch.column(c).to_numpy() for c in ("n_a", "n_b")))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (buf_a, off_a), (buf_b, off_b) = tb.flat(batch.column("text_a")), tb.flat(batch.column("text_b"))
            keep = []
            for i, j in tb.slices(off_a + off_b):
                bits = (j - i - 1).bit_length()
                keys = [shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], bits)[2] for buf, off in ((buf_a, off_a), (buf_b, off_b))]
                both, left, right = (sizes(k, bits, j - i) for k in (np.intersect1d(*keys, assume_unique=True), *keys))
                keep.append(100 * both >= percent * (left + right - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return run


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable.  Large-star and small-star rounds; nothing is collected.

    The smallest neighbours are written before edges are joined with them: both sides are then plain exchanges, so that
    adaptive execution splits the edges of a node that holds a large part of all.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = state(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), name)
        dropped(edges)
        dropped(nearest)
        edges = after
        now = state(edges)
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _bands(nodes: DataFrame) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("codes", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])
    return nodes.select("node", F.posexplode(keys).alias("band_no", "band"))


def _intersections(texts: pa.Array, left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the common shingle sets, left x right, as products of incidence matrices over shingles that two texts share."""
    buf, off = tb.flat(texts)
    owner, value = [], []
    runs = list(tb.slices(off))
    bits = max(j - i - 1 for i, j in runs).bit_length()  # the same for all, so that their hashes compare
    for i, j in runs:
        keys = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], bits)[2]
        owner.append(owners(keys, bits) + i)
        value.append(keys << tb.U64(bits))
    owner, value = np.concatenate(owner), np.concatenate(value)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner, column = owner[count[column] > 1], shared[column[count[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        seen = np.zeros((len(texts), width), dtype=np.float32)
        seen[owner[lo:hi], column[lo:hi] - at] = 1
        out += seen[left] @ seen[right].T
    return out.astype(np.int64)


def _wanted(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of strays, rows of the members they meet, pairs to be confirmed), between components; every pair in the first band it shares."""
    ids, comp, n, asks, band = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n_shingles", "asks", "band_no"))
    codes = np.frombuffer(tb.flat(t.column("codes"))[0], dtype=np.uint16).reshape(-1, REGISTERS)
    banded = codes[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    left, right, apart = np.flatnonzero(asks), np.flatnonzero(~asks), t.column("one")[0].as_py() != t.column("two")[0].as_py()
    wanted = np.zeros((len(left), len(right)), dtype=bool)
    for k, i in enumerate(left.tolist()):
        at = np.flatnonzero((comp[right] != comp[i]) & (apart | (ids[right] > ids[i])))
        at = at[(banded[right[at]] == banded[i]).all(axis=2).argmax(axis=1) == band[0]]
        wanted[k, at] = promising(codes[right[at]], codes[i], n[right[at]], np.full(len(at), n[i]))
    return left, right, wanted


def _partners(t):
    """Members of a pair of blocks that have a partner to be confirmed in it: only their texts are fetched."""
    left, right, wanted = _wanted(t)
    keep = np.zeros(t.num_rows, dtype=bool)
    keep[left[wanted.any(axis=1)]] = True
    keep[right[wanted.any(axis=0)]] = True
    return t.filter(pa.array(keep))


def _blocks(t):
    """Links that join components, in one pair of blocks of a band."""
    ids, comp, n = (t.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    left, right, wanted = _wanted(t)
    links = []
    if wanted.any():
        both = _intersections(t.column("text"), left, right)
        x, y = np.nonzero(wanted & (100 * both >= PERCENT * (n[left][:, None] + n[right][None] - both)))
        parent = {c: c for c in comp.tolist()}

        def find(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i, k in zip(left[x].tolist(), right[y].tolist(), strict=True):
            a, b = find(int(comp[i])), find(int(comp[k]))
            if a != b:
                parent[a] = b
                links.append(sorted((int(ids[i]), int(ids[k]))))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(spread(docs).mapInArrow(tb.trimmed(_sketch), "doc_id long, n_shingles long, digest binary, codes binary"), "sketches")
    nodes = written(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("codes").alias("codes")), "nodes")

    # bands of two nodes or more, once for all that follows; the counts are written first, as the edges' neighbours are
    counted = written(_bands(nodes).groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), "counted")
    shared = written(_bands(nodes).join(counted, "band").select("band", "band_no", "node", "hub"), "shared")
    dropped(counted)
    stars = shared.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = _with_codes(stars, nodes)

    def confirm(pairs: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(tb.trimmed(_confirmed(PERCENT)), "a long, b long")

    # every node that shares a band with another one may be asked for its text; the filter's size is fixed
    linked = written(shared.select("node").distinct(), "members")
    texts = written(docs.where(may_contain(linked.withColumnRenamed("node", "doc_id"), "doc_id")).join(linked, docs.doc_id == linked.node, "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")), "texts")

    first = written(confirm(written(stars, "stars")), "links")
    label = written(components(first, "components"), "labels")
    named = nodes.join(linked, "node", "left_semi").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    placed = written(shared.select("band", "band_no", "node").join(named.select("node", "component", "n_shingles"), "node"), "placed")
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
    open_bands = shares.groupBy("band").agg(F.count("*").alias("components"), F.sum("members").alias("members"), F.sum("weight").alias("weight"), F.max(F.struct("members", "component", "weight")).alias("main")).where("components > 1")
    open_bands = written(open_bands.select("band", "members", "weight", F.col("main.component").alias("main"), F.col("main.members").alias("main_members"), F.col("main.weight").alias("main_weight")), "open")
    members = written(placed.join(open_bands, "band"), "open-members")
    few = members.where(F.col("members") <= JOINED)
    one, two = (few.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n_shingles")]) for x in "ab")
    pairs = one.join(two, "band").where(f"node_a < node_b and component_a != component_b and 100 * least(n_shingles_a, n_shingles_b) >= {PERCENT} * greatest(n_shingles_a, n_shingles_b)").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    blocks = lambda members, weight: F.ceil(F.greatest(members / BLOCK, weight / BLOCK_SHINGLES)).cast("long")
    many = members.where(F.col("members") > JOINED).withColumns({"stray": F.col("component") != F.col("main"), "mains": blocks(F.col("main_members"), F.col("main_weight")), "strays": blocks(F.col("members") - F.col("main_members"), F.col("weight") - F.col("main_weight"))})
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))))
    # a block of strays meets itself, the blocks of strays after it, and all blocks of the largest component
    several = lambda first, last: F.explode(F.sequence(first, last))
    sent = ("band", "band_no", "node", "component", "n_shingles")
    asking = many.where("stray").select(*sent, F.lit(True).alias("asks"), F.col("own").alias("one"), several(F.col("own"), F.col("strays") + F.col("mains") - 1).alias("two"))
    asked = many.where("stray").select(*sent, F.lit(False).alias("asks"), several(F.lit(0).cast("long"), F.col("own")).alias("one"), F.col("own").alias("two"))
    asked = asked.unionByName(many.where("not stray").select(*sent, F.lit(False).alias("asks"), several(F.lit(0).cast("long"), F.col("strays") - 1).alias("one"), (F.col("strays") + F.col("own")).alias("two")))
    coded = asking.unionByName(asked).join(named.select("node", "codes"), "node").select(*sent, "asks", "one", "two", "codes")
    paired = written(coded.groupBy("band", "one", "two").applyInArrow(_partners, coded.schema), "partners")
    large = paired.join(texts, F.col("node") == F.col("doc_id")).drop("doc_id").groupBy("band", "one", "two").applyInArrow(_blocks, "a long, b long")
    second = confirm(written(_with_codes(pairs, nodes), "pairs")).unionByName(large)
    final = components(first.unionByName(second), "components")

    by_digest = nodes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    out = sketches.drop("codes").join(by_digest, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_codes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose estimate comes near the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("codes").alias(f"codes_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "codes_a", "codes_b").mapInArrow(tb.trimmed(_estimated), "a long, b long")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Reference answer (set size, component) by comparing all documents that share a shingle, for tests."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(tb.NONSPACE_CANON).split()
        sets[i] = {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            owners.setdefault(g, []).append(i)
    seen: dict[tuple[int, int], int] = {}
    for own in owners.values():
        for x in range(len(own)):
            for y in range(x):
                pair = (own[y], own[x])
                seen[pair] = seen.get(pair, 0) + 1
    for (a, b), both in seen.items():
        if 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}
