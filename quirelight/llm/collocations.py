r"""Phrase collocations: candidates from sketch upper bounds, counted exactly by Aho-Corasick automata.

Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and line ends into pieces, and those at blanks into words; a
phrase is two to five words of one piece.  Everything is kept by language.

1. One pass counts single words exactly and adds every two-word phrase to a sketch: counters by hash, sparse, cut into
   blocks of 2**32 counters (a block for some 16 MB of text, so the sketch grows with the input), sorted and summed in the
   tasks before they are shuffled and by block after.  A counter is never less than the count of any phrase in it.
2. A second pass does the same for three to five words, wherever all two-word phrases inside have a counter at the
   threshold (a phrase is never more frequent than its parts).
3. Counters at the threshold become bitmaps of fixed size (16 MB; a full one lets more through, never less).  A third pass
   gives the candidates, and the stretches of text around them: maximal runs of words that candidates of one shard cover,
   equal ones of a run of texts folded with their number, a row a run and shard.  A shard holds the candidates of some first pairs of words, 10,000 or so.
4. Each shard's candidates, guarded by delimiters on both sides, become an automaton that scans the shard's stretches in
   groups of bounded size, overlapping matches included; every occurrence lies in exactly one stretch.  Sums over the
   groups are the exact counts, and only then thresholds apply.
5. Scores, drops and ranks are joins and windows on the candidates.

Hot phrases and texts that many documents repeat are folded in the tasks before anything is shuffled, and a shard's
stretches are dealt to as many groups as their bytes ask for.  No candidate is cut off: the thresholds are the contract's.

Defined results: null text is empty, null lang is ``und``; empty texts and texts without words add nothing; very long texts
are a run of their own; repeated rows count again; ties in rank go by count, then by the phrase's bytes; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import dropped, spread, written

LONGEST, LEAST, TOP = 5, 100, 2_000
#: Text bytes a sketch block stands for, candidates of a shard, bytes of stretches that one group scans, bits of a bitmap.
BLOCK_BYTES, SHARD_PHRASES, GROUP_BYTES, BITS = 16 << 20, 10_000, 16 << 20, 1 << 27
#: Counters that a task gathers before it sums and hands them on.
GATHERED = 2 << 20

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[10, 11, 12, 13, *b".,;:!?"]] = True
_WORD = ~_EDGE
_WORD[[9, 32]] = False


def _lang_hash(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


class Run:
    """Words of a run of documents, with their pieces, languages and phrase hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lang: np.ndarray, names: list[str]):
        low = tb.LOWER[buf]
        self.low, self.names = low, names
        self.w = w = tb.words(low, off, _WORD)
        edges = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(_EDGE[low])))
        piece = edges[w.start] if len(w) else np.zeros(0, dtype=np.int64)
        change = np.flatnonzero((piece[1:] != piece[:-1]) | (w.doc[1:] != w.doc[:-1])) + 1
        self.piece = np.zeros(len(w), dtype=np.int64)
        self.piece[change] = 1
        self.piece = np.cumsum(self.piece)
        self.lang = lang[w.doc]
        self.hash = tb.span_hash(tb.prefix(low), w.start, w.end) if len(w) else np.zeros(0, dtype=tb.U64)
        self.seed = np.array([_lang_hash(n) for n in names], dtype=tb.U64)

    def within(self, n: int) -> np.ndarray:
        """Starts of phrases of ``n`` words."""
        m = len(self.w) - n + 1
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :]) if m > 0 else np.zeros(0, dtype=np.int64)

    def phrases(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of ``n`` words at those starts, with their language."""
        total = self.seed[self.lang[at]].copy()
        for k in range(n):
            total += self.hash[at + k] * tb.U64(pow(tb._BASE, k + 1, 1 << 64))
        return tb.splitmix(total)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the words, one space after each; start of each word and the end)."""
        size = self.w.end - self.w.start
        first = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(size + 1)))
        out = np.full(int(first[-1]), 32, dtype=np.uint8)
        out[tb.ranges(first[:-1], size)] = self.low[tb.ranges(self.w.start, size)]
        return out, first


def _runs(batch: pa.RecordBatch) -> Iterator[Run]:
    """Runs of a batch (lang, text)."""
    lang = batch.column(0).dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    buf, off = tb.flat(batch.column(1))
    for i, j in tb.slices(off):
        yield Run(buf[off[i] : off[j]], off[i : j + 1] - off[i], codes[i:j], names)


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Arrow strings of byte ranges."""
    size = end - start
    off = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[tb.ranges(start, size)]))])


def _summed(cells: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct counters, their sums)."""
    if counts is None:
        cells = np.sort(cells)
    else:
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, dtype=np.int64)
    sums = np.diff(np.append(head, len(cells))) if counts is None else np.add.reduceat(counts, head) if len(head) else counts
    return cells[head], sums.astype(np.int64)


_COUNTED = "kind int, block long, lang string, word string, n long, cells binary, counts binary"
_COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def _sketch_rows(parts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows (block, cells, counts) of gathered phrase hashes."""
    cells, sums = _summed(np.concatenate(parts) >> tb.U64(32 - bits) if parts else np.zeros(0, dtype=tb.U64))
    block = (cells >> tb.U64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, dtype=np.int64)
    rows = []
    for a, b in zip(edge.tolist(), [*edge.tolist(), len(block)][1:]):
        own = (cells[a:b] & tb.U64(0xFFFFFFFF)).astype(np.uint32)
        rows.append((1, int(block[a]), None, None, None, np.diff(own, prepend=np.uint32(0)).tobytes(), sums[a:b].astype(np.uint32).tobytes()))
    return _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_COUNTED_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _COUNTED_ARROW, strict=True)], schema=_COUNTED_ARROW)


def _is_set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = ((hashes >> tb.U64(32 - bits)) & tb.U64(8 * len(table) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _chains(run: Run, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 3 words and more: (n, starts of phrases all of whose pairs are in ``pairs``, a mask over starts)."""
    m = len(pairs)
    held = pairs.copy()
    for n in range(3, LONGEST + 1):
        shifted = np.zeros(m, dtype=bool)
        shifted[: max(0, m - n + 2)] = pairs[n - 2 :]
        held &= shifted
        yield n, np.flatnonzero(held)


def _pairs(run: Run, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of words that begin a pair with a counter at the threshold, hashes of the pairs at those words)."""
    at = run.within(2)
    hashes = run.phrases(2, at)
    keep = _is_set(table, hashes, bits)
    mask = np.zeros(len(run.w), dtype=bool)
    mask[at[keep]] = True
    return mask, hashes[keep]


def _first_pass(bits: int):
    """Counts of words, and the sketch of pairs."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for run in _runs(batch):
                if not len(run.w):
                    continue
                key, first, n = np.unique(run.hash + run.seed[run.lang], return_index=True, return_counts=True)
                words = _strings(run.low, run.w.start[first], run.w.end[first])
                langs = pa.array(run.names, pa.string()).take(pa.array(run.lang[first]))
                size, none = len(key), pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, dtype=np.int32)), none(size, pa.int64()), langs, words, pa.array(n.astype(np.int64)), none(size, pa.binary()), none(size, pa.binary())], schema=_COUNTED_ARROW)
                parts.append(run.phrases(2, run.within(2)))
                held += len(parts[-1])
                if held >= GATHERED:
                    yield _sketch_rows(parts, bits)
                    parts, held = [], 0
        yield _sketch_rows(parts, bits)

    return run_all


def _second_pass(bits: int, shared):
    """The sketch of three to five words."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for run in _runs(batch):
                mask, _ = _pairs(run, shared.value, bits)
                for n, at in _chains(run, mask):
                    parts.append(run.phrases(n, at))
                    held += len(at)
                if held >= GATHERED:
                    yield _sketch_rows(parts, bits)
                    parts, held = [], 0
        yield _sketch_rows(parts, bits)

    return run_all


def _block_sums(least: int):
    """Counters of a block that reach the threshold."""

    def run(key, table):
        cells, counts = [], []
        for c, n in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
            cells.append(np.cumsum(np.frombuffer(c, dtype=np.uint32), dtype=np.uint32))
            counts.append(np.frombuffer(n, dtype=np.uint32).astype(np.int64))
        own, sums = _summed(np.concatenate(cells), np.concatenate(counts))
        return pa.table({"cell": (key[0].as_py() << 32) + own[sums >= least].astype(np.int64)})

    return run


_FOUND = "kind int, shard long, lang string, phrases string, n binary"


def _packed(kind: int, run: Run, shard: np.ndarray, lang: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Byte ranges of ``text`` as one row a shard and language: the strings, one a line, and their numbers."""
    order = np.lexsort((lang, shard))
    shard, lang, n = shard[order], lang[order], n[order].astype(np.uint32)
    edge = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1])))) if len(order) else order
    off = np.append(edge, len(order)).astype(np.int32)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(off), _strings(text, start[order], end[order])), "\n")
    counts = pa.array([n[a:b].tobytes() for a, b in zip(off.tolist(), off[1:].tolist())], pa.binary())
    langs = pa.array(run.names, pa.string()).take(pa.array(lang[edge]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), kind, dtype=np.int32)), pa.array(shard[edge].astype(np.int64)), langs, lines, counts], names=["kind", "shard", "lang", "phrases", "n"])


def _third_pass(bits: int, shared, shards: int):
    """Candidates (kind 0) and stretches (kind 1) of each run."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=tb.U64)
        for batch in batches:
            for run in _runs(batch):
                pairs, hashes = _pairs(run, shared.value[0], bits)
                start = np.flatnonzero(pairs)
                if not len(start):
                    continue
                shard = np.zeros(len(run.w), dtype=np.int64)
                shard[start] = (tb.splitmix(hashes) % tb.U64(shards)).astype(np.int64)
                reach = np.where(pairs, 2, 0)
                every = [(hashes, start, np.full(len(start), 2))]
                for n, at in _chains(run, pairs):
                    own = run.phrases(n, at)
                    keep = _is_set(shared.value[1], own, bits)
                    reach[at[keep]] = n
                    every.append((own[keep], at[keep], np.full(int(keep.sum()), n)))
                own, at, n = (np.concatenate(x) for x in zip(*every, strict=True))
                own, first = np.unique(own, return_index=True)
                new = ~np.isin(own, seen, assume_unique=True)
                seen = np.union1d(seen, own[new]) if len(seen) < GATHERED else own
                at, n = at[first[new]], n[first[new]]
                text, edge = run.joined()
                yield _packed(0, run, shard[at], run.lang[at], text, edge[at], edge[at + n] - 1, n)
                # maximal runs of words covered by the candidates of one shard, in one piece
                pieces = int(run.piece[-1]) + 1
                owner, a, b = tb.merge_intervals(shard[start] * pieces + run.piece[start], start, start + reach[start])
                key = tb.splitmix(tb.span_hash(tb.prefix(text), edge[a], edge[b] - 1) + run.seed[run.lang[a]]) + (owner // pieces).astype(tb.U64)
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                a, b = a[first], b[first]
                yield _packed(1, run, owner[first] // pieces, run.lang[a], text, edge[a], edge[b] - 1, count)

    return run_all


def _scanned(key, phrases, stretches):
    """Occurrences of a shard's candidates in a group of its stretches, overlapping ones included."""
    out = []
    langs = stretches.column("lang").combine_chunks()
    for name in pc.unique(langs).to_pylist() if len(langs) else []:
        own = phrases.filter(pc.equal(phrases.column("lang"), name)).column("phrase").to_pylist()
        if not own:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(own):
            automaton.add_word(f" {phrase} ", k)
        automaton.make_automaton()
        given = stretches.filter(pc.equal(stretches.column("lang"), name))
        counts = np.zeros(len(own), dtype=np.int64)
        for lines, times in zip(given.column("phrases"), given.column("n"), strict=True):
            text, times = lines.as_py(), np.frombuffer(times.as_py(), dtype=np.uint32)
            ends = np.cumsum(np.fromiter(map(len, text.split("\n")), dtype=np.int64) + 3)  # with the delimiters around each
            hits = np.fromiter(chain.from_iterable(automaton.iter(f" {text.replace('\n', ' \n ')} ")), dtype=np.int64).reshape(-1, 2)
            np.add.at(counts, hits[:, 1], times[np.searchsorted(ends, hits[:, 0], side="right")])
        out.append(pa.table({"lang": pa.array([name] * len(own), pa.string()), "phrase": pa.array(own, pa.string()), "a": counts}).filter(pa.array(counts > 0)))
    return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "a": pa.array([], pa.int64())})


def _united(key, table):
    """The different candidates of a group of packed rows."""
    out = []
    for name in pc.unique(table.column("lang").combine_chunks()).to_pylist():
        rows = table.filter(pc.equal(table.column("lang"), name)).column("phrases")
        own = set()
        for lines in rows:
            own.update(lines.as_py().split("\n"))
        out.append(pa.table({"shard": pa.array([key[0].as_py()] * len(own), pa.int64()), "lang": pa.array([name] * len(own), pa.string()), "phrase": pa.array(sorted(own), pa.string())}))
    return pa.concat_tables(out)


def _bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with the slot of every cell."""
    slot = F.pmod(F.col("cell"), F.lit(bits)) + 1
    rows = cells.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map")).collect()  # at most bits / 8 bytes
    table = np.zeros((bits // (8 * 4096), 4096), dtype=np.uint8)
    for r in rows:
        table[r.bucket - 1] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    return table.reshape(-1)


def phrase_counts(docs: DataFrame, *, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shard_phrases: int = SHARD_PHRASES, group_bytes: int = GROUP_BYTES, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of every phrase of two to five words with a >= least, (lang, word, n) of every word), both exact."""
    spark = docs.sparkSession
    rows = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = min(31, max(4, (-(-size // block_bytes) - 1).bit_length()))  # bits of a block's number
    first = written(rows.mapInArrow(tb.trimmed(_first_pass(width)), _COUNTED), "words")
    words = first.where("kind = 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def heavy(sketch: DataFrame, name: str) -> DataFrame:
        return written(sketch.where("kind = 1").select("block", "cells", "counts").groupBy("block").applyInArrow(_block_sums(least), "cell long"), name)

    words = written(words, "word-counts")
    pairs = heavy(first, "pairs")
    dropped(first)
    two = _bitmap(pairs, bits)
    longer = heavy(rows.mapInArrow(tb.trimmed(_second_pass(width, spark.sparkContext.broadcast(two))), _COUNTED), "longer")
    shards = max(1, -(-(pairs.count() + longer.count()) // shard_phrases))
    found = written(rows.mapInArrow(tb.trimmed(_third_pass(width, spark.sparkContext.broadcast((two, _bitmap(longer, bits))), shards)), _FOUND), "found")
    bytes_of = (F.octet_length("phrases") + F.octet_length("n")).cast("long")
    groups = written(found.groupBy("kind", "shard").agg(F.ceil(F.sum(bytes_of) / group_bytes).cast("long").alias("groups")), "groups")
    dealt = found.join(groups, ["kind", "shard"]).select("kind", "shard", F.pmod(F.xxhash64("phrases"), "groups").alias("part"), "lang", "phrases", "n")
    stretches = dealt.where("kind = 1").drop("kind")
    united = dealt.where("kind = 0").select("shard", "part", "lang", "phrases").groupBy("shard", "part").applyInArrow(_united, "shard long, lang string, phrase string").distinct()
    candidates = united.join(groups.where("kind = 1").drop("kind"), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "lang", "phrase")
    candidates = written(candidates, "candidates")
    scanned = candidates.groupBy("shard", "part").cogroup(stretches.groupBy("shard", "part")).applyInArrow(_scanned, "lang string, phrase string, a long")
    counts = written(scanned.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")
    for table in (pairs, longer, found, groups, candidates):
        dropped(table)
    return counts, words


def collocations(docs: DataFrame, *, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts, words = phrase_counts(docs, **how)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = F.split("phrase", " ")
    own = counts.withColumn("w", parts)
    inside = own.where(F.size("w") > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = own.join(covered, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    asked = written(cuts, "cuts")
    needed = asked.select("lang", F.col("head").alias("word")).unionByName(asked.select("lang", F.col("tail").alias("word"))).distinct()
    frequencies = counts.select("lang", F.col("phrase").alias("word"), F.col("a").alias("f")).unionByName(words.join(needed, ["lang", "word"], "left_semi").select("lang", "word", F.col("n").alias("f")))
    frequencies = written(frequencies, "frequencies")
    both = asked.join(frequencies.select("lang", F.col("word").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(frequencies.select("lang", F.col("word").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(18, 0))"  # noqa: E731  exact to 38 digits
    scored = both.withColumn("score", F.expr(f"cast((1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) as bigint)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    rows = lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
 f AS MATERIALIZED (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
 t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 100),
 inside AS (SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
 longer AS (SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL),
 kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a),
 cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
 s AS (SELECT cuts.*, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN t ON t.lang = cuts.lang),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER w AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)
