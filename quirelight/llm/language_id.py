"""Language identification with a byte convolutional network written in numpy.

Filters of widths 2, 3 and 4 slide over windows of 128 lower-cased bytes; each
filter's largest response over the window (max pooling, then ReLU) feeds a
softmax over the learned languages.  The network is fitted on the driver to a
bounded sample of windows: of the windows of all labelled documents' whole texts,
about ``per_label`` different ones for each language, drawn by a hash of their
bytes, of the ``most_labels`` languages with most text.  Prediction cuts every
whole text into overlapping windows, so every 4-byte context is seen once, and
averages the windows' logits.

At prediction a filter over two neighbouring bytes is one table lookup, so
widths 2, 3 and 4 cost five lookups a byte; all windows of a slice go together.

Defined results: null text, or text without a letter, is ``und`` with score 0;
without labelled rows everything is ``und``; null ids count as not held out;
repeated rows keep their row (their windows count once in the fit); of equal
chances the first label in alphabetical order is predicted; very long texts are
read whole, a slice of windows at a time; an empty table gives no rows;
``lang``, ``source`` and ``doc_id`` are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .storage import spread

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
STRIDE = WINDOW - max(WIDTHS) + 1
_BATCH = 2048  # windows at a time


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """filters[w] has shape (w, 256, FILTERS); the rest is the pooled layer."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        pair = lambda f: (f[0][:, None, :] + f[1][None, :, :]).reshape(65536, -1).astype(np.float32)
        two, three, four = (self.filters[w] for w in WIDTHS)
        return [(pair(two),), (pair(three[:2]), three[2].astype(np.float32)), (pair(four[:2]), pair(four[2:]))]

    def logits(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Logits of windows (n x WINDOW bytes)."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        n = x.shape[1]
        (two,), (three, last), (four, tail) = tables
        pooled = [two[pairs].max(axis=1), (three[pairs[:, : n - 2]] + last[x[:, 2:]]).max(axis=1), (four[pairs[:, : n - 3]] + tail[pairs[:, 2:]]).max(axis=1)]
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.weights + self.offset


def windows(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end of its document, document) of every window; an empty text has one empty window."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(size)), count)
    step = tb.ranges(np.zeros(len(size), dtype=np.int64), count)
    return off[doc] + step * STRIDE, off[1:][doc], doc


def matrix(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, 0 past the document's end."""
    at = start[:, None] + np.arange(WINDOW)[None]
    return np.where(at < end[:, None], low[np.minimum(at, len(low) - 1)], 0).astype(np.uint8) if len(low) else np.zeros((len(start), WINDOW), dtype=np.uint8)


def fit(x: np.ndarray, labels: list[str], *, epochs: int = 14, rate: float = 0.02, seed: int = 11) -> Network:
    """Train on windows (n x WINDOW bytes) with Adam; deterministic."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network(names, {w: rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names)))
    if not len(x):
        return net
    number = {v: k for k, v in enumerate(names)}
    y = np.array([number[v] for v in labels])
    # short windows too, so that short texts are met in training
    order = rng.permutation(len(x))[: len(x) // 2]
    keep = np.arange(WINDOW)[None] < rng.integers(8, WINDOW, len(order))[:, None]
    short, y_short = np.where(keep, x[order], 0).astype(np.uint8), y[order]
    x, y = np.concatenate((x, short)), np.concatenate((y, y_short))
    weight = (len(y) / len(names) / np.maximum(np.bincount(y, minlength=len(names)), 1))[y]
    values = [*net.filters.values(), net.bias, net.weights, net.offset]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = shuffled[lo : lo + 256]
            rows = x[at].astype(np.int64)
            pooled, arg = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                out = sum(net.filters[w][k].astype(np.float32)[rows[:, k : k + n]] for k in range(w))
                arg.append(out.argmax(axis=1))
                pooled.append(np.take_along_axis(out, arg[-1][:, None], axis=1)[:, 0])
            hidden = np.concatenate(pooled, axis=1) + net.bias
            active = np.maximum(hidden, 0)
            logits = active @ net.weights + net.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[at][:, None] / len(at)
            back = (p @ net.weights.T) * (hidden > 0)
            grads = []
            for g, w in enumerate(WIDTHS):
                own = back[:, g * FILTERS : (g + 1) * FILTERS]
                grad = np.zeros_like(net.filters[w])
                for k in range(w):
                    np.add.at(grad[k], (np.take_along_axis(rows, arg[g] + k, axis=1), np.arange(FILTERS)[None].repeat(len(at), 0)), own)
                grads.append(grad)
            grads += [back.sum(axis=0), active.T @ p, p.sum(axis=0)]
            t += 1
            for v, grad, a, b in zip(values, grads, first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, *, per_label: int = 2_000, most_labels: int = 256) -> Network:
    """Fit on a hash sample of the windows of all labelled documents that aren't held out."""
    known = spread(docs.select("doc_id", "lang", "text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    size = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - (WINDOW - STRIDE)) / STRIDE)).cast("long")
    counted = known.groupBy("lang").agg(F.sum(size).alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()
    if not counted:
        return fit(np.zeros((0, WINDOW), dtype=np.uint8), [])
    share = {r.lang: min(1.0, per_label / r.n) for r in counted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tb.flat(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            wanted = np.array([share.get(v, 0.0) for v in langs])
            for i, j in tb.slices(off):
                low, edge = tb.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                start, end, doc = windows(low, edge)
                sums = tb.prefix(low)
                draw = tb.splitmix(tb.span_hash(sums, start, np.minimum(start + WINDOW, end))) >> tb.U64(11)
                at = np.flatnonzero(draw.astype(np.float64) < wanted[i:j][doc] * 2.0**53)
                yield pa.RecordBatch.from_arrays([pa.array([langs[i + d] for d in doc[at].tolist()], pa.string()), pa.array([r.tobytes() for r in matrix(low, start[at], end[at])], pa.binary())], names=["lang", "window"])

    # copies of a window are drawn together and count once, so the sample is bounded whatever is repeated
    rows = known.mapInArrow(tb.trimmed(run), "lang string, window binary").distinct().collect()
    rows = sorted((r.lang, bytes(r.window)) for r in rows)
    return fit(np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8).reshape(-1, WINDOW), [v for v, _ in rows])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone."""
    docs = spread(docs.drop("lang_pred", "score"))
    carried = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables()
        letter = np.zeros(256, dtype=np.int64)
        letter[65:91] = letter[97:123] = 1
        for batch in batches:
            column = batch.column("text")
            buf, off = tb.flat(column)
            named, scores = [], []
            for i, j in tb.slices(off):
                raw, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                low = tb.LOWER[raw]
                start, end, doc = windows(low, edge)
                total = np.zeros((j - i, len(own.labels)))
                for lo in range(0, len(start) if own.labels else 0, _BATCH):
                    part = slice(lo, lo + _BATCH)
                    np.add.at(total, doc[part], own.logits(matrix(low, start[part], end[part]), tables))
                has = np.diff(np.concatenate(([0], np.cumsum(letter[raw])))[edge]) > 0
                for d in np.flatnonzero(~has).tolist():
                    has[d] = any(c.isalpha() for c in raw[edge[d] : edge[d + 1]].tobytes().decode("utf-8", "ignore"))
                if own.labels:
                    total /= np.bincount(doc, minlength=j - i)[:, None]
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    named += [own.labels[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                    scores.append(np.where(has, p[np.arange(j - i), best], 0.0))
                else:
                    named += ["und"] * (j - i)
                    scores.append(np.zeros(j - i))
            yield tb.extend(batch, carried, lang_pred=pa.array(named, pa.string()), score=pa.array(np.concatenate(scores) if scores else [], pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tb.trimmed(run), f"{fields}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    net = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), net).drop("text")
