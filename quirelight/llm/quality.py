"""Quality scores by co-training a text view and a metadata view.

The text view sees shares of byte classes, word and line statistics of the whole
text; the metadata view sees source, language and size.  Both start as logistic
regressions on a bounded sample of labelled documents (``labelled`` in
expectation, a quarter of it kept for calibration).  For some rounds each view
gives its most confident decisions on *all* unlabelled documents to the other
view, in the proportion of the labels: counts of the log-odds in fixed bins,
summed over the tasks, give the two thresholds of a round, and what lies beyond
them keeps that label.  Both views are then refitted to the labelled sample and
all pseudo-labels by steps whose gradients and curvatures are summed in the tasks.  A document's pseudo-label follows from the rounds' models and
thresholds, so no state is kept for it.  Each view is then calibrated on the kept
quarter (Platt scaling), the calibrated log-odds are combined with weights from
their calibration losses, and every document is scored.

Features are computed where the rows are and written once; the driver sees the
labelled sample's features and sums of fixed width.

Defined results: null and empty texts have zero text features and are scored all
the same; null source or language is a value of its own; conflicting labels of a
document are averaged (a half counts as good); null labels are ignored; without
both classes every score is the labels' mean, or 0.5 without labels; repeated
rows keep their row (a repeated labelled id counts once in the sample, repeated
unlabelled rows count each); documents with equal log-odds get their
pseudo-labels together; very long texts are read whole; an empty table gives no
rows; columns named p_text, p_meta or score are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import dropped, spread, written

#: Labelled documents in the sample, rounds, share of the unlabelled documents that a view gives in a round, steps of a round.
LABELLED, ROUNDS, SHARE, STEPS = 4_000, 4, 0.08, 3
#: Log-odds are counted in ``BINS`` bins between -SPAN and SPAN.
BINS, SPAN = 4_096, 30.0
_SUMMED = 32  # groups in which the tasks' sums are added before they reach the driver
_HASHED = 32

# byte classes: each ASCII punctuation mark alone, digits, capitals, small letters, space, line feed, other controls, non-ASCII
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = _k + 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[32], _CLASS[10], _CLASS[128:] = 33, 34, 35, 36, 37, 38
_CLASSES = 39
TEXT_FEATURES = _CLASSES + 6
META_FEATURES = 2 * _HASHED + 3


def text_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of text features per document."""
    n = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * _CLASSES + _CLASS[buf], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    low = tb.LOWER[buf]
    w = tb.words(low, off, tb.NONSPACE)
    count = np.maximum(w.counts, 1)
    sums = tb.prefix(low)
    lines = tb.words(low, off, np.arange(256) != 10)
    distinct = []
    for part in (w, lines):
        keys = part.doc.astype(tb.U64) << tb.U64(40) | tb.span_hash(sums, part.start, part.end) >> tb.U64(24)
        keys = np.unique(keys)
        distinct.append(np.bincount((keys >> tb.U64(40)).astype(np.int64), minlength=n) / np.maximum(part.counts, 1))
    length = np.bincount(w.doc, weights=w.end - w.start, minlength=n) / count
    short = np.bincount(w.doc, weights=(w.end - w.start) <= 3, minlength=n) / count
    more = np.stack((np.log1p(size) / 10, length / 10, short, *distinct, np.log1p(count / np.maximum(lines.counts, 1)) / 5), axis=1)
    return np.concatenate((np.sqrt(shares), more), axis=1)


def meta_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """One row of metadata features per document: hashed source and language, size."""
    out = np.zeros((len(source), META_FEATURES))
    for at, values in ((0, source), (_HASHED, lang)):
        out[np.arange(len(values)), [at + zlib.crc32(repr(v).encode()) % _HASHED for v in values]] = 1
    size = np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 10
    out[:, -3], out[:, -2], out[:, -1] = size, size**2, np.isnan(n_chars)
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, off = tb.flat(batch.column("text"))
    text = [text_features(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in tb.slices(off)]
    meta = meta_features(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False))
    return np.concatenate(text) if text else np.zeros((0, TEXT_FEATURES)), meta


class Logistic:
    """L2 logistic regression on features standardised by the first set it is fitted to.

    Its steps minimise the quadratic function that touches the loss from above (Jaakkola and Jordan's bound), so that none
    makes the fit worse, also where new labels contradict the model.
    """

    penalty = 1.0

    def start(self, x: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = np.zeros(x.shape[1] + 1)
        return self

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1))), axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the rows' losses and curvature of their bounds, in one array."""
        x = self._inputs(x)
        z = x @ self.w
        half = np.maximum(np.abs(z), 1e-4) / 2
        return np.concatenate(((x.T @ (_sigmoid(z) - y))[None], (x * (np.tanh(half) / (4 * half))[:, None]).T @ x))

    def step(self, sums: np.ndarray) -> None:
        ridge = np.full(len(self.w), self.penalty)
        ridge[-1] = 1e-6
        self.w = self.w - np.linalg.solve(sums[1:] + np.diag(ridge), sums[0] + ridge * self.w)

    def fit(self, x: np.ndarray, y: np.ndarray, *, steps: int = 60) -> Logistic:
        self.start(x)
        for _ in range(steps):
            self.step(self.sums(x, y))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(x) @ self.w, -SPAN, SPAN)

    def copy(self) -> Logistic:
        out = Logistic()
        out.mean, out.scale, out.w = self.mean, self.scale, self.w
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -SPAN, SPAN)))


#: A finished round: its models, and for each taker the log-odds of the other view under and from which a document was given to it.
Round = tuple[list[Logistic], list[tuple[float, float]]]


def given(views: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """For each taker the pseudo-labels of the rows: 0, 1, or nan where it has none."""
    out = [np.full(len(v), np.nan) for v in views]
    for models, bounds in rounds:
        for taker, (low, high) in enumerate(bounds):
            z = models[1 - taker].logit(views[1 - taker])
            free = np.isnan(out[taker])
            out[taker][free & (z < low)] = 0
            out[taker][free & (z >= high)] = 1
    return out


def counts(views: tuple[np.ndarray, np.ndarray], rounds: list[Round], models: list[Logistic]) -> np.ndarray:
    """2 x BINS: for each taker, the rows it has no label of, by the other view's log-odds."""
    out = np.zeros((2, BINS))
    for taker, label in enumerate(given(views, rounds)):
        z = models[1 - taker].logit(views[1 - taker][np.isnan(label)])
        out[taker] = np.bincount(np.minimum(((z + SPAN) / (2 * SPAN) * BINS).astype(np.int64), BINS - 1), minlength=BINS)
    return out


def thresholds(count: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Bin edges beyond which about ``low`` and ``high`` rows lie (whole bins, one with rows at least), each on its side of even odds."""
    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    below, above = np.cumsum(count), np.cumsum(count[::-1])
    first = lambda total, n: max(int(np.searchsorted(total, n, side="right")), int(np.argmax(total > 0)) + 1) if total[-1] else 0
    return min(0.0, float(edges[min(BINS, first(below, low))])), max(0.0, float(edges[BINS - min(BINS, first(above, high))]))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, kept: np.ndarray, n_free: int, over_all: Callable[[Callable], list[np.ndarray]], *, rounds: int = ROUNDS, share: float = SHARE, steps: int = STEPS):
    """(models, Platt lines, weights): the fitted views.

    ``over_all(f)`` gives the sums over all unlabelled rows of the arrays that ``f(views)`` returns for a part of them.
    """
    rate = float(y[~kept].mean())
    sets = [(v[~kept], y[~kept]) for v in views]
    models = [Logistic().fit(*s) for s in sets]
    done: list[Round] = []
    for _ in range(rounds if n_free else 0):
        before = [m.copy() for m in models]
        (count,) = over_all(lambda part, r=tuple(done), m=before: [counts(part, list(r), m)])
        n = max(2.0, share * n_free)
        done.append((before, [thresholds(count[taker], max(1.0, n * (1 - rate)), max(1.0, n * rate)) for taker in (0, 1)]))
        for _ in range(steps):
            now = [m.copy() for m in models]
            pseudo = over_all(lambda part, r=tuple(done), m=now: [own.sums(v[~np.isnan(t)], t[~np.isnan(t)]) for own, v, t in zip(m, part, given(part, list(r)), strict=True)])
            for model, own, more in zip(models, sets, pseudo, strict=True):
                model.step(model.sums(*own) + more)
    lines, losses = [], []
    for v, m in zip(views, models, strict=True):
        line = Logistic().fit(m.logit(v[kept])[:, None], y[kept])
        p = np.clip(_sigmoid(line.logit(m.logit(v[kept])[:, None])), 1e-6, 1 - 1e-6)
        lines.append(line)
        losses.append(-np.mean(y[kept] * np.log(p) + (1 - y[kept]) * np.log(1 - p)))
    base = np.clip(y[kept].mean(), 1e-3, 1 - 1e-3)
    entropy = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    gain = np.maximum(entropy - np.array(losses), 0)
    weights = gain / gain.sum() if gain.sum() > 0 else np.full(2, 0.5)
    return models, lines, weights


def _arrays(text: pa.Array, meta: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    read = lambda column, width: np.frombuffer(tb.flat(column)[0], dtype=np.float32).reshape(-1, width).astype(np.float64)
    return read(text, TEXT_FEATURES), read(meta, META_FEATURES)


def _over_all(free: DataFrame) -> Callable[[Callable], list[np.ndarray]]:
    """Sums over the rows of ``free``: each task adds up its rows, a few groups add up the tasks."""

    def total(f: Callable) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                part = f(_arrays(batch.column(0), batch.column(1)))
                own = part if own is None else [a + b for a, b in zip(own, part, strict=True)]
            if own is not None:
                at = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([at % _SUMMED], pa.int64()), pa.array([at], pa.int64()), pa.array([b"".join(a.tobytes() for a in own)], pa.binary())], names=["group", "part", "payload"])

        def add(key, table):
            rows = sorted(zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True))  # in one order, so that sums come out alike
            return pa.table({"group": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([sum(np.frombuffer(p) for _, p in rows).tobytes()], pa.binary())})

        summed = free.select("text_view", "meta_view").mapInArrow(tb.trimmed(run), "group long, part long, payload binary").groupBy("group").applyInArrow(add, "group long, payload binary").collect()
        whole = sum(np.frombuffer(r.payload) for r in sorted(summed, key=lambda r: r.group))
        shapes = [a.shape for a in f((np.zeros((0, TEXT_FEATURES)), np.zeros((0, META_FEATURES))))]
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return [part.reshape(x) for part, x in zip(np.split(whole, ends[:-1]), shapes, strict=True)]

    return total


def train(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, rounds: int = ROUNDS, share: float = SHARE):
    """Fit to a bounded sample of labelled documents and to all unlabelled ones; ('constant', mean) where the labels have no two classes."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    n_known = known.count()
    features = written(_featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars")), "features")
    try:
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / (1 << 30)
        drawn = draw < min(1.0, labelled / max(n_known, 1))
        seen = features.where(drawn).join(known.where(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_view", "meta_view")).alias("views"), F.first("quality").alias("quality")).orderBy("doc_id").collect()
        if not seen or len({r.quality >= 0.5 for r in seen}) < 2:
            mean = known.agg(F.avg((F.col("quality") >= 0.5).cast("double"))).first()[0]
            return "constant", 0.5 if mean is None else float(mean)
        y = np.array([r.quality >= 0.5 for r in seen], dtype=np.float64)
        kept = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 0 for r in seen])
        if any(len(set(y[m].tolist())) < 2 for m in (kept, ~kept)):
            kept = np.arange(len(y)) % 2 == 0
            if any(len(set(y[m].tolist())) < 2 for m in (kept, ~kept)):
                return "constant", float(y.mean())
        views = _arrays(*(pa.array([bytes(r.views[c]) for r in seen], pa.binary()) for c in ("text_view", "meta_view")))
        free = written(features.join(known.select("doc_id"), "doc_id", "left_anti").select("text_view", "meta_view"), "free")
        try:
            return "views", co_train(views, y, kept, free.count(), _over_all(free), rounds=rounds, share=share)
        finally:
            dropped(free)
    finally:
        dropped(features)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = (v.astype(np.float32) for v in _views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], names=["doc_id", "text_view", "meta_view"])

    return spread(docs).mapInArrow(tb.trimmed(run), "doc_id long, text_view binary, meta_view binary")


def score(docs: DataFrame, fitted) -> DataFrame:
    """``docs`` with p_text, p_meta and score (chance of good quality)."""
    docs = spread(docs.drop("p_text", "p_meta", "score"))
    carried = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, own = shared.value
        for batch in batches:
            if kind == "constant":
                p = [np.full(batch.num_rows, own)] * 3
            else:
                models, lines, weights = own
                z = [line.logit(m.logit(v)[:, None]) for v, m, line in zip(_views(batch), models, lines, strict=True)]
                p = [_sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(weights[0] * z[0] + weights[1] * z[1])]
            yield tb.extend(batch, carried, **{c: pa.array(v, pa.float64()) for c, v in zip(("p_text", "p_meta", "score"), p, strict=True)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tb.trimmed(run), f"{fields}, p_text double, p_meta double, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars")
    return score(docs, train(docs, labels)).select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("good"))
