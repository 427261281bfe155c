"""License scan by a positional rare-token index.

The templates form an index word -> [(template, position)].  The words are
ranked by inverse document frequency counted over all scanned documents (one
aggregate; its size is bounded by the templates' vocabulary).  Of each file's
licence words the ``ANCHORS`` of highest IDF are looked up for each template that
holds them; every occurrence at word ``p`` of a template word at position ``t``
votes for the alignment ``p - t``; the postings of one template are intersected
on that alignment, and a template is reported at every place where its mandatory
key phrases stand, compared by their bytes.

A phrase template is its own key phrase; a file without all of its words has no
place of it, and in the others its rarest word alone proposes the places, so they
are complete.  A long template needs ``VOTES`` anchors and its key phrases on one
alignment that may drift by half its length (words put in or left out); places
nearer to each other than its length are one, the one with most words in place.
Its score is the share of those words.

Defined results: null and empty texts have no words, no label and score 0; null
ids and repeated rows keep their row; places of equal shares: the first; very
long texts are read whole; an empty table gives no rows; extra columns pass
through, columns named n_words or license_hits are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .storage import spread

# The base phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further templates (label, words, mandatory key phrases; none: the whole template is one).
TEMPLATES = [
    ("cc-by-nc", "cc by nc", []),
    ("cc-by-sa", "cc by sa", []),
    ("cc-by-nd", "cc by nd", []),
    ("cc0", "cc0 1 0 universal", []),
    ("gpl-2.0", "gnu general public license version 2", []),
    ("gpl-3.0", "gnu general public license version 3", []),
    ("lgpl", "gnu lesser general public license", []),
    ("agpl", "gnu affero general public license", []),
    ("apache-2.0", "apache license version 2 0", []),
    ("mpl-2.0", "mozilla public license version 2 0", []),
    ("bsd", "bsd license", []),
    ("isc", "isc license", []),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "free of charge", "deal in the software without restriction"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "in no event will the authors be held liable"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "as published by the free software foundation"]),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["you may not use this file except in compliance with the license"]),
]

#: A file's rare words that are looked up for a template, and how many of them a long template needs on one alignment.
ANCHORS, VOTES = 8, 3


class Index:
    """Positional index of the templates, ranked by the given document frequencies."""

    def __init__(self, df: dict[str, int] | None = None, n_docs: int = 0) -> None:
        rows = [(label, phrase, [], True) for phrase, label in BASE_PHRASES.items()] + [(label, text, keys, False) for label, text, keys in TEMPLATES]
        self.vocabulary = sorted({w for _, text, _, _ in rows for w in text.split()})
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        self.idf = np.array([math.log((1 + n_docs) / (1 + (df or {}).get(w, 0))) for w in self.vocabulary])
        hashes = hash_words(self.vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(self.hashes >> tb.U64(48)).astype(np.int64)] = True
        self.templates = []
        for label, text, keys, base in rows:
            seq = np.array([ids[w] for w in text.split()])
            rare = np.array(sorted(set(seq.tolist()), key=lambda w: (-self.idf[w], w)))  # highest IDF first
            postings = [np.flatnonzero(seq == w) for w in rare]
            phrases = [(np.array([ids[w] for w in k.split()]), _place(text.split(), k.split()), k.encode()) for k in keys or [text]]
            self.templates.append((label, seq, rare, postings, phrases, base, bool(keys)))

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 if it is none."""
        out = np.full(len(hashed), -1, dtype=np.int32)
        at = np.flatnonzero(self.near[(hashed >> tb.U64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hashes, hashed[at]), len(self.hashes) - 1)
        same = self.hashes[where] == hashed[at]
        out[at[same]] = self.order[where[same]]
        return out


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def hash_words(vocabulary: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(vocabulary).encode(), dtype=np.uint8)
    w = tb.words(buf, np.array([0, len(buf)]), tb.ALNUM)
    return tb.span_hash(tb.prefix(buf), w.start, w.end)


def _vocabulary_ids(index: Index, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, tb.Words, np.ndarray]:
    low = tb.LOWER[buf]
    w = tb.words(low, off, tb.ALNUM)
    return low, w, index.ids(tb.span_hash(tb.prefix(low), w.start, w.end)) if len(w) else np.zeros(0, dtype=np.int32)


def _phrase_at(raw: bytes, w: tb.Words, ids: np.ndarray, at: np.ndarray, phrase: np.ndarray, text: bytes) -> np.ndarray:
    """Those of the word places ``at`` where ``phrase`` stands within one document, word for word."""
    n = len(phrase)
    at = at[(at >= 0) & (at + n <= len(ids))]
    at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
    for k, x in enumerate(phrase):
        at = at[ids[at + k] == x]
    same = [b" ".join(raw[a:b].translate(tb.ALNUM_CANON).split()) == text for a, b in zip(w.start[at].tolist(), w.end[at + n - 1].tolist(), strict=True)]
    return at[np.array(same, dtype=bool)]


def match(index: Index, low: np.ndarray, w: tb.Words, ids: np.ndarray, n_docs: int) -> list[tuple[str, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, is a base phrase, document, first word, score) of every verified place of a run of documents."""
    out: list[tuple[str, bool, np.ndarray, np.ndarray, np.ndarray]] = []
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return out
    raw = low.tobytes()
    by_word = known[np.argsort(ids[known], kind="stable")]
    bounds = np.searchsorted(ids[by_word], np.arange(len(index.vocabulary) + 1))
    present = np.zeros((n_docs, len(index.vocabulary)), dtype=bool)
    present[w.doc[known], ids[known]] = True
    for label, seq, rare, postings, phrases, base, long in index.templates:
        own = present[:, rare]
        if not long:
            (phrase, _, text) = phrases[0]
            whole = own.all(axis=1)
            p = by_word[bounds[rare[0]] : bounds[rare[0] + 1]]  # of a file that has all of its words, the rarest
            p = p[whole[w.doc[p]]]
            found = _phrase_at(raw, w, ids, np.unique(np.concatenate([p - t for t in postings[0]])), phrase, text)
            out.append((label, base, w.doc[found], found, np.ones(len(found))))
            continue
        mandatory = present[:, np.unique(np.concatenate([phrase for phrase, _, _ in phrases]))].all(axis=1)
        if not mandatory.any():
            continue
        anchors = own & (np.cumsum(own, axis=1) <= ANCHORS) & mandatory[:, None]  # without the words of its key phrases a file has no place
        votes = []
        for k, x in enumerate(rare.tolist()):
            p = by_word[bounds[x] : bounds[x + 1]]
            p = p[anchors[w.doc[p], k]]
            votes += [(p, p - t, k) for t in postings[k].tolist()]
        places = np.concatenate([p for p, _, _ in votes])
        if not len(places):
            continue
        drift = len(seq) // 2
        # alignment relative to the document, shifted so that it stays positive, in cells of ``drift`` words
        aligned = np.concatenate([a for _, a, _ in votes]) - w.first[w.doc[places]] + len(seq)
        cell = np.stack((w.doc[places], aligned // drift, np.repeat([k for _, _, k in votes], [len(p) for p, _, _ in votes])))
        both = np.unique(np.concatenate((cell, cell - np.array([[0], [1], [0]])), axis=1), axis=1)  # a drift may cross a cell's edge
        key, count = np.unique(both[:2], axis=1, return_counts=True)
        key = key[:, count >= VOTES]
        where = [(_phrase_at(raw, w, ids, by_word[bounds[phrase[0]] : bounds[phrase[0] + 1]], phrase, text), t) for phrase, t, text in phrases]
        proposed: dict[int, list[tuple[float, int]]] = {}
        for d, c in key.T.tolist():
            start = int(w.first[d]) + c * drift - len(seq)
            near = [at[np.searchsorted(at, start + t - drift) : np.searchsorted(at, start + t + 3 * drift)] for at, t in where]
            if all((w.doc[at] == d).any() for at in near):
                inside = np.arange(start, start + 2 * drift)[:, None] + np.arange(len(seq))[None]
                use = (inside >= w.first[d]) & (inside < w.first[d + 1])
                share = ((ids[np.clip(inside, 0, len(ids) - 1)] == seq[None]) & use).sum(axis=1) / len(seq)
                best = int(share.argmax())
                proposed.setdefault(d, []).append((-float(share[best]), max(start + best, int(w.first[d]))))
        hits: list[tuple[int, int, float]] = []
        for d, own_places in proposed.items():
            taken: list[int] = []
            for share, s in sorted(own_places):
                if all(abs(s - other) >= len(seq) for other in taken):
                    taken.append(s)
                    hits.append((d, s, -share))
        out.append((label, base, *(np.array([h[k] for h in hits], dtype=t) for k, t in enumerate((np.int64, np.int64, np.float64)))))
    return out


_HITS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))


_ARROW_HITS = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, over all of them; at most one row a licence word reaches the driver."""
    vocabulary = Index().vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = Index(), np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            buf, off = tb.flat(batch.column(0))
            for i, j in tb.slices(off):
                _, w, ids = _vocabulary_ids(index, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                known = ids >= 0
                pairs = np.unique(w.doc[known] * len(vocabulary) + ids[known])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total, pa.int64())], names=["word", "df"])

    counted = docs.select("text").mapInArrow(tb.trimmed(run), "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return {vocabulary[r.word]: r.df for r in counted.collect()}, docs.count()


def scan_licenses(docs: DataFrame, *, frequencies: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """``docs`` with n_words and license_hits: every verified place (label, word, score, base)."""
    docs = spread(docs.drop("n_words", "license_hits"))
    df, n_docs = frequencies or document_frequencies(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("license_hits", _HITS)])
    carried = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n_docs)
        for batch in batches:
            buf, off = tb.flat(batch.column("text"))
            counts, hits = [], []
            for i, j in tb.slices(off):
                low, w, ids = _vocabulary_ids(index, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts.append(w.counts)
                own: dict[int, list[dict]] = {}
                for label, base, doc, word, score in match(index, low, w, ids, j - i):
                    for d, p, s in zip(doc.tolist(), word.tolist(), score.tolist(), strict=True):
                        own.setdefault(d, []).append({"label": label, "word": p - int(w.first[d]), "score": s, "base": base})
                hits += [sorted(own.get(d, []), key=lambda h: (h["word"], h["label"])) for d in range(j - i)]
            yield tb.extend(batch, carried, n_words=pa.array(np.concatenate(counts) if counts else [], pa.int64()), license_hits=pa.array(hits, _ARROW_HITS))

    return docs.mapInArrow(tb.trimmed(run), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``scan_licenses``' result."""
    base = F.filter("license_hits", lambda h: h["base"])
    place = F.transform(base, lambda h: h["word"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("license_hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("license_hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
