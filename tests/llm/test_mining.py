"""Collocations, filter interactions and embedding near-duplicates against brute force."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quirelight.llm import collocations as C
from quirelight.llm import filter_audit as A
from quirelight.llm import hnsw as H

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def collocations(rows, least, top=2_000):
    f: dict[str, Counter] = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        covered = {p[i : i + k] for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if own[p[i : i + k]] <= found[p]}
        ranked = []
        for p, a in found.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def mined(docs, **how):
    return sorted(tuple(r) for r in C.collocations(docs, **how).collect())


@pytest.mark.parametrize("how", [{}, {"shard_phrases": 7, "group_bytes": 2_000, "block_bytes": 10_000}, {"bits": 1 << 15, "shard_phrases": 50}])
def test_collocations(spark, sf, how):
    """Also with many shards and groups, and with bitmaps so small that they are full."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = collocations([(r.text, r.lang) for r in docs.collect()], 30)
    assert len(want) > 20 and any(len(r[2].split()) > 2 for r in want)
    assert mined(docs, least=30, **how) == want


def test_collocations_messy(spark, messy, empty):
    rows = [(r.text, r.lang) for r in messy.collect()]
    assert mined(messy, least=2) == collocations(rows, 2)
    assert mined(messy, least=2, top=3) == collocations(rows, 2, 3)
    assert mined(empty) == []
    odd = [("a a a a a, A a\tb;b  b\x0bb b\n\n. é€ é€ é€ é€ \x00 x \x00 x", None), ("", "en"), ("a a a a a, A a\tb;b  b\x0bb b\n\n. é€ é€ é€ é€ \x00 x \x00 x", "und"), (None, None), ("one two " * 50_000 + "y" * 3_000_000, "fr")]
    assert mined(spark.createDataFrame(odd, "text string, lang string"), least=2) == collocations(odd, 2)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n / (l * r) in whole numbers of more than 64 bits."""
    got = spark.sql("select cast((1000 * cast(900000000000 as decimal(18, 0)) * cast(900000000000001 as decimal(18, 0))) div (cast(900000000001 as decimal(18, 0)) * cast(900000000007 as decimal(18, 0))) as bigint) x").first().x
    assert got == 1000 * 900000000000 * 900000000000001 // (900000000001 * 900000000007)


def audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first: dict[str, int] = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    kinds: dict[str, Counter] = {}
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^ \t-\r]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        kinds.setdefault(source or "", Counter())[frozenset(x for x in fails if fails[x]), i in good, i in toxic] += 1
    out = []
    for part, own in kinds.items():
        removed = Counter()
        rows = []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = lambda fails: fails & set(order[:k])  # noqa: E731, B023
                count = lambda test: sum(n for (fails, g, t), n in own.items() if test(fails, g, t))  # noqa: E731, B023
                now = count(lambda f, g, t: x in f and not gone(f))
                removed[x] += now
                rows.append(("".join(order), k + 1, x, count(lambda f, g, t: x not in f and not gone(f)), now, count(lambda f, g, t: x in f and bool(gone(f))), count(lambda f, g, t: f == {x}), count(lambda f, g, t: x in f and not gone(f) and g), count(lambda f, g, t: x in f and not gone(f) and t)))
        out += [(part, o, k, x, *counts, removed[x]) for o, k, x, *counts in rows]
    return sorted(out)


def audited(docs, labels):
    return sorted(tuple(r) for r in A.audit(docs, labels).collect())


def test_audit_messy(spark, messy, empty):
    given = [(1, 1, None), (1, 0, 1), (2, None, 1), (None, 1, 1), (3, 0, 0), (5, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    extra = [(0, None, "s0"), (0, "0", "s0"), (None, "A B", None), (None, "A B", ""), (None, "A B", ""), (7, "A  B# " * 300, "s0"), (8, "A  B# " * 300, "s0"), (8, "A  B# " * 300, "s0"), (-4, "A  B# " * 300, "\x00x"), (20, "w " * 400_000, "s1")]
    docs = messy.select("doc_id", "text", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    rows = [tuple(r) for r in docs.collect()]
    want = audit(rows, given)
    assert audited(docs.withColumns({"n": docs.doc_id, "good": docs.doc_id, "word": docs.text, "id": docs.doc_id, "h": docs.doc_id}), labels) == want
    assert audited(docs, labels.where("false")) == audit(rows, [])
    assert A.audit(empty, labels).count() == 0


def test_audit_is_relational(spark, sf):
    """No Python in the plan, and words are never shuffled."""
    plan = A.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*word", plan)


def vectors(rng, label, groups, noise, dim=24):
    """Groups of near copies around random directions."""
    out = []
    for size in groups:
        centre = rng.normal(size=dim)
        out += [(label, (centre + noise * rng.normal(size=dim)) * rng.uniform(0.5, 2)) for _ in range(size)]
    return out


def neighbours(spark, rows, **how):
    given = spark.createDataFrame([(None if i is None else int(i), None if l is None else int(l), None if v is None else [None if x is None else float(x) for x in v]) for i, l, v in rows], "vec_id long, label int, embedding array<float>")
    return given, [(r.vec_id, r.n_links, r.component_id, r.kept) for r in H.near_vectors(given, **how).collect()]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 24 * 8 * 60, "block_rows": 100}])
def test_near_vectors(spark, how):
    """Groups of all sizes, some linked only through others; one shard or many."""
    rng = np.random.default_rng(4)
    made = vectors(rng, 1, [120, 40, 9, 2, 2, 2] + [1] * 120, 0.18) + vectors(rng, 2, [30] + [1] * 20, 0.32) + vectors(rng, 3, [1], 0.1)
    rows = [(10 * i, label, v) for i, (label, v) in enumerate(made)]
    rows += [(10 * i + 1, rows[i][1] if i % 3 else 3, rows[i][2]) for i in range(0, 200, 7)]
    given, got = neighbours(spark, rows, **how)
    want = H.brute_force([(r.vec_id, r.label, r.embedding) for r in given.collect()])
    assert len(got) == len(rows)
    want = {i: value for (i, _, _), value in want.items()}
    found = {i: (n, c) for i, n, c, _ in got}
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in want.values()) > 3_000
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_near_vectors_messy(spark):
    nan, inf, e = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(1, 1, e), (2, 1, e), (2, 1, e), (3, 2, e), (4, None, e), (None, 1, e), (5, 1, None), (6, 1, [0.0, 0.0, 0.0]), (7, 1, [nan, 1.0, 1.0]), (8, 1, [inf, 1.0, 1.0]), (9, 1, [None, 1.0, 1.0]), (10, 1, []), (11, 1, [1.0, 2.0]), (12, 1, [2.0, 4.0]), (13, 1, [-1.0, -2.0, -3.0]), (0, 1, [1.0, 2.0, 3.1]), (14, None, None), (15, 1, [1.0] * 4000), (16, 1, [2.0] * 4000)]
    given, got = neighbours(spark, rows)
    assert len(got) == len(rows)
    one = {i: (n, c, k) for i, n, c, k in got}
    assert one[0] == (2, 0, True) and one[1] == (2, 0, False) and one[2] == (2, 0, False) and one[11] == (1, 11, True) and one[12] == (1, 11, False) and one[16] == (1, 15, False)
    assert all(one[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13, 14)) and one[None] == (0, None, True)
    clash = given.withColumns({"n_links": given.label, "node": given.label, "component_id": given.label, "weight": given.label, "dim": given.label})
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in H.near_vectors(clash).collect()) == sorted((i is None, i or 0, n, c or 0) for i, n, c, _ in got)
    assert H.near_vectors(given.where("false")).count() == 0


def test_folding_is_exact():
    """A dense group: few balls, all links counted, though no pair is emitted."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=64) + 0.12 * rng.normal(size=(1500, 64)), rng.normal(size=(300, 64))))
    shard = H.Shard(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, H.COSINE)
    norm = np.linalg.norm(x, axis=1)
    truth = ((x @ x.T) / (norm[:, None] * norm) >= H.COSINE).sum(axis=1)
    query, ball, weight = shard.audited(x, shard.ball, recall=0.99, audited=64)
    assert len(shard.leader) < 330 and len(query) < 20_000
    assert (np.bincount(query, weights=weight, minlength=len(x)) == truth).all()
