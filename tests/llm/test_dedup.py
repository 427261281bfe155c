"""Near duplicates and repeated bytes against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirelight.llm import minhash as M
from quirelight.llm import registry as R
from quirelight.llm import suffix_dedup as S


def test_near_duplicates_on_table(spark, sf):
    want = M.brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = {r.doc_id: r for r in R.QUERIES["op4_minhash_near_dedup"](spark, sf).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_messy(messy, empty):
    rows = M.near_duplicates(messy).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count()
    assert got[2].component_id == 1 and got[6].component_id == 5 and got[12].component_id == 11 and not got[12].kept
    assert got[None].component_id is None and got[None].kept
    assert all(got[i].n_shingles == 0 and got[i].kept for i in (3, 4, 10)) and got[11].n_shingles == 1
    assert M.near_duplicates(empty).count() == 0


def test_large_bands_and_chains(spark):
    """A hot group: many near copies of one text, some linked only through others."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([f"c{k}" for k in range(i, i + 100)])) for i in range(0, 60, 3)]
    want = M.brute_force(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_short_near_copies(spark, tmp_path):
    """100,000 texts of 11 words and their first ten: six of seven shingles are common, registers are few, and no link is lost."""
    n = 100_000
    words = np.random.default_rng(8).integers(0, 1 << 24, (n, 11)).astype("U")
    texts = [" ".join(w) for w in words.tolist()]
    rows = pa.table({"doc_id": np.arange(2 * n), "text": [t for t in texts for t in (t, t[: t.rindex(" ")])]})
    pq.write_table(rows, tmp_path / "short.parquet", row_group_size=20_000)
    got = M.near_duplicates(spark.read.parquet(str(tmp_path / "short.parquet")))
    wrong = got.where("component_id != doc_id - doc_id % 2 or n_shingles != 7 - doc_id % 2 or kept != (doc_id % 2 = 0)")
    assert wrong.count() == 0 and got.count() == 2 * n


def test_strays_beside_a_large_component(spark):
    """A band of one large component, strays that join it or each other, and strays that join nothing."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:-2], f"x{i % 150}", f"y{i}"])) for i in range(400)]
    rows += [(1000 + i, " ".join([*base[: 92 - i % 7], *(f"z{i}_{k}" for k in range(8 + i % 7))])) for i in range(40)]
    rows += [(2000 + i, " ".join([*base[:70], *(f"v{i // 8}_{k}" for k in range(28)), f"u{i}"])) for i in range(40)]
    want = M.brute_force(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 10


def test_estimates():
    """The corrected estimate is close to the true Jaccard similarity."""
    import quirelight.llm.textbytes as tb

    for shared in (0, 50, 90, 100):
        texts = [" ".join([f"s{i}" for i in range(10 * shared)] + [f"{side}{i}" for i in range(10 * (100 - shared))]) for side in "ab"]
        raw = [t.encode() for t in texts]
        _, _, keys, bits = M.shingles(np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
        codes = M.registers(keys, bits, 2)
        sets = [set((keys << tb.U64(bits))[M.owners(keys, bits) == d].tolist()) for d in (0, 1)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(M.estimate(codes[0], codes[1], np.array(1000), np.array(1000)) - true) < 0.15


def test_repeats_on_table(spark, sf):
    want = S.brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.QUERIES["op7_suffix_array_dedup"](spark, sf).collect()}
    assert got == want


def test_repeats_messy(messy, empty):
    rows = S.digest(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r for r in rows}
    want = S.brute_force([(r.doc_id, r.text) for r in messy.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items() if i is not None} == want
    assert got[None].n_removed == 0 and got[None].n_bytes > 0
    assert S.digest(empty).count() == 0
    full = {r.doc_id: r for r in S.suffix_dedup(messy).collect()}
    assert full[9].text.startswith("un deux trois ") and full[9].text.endswith(" é€😀 fin") and full[9].n_words == "q"
    assert full[2].text == "" and full[1].text.startswith("the quick")


def test_repeats_of_one_byte(spark):
    rows = [(1, "a" * 400), (2, "a" * 120 + "b" + "a" * 49 + "b" + "a" * 50), (3, "é" * 60), (4, "x" + "é" * 24 + "y" + "é" * 26)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == S.brute_force(rows)


def test_repeats_of_a_hot_gram(spark):
    """One short line between many surroundings: a hash with many contents is split by windows, whatever the bound."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line, shared = "=" * 24, [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = [(i, "\n".join([" ".join(word() for _ in range(3)), line, " ".join(word() for _ in range(3)), shared[i % 4][: 30 + i % 50], line, line + line])) for i in range(300)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), S.brute_force(rows)
    for hot in (S.HOT, 40, 0):
        done = S._through(docs, S._digest_group, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", 4096, 2048, hot)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done.collect()} == want


def test_equal_hashes_are_no_copies(monkeypatch):
    """Contents count as equal by their bytes: with a hash that is the same for all, nothing is lost wrongly."""
    import pyarrow as pa

    monkeypatch.setattr(S.tb, "span_hash", lambda sums, start, end: np.zeros(len(start), dtype=np.uint64))
    texts = [chr(97 + i) * 60 for i in range(5)] + ["c" * 60]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    lost = S._lost(np.arange(6), np.zeros(6, dtype=np.int64), np.full(6, 60), raw, 1)
    doc, start, end, _ = S._unpack(lost[0][2], np.int64, np.int32, np.int32)
    assert pa.array(doc).to_pylist() == [5] and (start[0], end[0]) == (0, 60)


@pytest.mark.parametrize("n,letters", [(1, 3), (40, 1), (60, 2), (500, 3), (2000, 200)])
def test_suffix_array(n, letters):
    rng = np.random.default_rng(n)
    text = rng.integers(1, letters + 1, n).astype(np.uint8)
    text[rng.random(n) < 0.03] = 0
    sa = S.suffix_array(text, 50)
    padded = text.tobytes() + bytes(60)
    assert sorted(sa.tolist()) == list(range(n)) and [padded[i : i + 50] for i in sa] == sorted(padded[i : i + 50] for i in range(n))
