"""Chat rotation, quality, piece codec, language ID, neighbours and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F_

import corpus_pipeline as C
from quirelight.llm import ann as A
from quirelight.llm import chat_format as F
from quirelight.llm import decontaminate as D
from quirelight.llm import language_id as L
from quirelight.llm import minhash as M
from quirelight.llm import piece_codec as P
from quirelight.llm import quality as Q
from quirelight.llm import registry as R
from quirelight.llm import suffix_dedup as S


@pytest.mark.parametrize("name", sorted(R.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = R.QUERIES[name](spark, sf).toPandas(), con.sql(R.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    row = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert row(got) == row(want)


def test_rotation(spark):
    turns = spark.createDataFrame([(1, 0, "system", "rules", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 2000, None, "<|im_end|> x", 1), (1, 1, "ann", "hi", 1), (2, 0, "system", "alone", 1), (None, None, "eve", "e", 1)], "conv_id long, turn long, role string, text string, start int")
    rows = F.rotate(turns).collect()
    assert len(rows) == 5 * 3 + 1
    for who in ("ann", "bob", "unknown"):
        own = sorted((r for r in rows if r.perspective == who and r.conv_id == 1), key=lambda r: r.start)
        text = "".join(r.message for r in own)
        assert [r.start for r in own] == [0] + [r.end for r in own[:-1]] and own[-1].end == len(text)
        assert all((r.role == "assistant") == r.mask and text[r.start : r.end] == r.message for r in own)
        assert all(F.OPEN not in text[r.content_start : r.content_end] and F.CLOSE not in text[r.content_start : r.content_end] for r in own)
        assert {r.name for r in own} == {None, "ann", "bob", "unknown"} - {who}


def test_rotation_messy(spark):
    """A conversation over many runs of turns, names with line feeds, long texts, ties, nulls, clashing columns, no rows."""
    rows = [("hot", i, ["ann", "bob\n<|im_end|>", None, "system"][i % 4], f"text {i}" if i % 7 else None, "x") for i in range(3 * F.CHUNK)] + [("hot", 5, "ann", "tie", "x")] * 2 + [("long", 1, "a", "z" * 3_000_000, "x"), ("long", None, "b", "", "x"), (None, 1, "eve", "e", None)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, message string")
    out = F.rotate(turns).toPandas()
    assert len(out) == 3 * (3 * F.CHUNK + 2) + 2 * 2 + 1
    for (conv, who), own in out.groupby(["conv_id", "perspective"], dropna=False):
        own = own.sort_values("start")
        text = "".join(own.message)
        mine = sorted(((-1 if t is None else t, r or "unknown", x or "") for c, t, r, x, _ in rows if c == conv or c is None and conv != conv), key=lambda x: x)
        want = []
        for _, speaker, said in mine:
            name = speaker.replace("<|", "<\\|").replace("\n", "\\n")
            head = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={name}"
            want.append(f"<|im_start|>{head}\n" + said.replace("<|", "<\\|") + "<|im_end|>\n")
        assert text == "".join(want) and own.start.tolist() == [0, *own.end.tolist()[:-1]]
        assert all(text[a:b] == m.split("\n", 1)[1][: -len(F.CLOSE) - 1] for a, b, m in zip(own.content_start[:50], own.content_end[:50], own.message[:50]))
    none = F.digest(turns.where("false"))
    assert none.count() == 0 and "message_sha256" in none.columns


def test_quality(spark, sf, messy, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.digest(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.good == (out.quality == 1)).mean() > max(0.93, out.quality.mean())
    none = labels.where("false")
    assert {r.score for r in Q.digest(messy, none).collect()} == {0.5} and Q.digest(empty, none).count() == 0
    fitted = Q.train(docs, labels)
    assert Q.score(messy, fitted).count() == messy.count()


def test_co_training_over_all_rows(spark):
    """The distributed rounds against rounds with explicit sets of rows: the same scores, and every unlabelled row takes part."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kind, (models, lines, weights) = Q.train(docs, labels, labelled=200)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted(Q._featured(docs.select("doc_id", "text", "source", "lang", "n_chars")).collect())
    array = lambda some: Q._arrays(*(pa.array([bytes(r[c]) for r in some], pa.binary()) for c in (1, 2)))
    drawn = {r.doc_id for r in labels.where(f"pmod(xxhash64(doc_id, 1), 1 << 30) / (1 << 30) < {200 / len(known)}").collect()}
    own, pool = array([r for r in rows if r.doc_id in drawn]), array([r for r in rows if r.doc_id not in known])
    ids = [r.doc_id for r in rows if r.doc_id in drawn]
    y = np.array([known[i] for i in ids], dtype=float)
    kept = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids])
    fitted, label = [Q.Logistic().fit(v[~kept], y[~kept]) for v in own], [dict(), dict()]
    rate, n = y[~kept].mean(), Q.SHARE * len(pool[0])
    edges = np.linspace(-Q.SPAN, Q.SPAN, Q.BINS + 1)
    for _ in range(Q.ROUNDS):
        new = []
        for taker in (0, 1):
            z = [(float(v), i) for i, v in enumerate(fitted[1 - taker].logit(pool[1 - taker])) if i not in label[taker]]
            low = max([e for e in edges if sum(v < e for v, _ in z) <= max(1, n * (1 - rate))][-1], edges[np.searchsorted(edges, min(z)[0], side="right")])
            high = min([e for e in edges if sum(v >= e for v, _ in z) <= max(1, n * rate)][0], edges[np.searchsorted(edges, max(z)[0], side="right") - 1])
            new.append({i: float(v > 0) for v, i in z if v < min(low, 0) or v >= max(high, 0)})
        for taker in (0, 1):
            label[taker] |= new[taker]
            at = sorted(label[taker])
            for _ in range(Q.STEPS):
                x = np.concatenate((own[taker][~kept], pool[taker][at]))
                fitted[taker].step(fitted[taker].sums(x, np.concatenate((y[~kept], [label[taker][i] for i in at]))))
    assert kind == "views" and all(len(x) > 0.2 * len(pool[0]) for x in label)
    for a, b, v in zip(models, fitted, pool):
        assert np.allclose(a.logit(v), b.logit(v), atol=1e-6)


def test_quality_of_repeated_ids(spark):
    """One labelled id in a third of the rows: the sample takes it once."""
    rows = [(i, ("good words here " if i % 2 else "%% $$ ## ") * 9, "s", "en", 9) for i in range(60)] + [(3, "good words here " * 9, "s", "en", 9)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (2, 0)], "doc_id long, quality int")
    out = Q.digest(docs, labels).collect()
    assert len(out) == 100 and all(r.good == (r.doc_id % 2 == 1) for r in out)


def test_codec_equals_the_library():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), P.model(P.load())
    rng = np.random.default_rng(0)
    texts = ["Hello  world", " a", "a ", "\tx\ny", "é́ ﬁ ①", "", "   ", "日本語" * 50, "a\xa0b", "x\r\n\n y", "▁a▁▁b", "<s> hi </s>", "<0x41>", "a\x00b", "x" * 300 + " " * 40 + "y"]
    texts += ["".join(rng.choice(list("abcde  \nthein①é"), rng.integers(1, 120))) for _ in range(200)]
    buf, off = P.tb.flat(P._plain(pa.array(texts)))
    ids, first = P.encode_run(own, buf, off)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == sp.encode(texts)
    assert P.round_trips(own, ids, first, buf, off).all()


def test_codec_long_units_from_edges(monkeypatch):
    """Units of more than 64 characters are merged by the edges: without edges no piece is left, and no other table is read."""
    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), P.model(P.load())
    monkeypatch.setattr(own, "pieces", {}, raising=False)
    rng = np.random.default_rng(1)
    units = ["x" * 300, "short", "日本語の文章は空白なしで書かれる。" * 20, "é①" * 90] + ["".join(rng.choice(list("abcdetheinghan+/=AB09"), n)) for n in (65, 200, 5000)]
    ids, first = P.encode_units(own, [f" {u}".encode() for u in units])
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == sp.encode(units)
    monkeypatch.setattr(P, "edges", lambda own, text: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    ids, _ = P.encode_units(own, [b"x" * 300])
    assert ids.tolist() == [own.byte_id[ord("x")]] * 300


def test_codec_units_of_one_hash(monkeypatch):
    """Units are told apart by their bytes."""
    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), P.model(P.load())
    hashed = P.tb.span_hash
    monkeypatch.setattr(P.tb, "span_hash", lambda sums, start, end: hashed(sums, start, end) % np.uint64(7))
    buf, off = P.tb.flat(pa.array(["one two three four", "two three one", "", "four four"] * 3))
    ids, first = P.encode_run(own, buf, off)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == sp.encode(["one two three four", "two three one", "", "four four"] * 3)


def test_codec_on_table(spark, sf):
    """Every id of every document against the library, and every decoded text against its source."""
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rows = P.encode(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    for r in rows.collect():
        assert r.ids == sp.encode(r.text) and r.round_trip
    assert all(r.text == r.before for r in P.decode(rows.withColumnRenamed("text", "before")).collect())


def test_codec_messy(messy, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rows = P.encode(messy)
    for r in rows.collect():
        assert r.ids == sp.encode(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip
    assert all(r.text == (r.before or "") for r in P.decode(rows.withColumnRenamed("text", "before")).collect())
    assert P.digest(empty).count() == 0


def test_language(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.97
    got = {r.doc_id: r for r in L.digest(messy).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 8, 10)) and got[1].lang_pred in ("en", "fr")
    assert L.digest(empty).count() == 0
    unlabelled = messy.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in L.digest(unlabelled).collect()} == {"und"}


def test_language_equals_direct_convolution(spark, sf):
    """Predictions and scores against filters applied one by one, window by window."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = L.train(docs)
    got = {r.doc_id: r for r in L.identify(docs.select("doc_id", "text", "source"), net).collect()}
    for r in docs.where("doc_id % 5 = 0").collect():
        raw, total, n = np.frombuffer(r.text.encode(), dtype=np.uint8), np.zeros(len(net.labels)), 0
        for at in range(0, max(1, len(raw) - 3), L.STRIDE):
            window = np.zeros(L.WINDOW, dtype=np.int64)
            part = raw[at : at + L.WINDOW]
            window[: len(part)] = [b + 32 if 65 <= b <= 90 else b for b in part]
            pooled = [max(sum(net.filters[w][k][window[i + k], f] for k in range(w)) for i in range(L.WINDOW - w + 1)) for w in L.WIDTHS for f in range(2)]
            hidden = [sum(net.filters[w][k][window[k : L.WINDOW - w + 1 + k]] for k in range(w)).max(axis=0) for w in L.WIDTHS]
            assert np.allclose(np.array(hidden)[:, :2].reshape(-1), pooled)
            total += np.maximum(np.concatenate(hidden) + net.bias, 0) @ net.weights + net.offset
            n += 1
            if n > 40 and r.doc_id not in (0, 5):
                break
        if n <= 40 or r.doc_id in (0, 5):
            p = np.exp(total / n - (total / n).max())
            p /= p.sum()
            assert got[r.doc_id].lang_pred == net.labels[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-3


def test_language_sample_covers_whole_texts(spark):
    """What tells the languages apart stands at the ends of long texts, and one text is repeated over and over."""
    rng = np.random.default_rng(0)
    same = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400))
    rows = [(i, same + " " + " ".join("".join(rng.choice(list(letters), 6)) for _ in range(400)), lang) for i, (lang, letters) in enumerate([("x", "mnopq"), ("y", "rstuv")] * 40)]
    rows += [(1000 + i, same, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = L.train(docs)
    probe = spark.createDataFrame([(1, "mnopq nopqm opqmn" * 9), (2, "rstuv stuvr tuvrs" * 9)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.identify(probe, net).collect()} == {1: "x", 2: "y"}


def _recall(out, want):
    hit = sum(len({i for _, i in near} & {r.vec_id for r in out if r.query_id == q}) for q, near in want.items())
    return hit / max(1, sum(len(near) for near in want.values()))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, sf_dir):
    """Recall against brute force, exact scores, and the share of rows that the index retrieves."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    out, want = R.QUERIES["op9_nearest_neighbours"](spark, sf_dir).collect(), A.brute_force(rows)
    assert {r.query_id for r in out} == set(want) and _recall(out, want) >= 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in out:
        assert r.score == float(np.sqrt(np.cumsum((vectors[r.query_id] - vectors[r.vec_id]) ** 2)[-1])) and r.n_candidates < 0.7 * len(rows)
    assert all(sorted(r["rank"] for r in out if r.query_id == q) == list(range(1, 11)) for q in want)


def test_neighbours_messy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(400)]
    rows += [(500, [float("nan")] * 16), (600, [0.0] * 16), (700, None), (800, [1.0, None] * 8), (900, [1.0] * 3), (None, [1.0] * 16), (1000, rows[0][1]), (1001, rows[0][1]), (0, rows[0][1]), (100, rows[7][1])]
    rows += [(2000 + i, rows[3][1]) for i in range(150)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, rank int")
    out, want = A.nearest(table).collect(), A.brute_force(rows)
    assert {r.query_id for r in out} == {0, 100, 200, 300, 1000, 2000, 2100} == set(want) and _recall(out, want) >= 0.9
    assert {(r["rank"], r.vec_id, r.score) for r in out if r.query_id == 2100} == {(i + 1, [3, *range(2000, 2150)][i], 0.0) for i in range(10)}  # ties to smaller ids
    assert sorted(map(tuple, A.nearest(table).collect())) == sorted(map(tuple, out))  # an id with two vectors has one defined result
    assert A.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = A.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 2), (0, 2, 1)]


@pytest.mark.parametrize("ranged", [0, 3])
def test_directories_hold_the_ball(ranged):
    """Every code within ``parts * (reach + 1) - 1`` bits is retrieved, and nothing but rows that share a ball."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    mean, projection = A.fit(x, 40)
    learned = A.Learned(mean, projection, 10, 4, 2)
    shared = type("B", (), {"value": learned})()
    column = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), column(x)], names=["node", "embedding"])
    asked = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(np.zeros(20, dtype=np.int64)), column(x[:20] + 0.05)], names=["query_id", "query_block", "embedding"])
    posted = pa.Table.from_batches([*A._posted(shared, ranged, 0)([batch]), *A._posted(shared, ranged, 1)([asked])])
    got = set()
    for d in set(posted.column("directory").to_pylist()):
        for block, _, _, payload in zip(*A._looked_up(shared, ranged, 3)((pa.scalar(d),), posted.filter(pa.array([v == d for v in posted.column("directory").to_pylist()]))).to_pydict().values()):
            q, r = A._unpack([payload], np.int64, np.int64)
            assert (r % 3 == block).all()
            got |= set(zip(q.tolist(), r.tolist()))
    own, other = learned.values(x), learned.values(x[:20] + 0.05)
    apart = np.bitwise_count(own[None] ^ other[:, None])
    assert got == {(int(q), int(r)) for q, r in zip(*np.nonzero((apart <= 2).any(axis=2)))}
    assert {(int(q), int(r)) for q, r in zip(*np.nonzero(apart.sum(axis=2) <= 4 * 3 - 1))} <= got


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES:
        before = docs
        docs = C.written(stage(spark, docs, sf), f"test-{name}")
        if name != C.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(C.COLUMNS)
        assert 0 < docs.count() <= before.count()
    assert docs.where("not round_trip").count() == 0
    assert C.run(spark, sf).count() == docs.count()


def test_pipeline_messy(spark, sf, messy, empty):
    """Each stage's documents, as its docstring defines them."""
    rows, left = messy.unionByName(messy.where("doc_id = 2").withColumn("text", F_.lit("another text under the same id"))), {}
    for name, stage in C.STAGES:
        before = rows
        rows = C.written(stage(spark, rows, sf), f"messy-{name}")
        C.dropped(before)
        left[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in rows.collect())
    assert left["language_id"] == [-1, 1, 2, 2, 2, 2, 5, 6, 7, 9, 11, 12]
    assert left["minhash_near_dedup"] == left["suffix_array_dedup"] == [-1, 1, 5, 7, 9, 11]
    assert left["benchmark_decontamination"] == left["sentencepiece_codec"] == [-1, 1, 5, 7, 9, 11]
    for name, stage in C.STAGES:
        empty = C.written(stage(spark, empty, sf), f"empty-{name}")
        assert empty.count() == 0


def test_pipeline_keeps_rows_of_one_id(spark, sf):
    """Near duplicates: rows that are the same become one, rows of one id with different texts stay, whatever the order."""
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, words("a"), "en", "s", 1), (1, words("a"), "en", "s", 1), (1, words("a"), "de", "s", 1), (2, words("b"), "en", "s", 1), (2, words("c"), "en", "s", 1), (3, words("a") + " x", "en", "s", 1), (None, words("a"), "en", "s", 1)]
    for order in (rows, rows[::-1]):
        got = C.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()
        assert sorted((r.doc_id or 0, r.text[:1], r.lang) for r in got) == [(0, "a", "en"), (1, "a", "de"), (2, "b", "en"), (2, "c", "en")]


def test_pipeline_against_brute_force(spark):
    """The whole pipeline but its trained stage against plain code."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = C.written(C.languages(spark, docs, sf), "named")
    rows = {r.doc_id: r.text for r in named.collect()}
    near = M.brute_force(list(rows.items()))
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    cut = S.brute_force(list(rows.items()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    for i, text in rows.items():
        left = _without_repeats(i, rows)
        assert hashlib.sha256(left).hexdigest() == cut[i][3]
        left = left.decode("utf-8", "ignore")
        assert (i in got) == (D.brute_force(left, items)[1] == 0)
        if i in got:
            assert got[i].ids == sp.encode(left) and got[i].round_trip
    assert set(got) <= set(rows)


def _without_repeats(i, rows):
    raw = rows[i].encode()
    before = {t.encode()[k : k + 50] for j, t in rows.items() if j < i for k in range(len(t.encode()) - 49)}
    gone = [False] * len(raw)
    for k in range(len(raw) - 49):
        if raw[k : k + 50] in before:
            gone[k : k + 50] = [True] * 50
    return bytes(b for b, g in zip(raw, gone) if not g)
