"""Whole runs over containers, offline."""

import io
import json
import os
import time
import zipfile

import pytest

from quirelight import cli
from quirelight.functions.text import plain_strip
from quirelight.operators import books as B
from quirelight.operators import prompt as P
from quirelight.operators import reports as R
from quirelight.operators import segments as G
from quirelight.operators import translate as T
from quirelight.operators.cache import Store
from quirelight.operators.provider import Completion, ProviderError, Usage, capitals
from quirelight.operators.settings import Settings
from quirelight.sources import epub as E

PAGE = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>{t}</title></head><body><h1>{t}</h1>{b}</body></html>'


def container(title="A tale", chapters=3, extra=()):
    def text(k):
        return "".join(f"<p>Paragraph {i} of chapter {k} &amp; <em>more</em>.</p>" for i in range(4))

    files = [
        ("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'),
        ("O/p.opf", (f'<package version="3.0"><metadata><title> {title} </title><language>en</language></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
         + "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(chapters)) + "</manifest><spine>" + "".join(f'<itemref idref="c{k}"/>' for k in range(chapters)) + "</spine></package>").encode()),
        ("O/nav.xhtml", ("<nav>" + "".join(f'<a href="c{k}.xhtml">Part {k}</a>' for k in range(chapters)) + "</nav>").encode()),
        *[(f"O/c{k}.xhtml", PAGE.format(t=f"Chapter {k}", b=text(k)).encode()) for k in range(chapters)],
        ("O/s.css", b"p {}"),
    ]
    return E.encode([(n, dict(extra).get(n, d)) for n, d in files])


def table(spark, *contents):
    return spark.createDataFrame([(f"b{i}", c) for i, c in enumerate(contents)], "book_id string, content binary")


def files_of(run):
    return {r.book_id: {n: d for n, d, _ in E.unzip(bytes(r.content))} for r in run.books.collect() if r.content is not None}


def offline():
    return lambda: capitals


def test_container_in_container_out(spark, tmp_path):
    raw = container()
    run = B.translate(table(spark, raw, b"junk"), offline(), str(tmp_path / "run"), Settings())
    before, after = {n: d for n, d, _ in E.unzip(raw)}, files_of(run)
    assert set(after) == {"b0"} and list(after["b0"]) == list(before)
    assert after["b0"]["O/s.css"] == before["O/s.css"] and b"<language>fr</language>" in after["b0"]["O/p.opf"]
    page = after["b0"]["O/c1.xhtml"].decode()
    assert 'lang="fr"' in page and "<p>PARAGRAPH 2 OF CHAPTER 1 &amp; <em>MORE</em>.</p>" in page and "<title>CHAPTER 1</title>" in page
    assert b"PART 2" in after["b0"]["O/nav.xhtml"]
    states = {r.path: r for r in run.states.collect()}
    assert [states[p].k for p in ("O/c0.xhtml", "O/c1.xhtml", "O/c2.xhtml", "O/nav.xhtml")] == [0, 1, 2, 3] and states["O/nav.xhtml"].title == E.NAVIGATION and states["O/c0.xhtml"].title == "Part 0"
    assert all(r.status == "done" and r.done == r.total and list(r.pending) == [] for r in states.values())
    total = run.totals.first()
    assert (total.documents, total.translated, total.pending, total.retryable, total.input) == (4, total.segments, 0, False, None) and total.usable == total.attempted > 0
    pieces = B.texts(table(spark, raw), run.changed).orderBy("k").collect()
    text = "".join(p.piece for p in pieces)
    assert text.startswith("A tale\n======\n\nCHAPTER 0\n\nPARAGRAPH 0 OF CHAPTER 0 & MORE.") and text.endswith("\n")


def test_titles_only_and_ranges(spark, tmp_path):
    run = B.translate(table(spark, container()), offline(), str(tmp_path / "a"), Settings(translate_titles=False), spec="2-")
    page = files_of(run)["b0"]
    assert page["O/c0.xhtml"] == dict((n, d) for n, d, _ in E.unzip(container()))["O/c0.xhtml"] and b"<h1>Chapter 1</h1><p>PARAGRAPH" in page["O/c1.xhtml"] and b"Part 1" in page["O/nav.xhtml"]
    assert {r.path: r.total for r in run.states.collect()} == {"O/c1.xhtml": 4, "O/c2.xhtml": 4, "O/nav.xhtml": 0}
    only = spark.createDataFrame([("b0", "O/c2.xhtml")], "book_id string, path string")
    assert [r.path for r in B.translate(table(spark, container()), offline(), str(tmp_path / "b"), Settings(), only=only).states.collect()] == ["O/c2.xhtml"]


def test_unreadable_and_untranslated(spark, tmp_path):
    """A document that is refused, and one where nothing comes back, fail and keep their bytes; the others are done."""
    bad, void = PAGE.format(t="x", b="<p>x</p>").replace('version="1.0"', 'version="1.0" encoding="ISO-8859-1"').encode(), PAGE.format(t="VOID", b="<p>VOID</p>").encode()

    def make():
        def provider(sources):
            return ["" if "VOID" in s else a for s, a in zip(sources, capitals(sources), strict=True)]

        return provider

    run = B.translate(table(spark, container(extra=[("O/c0.xhtml", bad), ("O/c1.xhtml", void)])), make, str(tmp_path / "r"), Settings())
    states, after = {r.path: r for r in run.states.collect()}, files_of(run)["b0"]
    assert states["O/c0.xhtml"].status == states["O/c1.xhtml"].status == "failed" and states["O/c0.xhtml"].error
    assert after["O/c0.xhtml"] == bad and after["O/c1.xhtml"] == void and b"CHAPTER 2" in after["O/c2.xhtml"]
    total = run.totals.first()
    assert (total.failed, total.done, total.retryable) == (2, 2, True)
    assert {(r.seg, r.message) for r in run.notes.where("doc_id like '%c1%'").collect()} == {(i, B.PROBLEMS["blank"]) for i in range(3)}


def test_every_verdict_is_a_note(spark, tmp_path):
    spoilt = {"Paragraph 0": "", "Paragraph 1": "a\x02b", "Paragraph 2": "<em>open", "Paragraph 3": "no tags any more"}

    def make():
        def provider(sources):
            return [next((a for k, a in spoilt.items() if k in s), s.upper() if "<" not in s else s) for s in sources]

        return provider

    run = B.translate(table(spark, container(chapters=1)), make, str(tmp_path / "r"), Settings(salvage_pass=False))
    page = files_of(run)["b0"]["O/c0.xhtml"].decode()
    assert "<p>no tags any more</p>" in page and "Paragraph 2 of chapter 0 &amp; <em>more</em>." in page
    notes = {r.seg: r.message for r in run.notes.where("doc_id like '%c0%'").collect()}
    assert notes == {2: B.PROBLEMS["blank"], 3: B.PROBLEMS["unsafe"], 4: B.PROBLEMS["broken"], 5: B.PROBLEMS["tags"]}


def chat(log):
    """Makes a prompted service: answers in JSON, with remarks and usage; keeps what it was asked in a file."""

    class Chat:
        def complete(self, request):
            sources = json.loads(request.user.rsplit("\n", 1)[1])
            with open(log, "a") as f:
                f.write(json.dumps([request.system, request.user]) + "\n")
            return Completion(json.dumps({"translations": capitals(sources), "notes": ["same remark", f"about {len(sources)}", " "]}), Usage(10, 5))

    return Chat


def test_prompts_continuity_remarks_usage(spark, tmp_path):
    log = str(tmp_path / "log")
    settings = Settings(max_segments=2, context_chars=30, glossary="em: stress", about="a test", target_language="Dutch", target_code="nl")
    progress = T.Progress(spark)
    run = B.translate(table(spark, container(chapters=2)), chat(log), str(tmp_path / "r"), settings, progress=progress)
    asked = [json.loads(x) for x in open(log)]
    assert "written in" not in asked[0][0] and "The book is written in Old Norse." in P.system_text(Settings(source_language=" Old Norse "))
    assert len({s for s, _ in asked}) == 1 and "Dutch" in asked[0][0] and "em: stress" in asked[0][0] and "a test" in asked[0][0]
    users = [u for _, u in asked]
    assert all(u.startswith("Book: A tale\n") for u in users) and "Passage 1 of 3: Part 0\nPart 1 of 3" in users[0] and "so far" not in users[0]
    for before, after in zip(users, users[1:]):  # one book, one order: each batch is shown the end of the one before, also over documents
        said = " ".join(plain_strip(x) for x in capitals(json.loads(before.rsplit("\n", 1)[1])))
        assert f"so far ends:\n{'…' + said[-30:] if len(said) > 30 else said}\n" in after
    assert progress.now() == {"batches": len(asked), "segments": (n := run.totals.first().segments), "accepted": n, "calls": len(asked), "usable": len(asked), "input": 10 * len(asked), "output": 5 * len(asked)}
    remarks = run.notes.where("remark").collect()
    assert all(r.seg == -1 for r in remarks) and {r.message for r in remarks if "c0" in r.doc_id} == {"same remark", "about 2"}
    total = run.totals.first()
    assert (total.input, total.output, total.cache_read, total.attempted) == (10 * len(asked), 5 * len(asked), None, len(asked)) and total.pending == 0


def test_rate_reaches_the_limiter(spark, tmp_path, monkeypatch):
    """Slots of a run are spaced by the settings' rate, shared by its partitions."""
    import time

    settings = Settings(requests_per_minute=6000 * 4, max_segments=1, salvage_pass=False, context_chars=10)
    began = time.time()
    run = B.translate(table(spark, container(chapters=4)), offline(), str(tmp_path / "r"), settings)
    calls = run.totals.first().attempted
    assert calls > 20 and time.time() - began > (calls - 1) * 60 / settings.requests_per_minute  # one book is one partition: a fourth of the rate
    from quirelight.operators.provider import interval

    assert interval(60) == 1.0 and interval(60, 5) == 5.0 and interval(0) == interval(-1) == 0.0


def test_store_resume_retry_discard(spark, tmp_path):
    store, found = Store(spark, str(tmp_path / "store")), table(spark, container(chapters=2))
    log = str(tmp_path / "log")

    def make(bad):
        def provider(sources):
            with open(log, "a") as f:
                f.writelines(s + "\n" for s in sources)
            return ["" if bad and bad in s else a for s, a in zip(sources, capitals(sources), strict=True)]

        return lambda: provider

    run = lambda make, name, **more: (open(log, "w").close(), B.translate(found, make, str(tmp_path / name), Settings(salvage_pass=False), store=store, **more))[1]
    first = run(make("Paragraph 2"), "a")
    assert first.totals.first().pending == 2 and {r.status for r in first.states.collect()} == {"done"}
    listed = store.runs().collect()
    assert [(r.book_title, r.target_language, r.documents, r.done, r.pending) for r in listed] == [("A tale", "French", 3, 3, 2)]
    second = run(make(None), "b")  # nothing is asked, what is pending stays
    assert open(log).read() == "" and {r.status for r in second.states.collect()} == {"cached"} and second.totals.first().pending == 2 and second.totals.first().segments == 0
    assert files_of(second) == files_of(first)
    third = run(make(None), "c", retry=True)
    assert sorted(open(log).read().split("\n")) == ["", *(f"Paragraph 2 of chapter {k} &amp; <em>more</em>." for k in (0, 1))]
    assert third.totals.first().pending == 0 and b"PARAGRAPH 2" in files_of(third)["b0"]["O/c1.xhtml"] and store.runs().first().pending == 0
    other = B.translate(found, make(None), str(tmp_path / "d"), Settings(target_language="Dutch"), store=store)  # another recipe
    assert other.totals.first().cached == 0 and store.runs().count() == 2
    assert store.discard(listed[0].recipe) and not store.discard(listed[0].recipe) and [r.target_language for r in store.runs().collect()] == ["Dutch"]


def test_fatal_stops_the_run(spark, tmp_path):
    def make():
        def provider(_):
            raise ProviderError("key", 401)

        return provider

    run = B.translate(table(spark, container()), make, str(tmp_path / "r"), Settings(context_chars=10))
    states = run.states.orderBy("k").collect()
    assert [r.status for r in states] == ["failed", "pending", "pending", "pending"] and sum(r.calls for r in states) == 1 and "key" in states[0].error
    assert files_of(run)["b0"]["O/c0.xhtml"] == {n: d for n, d, _ in E.unzip(container())}["O/c0.xhtml"]


def logged(log, dies=None, lives=None):
    """Makes a provider that writes down what it is asked, and dies at one string for as long as a file is not there."""

    def made():
        def provider(sources):
            if dies and any(dies in s for s in sources) and not os.path.exists(lives):
                os._exit(1)
            with open(log, "a") as f:
                f.writelines(s + "\n" for s in sources)
            return capitals(sources)

        return provider

    return made


@pytest.mark.parametrize("context", [0, 40])
def test_killed_run_goes_on(spark, tmp_path, context):
    """The worker dies at one chapter; the next start asks for what was not committed, and for nothing else."""
    found, log, lives = table(spark, *[container(f"Tale {i}", chapters=4, extra=[("O/c2.xhtml", PAGE.format(t="Chapter 2", b=f"<p>Deadly {i}</p>" if i == 5 else f"<p>Mild {i}</p>").encode())]) for i in range(6)]), str(tmp_path / "log"), str(tmp_path / "lives")
    settings, store = Settings(context_chars=context, salvage_pass=False), Store(spark, str(tmp_path / "store"))
    make = logged(log, "Deadly", lives)
    run = lambda: B.translate(found, make, str(tmp_path / "run"), settings, store=store)
    with pytest.MonkeyPatch.context() as m, pytest.raises(Exception, match="(?i)crashed|EOF|exited"):
        if not context:
            m.setattr(T.Options, "of", classmethod(lambda cls, s: T.Options(settings=s, wave=2)))
        run()
    paid = open(log).read().split("\n")
    stored = {r.path for r in store._documents().collect()}
    assert len(paid) > 20 and stored  # documents that had ended are in the store
    committed = spark.read.parquet(*[str(p) for p in (tmp_path / "run").glob("attempts-log/*/*") if (p / "_SUCCESS").exists()])
    known = sorted(s for r in committed.collect() for s in r.sources)
    open(log, "w").close()
    open(lives, "w").close()
    again = run()
    asked = [s for s in open(log).read().split("\n") if s]
    every = sorted(s for i in range(6) for s in [*(f"Part {k}" for k in range(4)), *(x for k in range(4) for x in ([f"Chapter {k}", f"Chapter {k}"] + ([f"{'Deadly' if i == 5 else 'Mild'} {i}"] if k == 2 else [f"Paragraph {n} of chapter {k} &amp; <em>more</em>." for n in range(4)])))])
    assert sorted(known + asked) == every and not any("Deadly" in s for s in known) and len(known) > 20
    assert again.totals.agg({"pending": "sum"}).first()[0] == 0 and all(b"DEADLY 5" in f["O/c2.xhtml"] for b, f in files_of(again).items() if b == "b5")
    assert not (tmp_path / "run" / "attempts-log").exists()  # a run that has ended begins anew


def test_one_fatal_answer_stops_the_run(spark, tmp_path):
    """A refused key costs one call; a fatal answer in the middle one call a running task; the rest stays pending and the store intact."""
    log = str(tmp_path / "log")

    def make(after):
        def made():
            def provider(sources):
                with open(log, "a") as f:
                    f.write("x\n")
                if len(open(log).read()) // 2 > after:
                    raise ProviderError("key", 401)
                return capitals(sources)

            return provider

        return made

    found, store = table(spark, *[container(f"Tale {i}") for i in range(8)]), Store(spark, str(tmp_path / "store"))
    run = B.translate(found, make(0), str(tmp_path / "a"), Settings(context_chars=0), store=store)
    assert open(log).read() == "x\n" and {r.status for r in run.states.collect()} == {"failed", "pending"} and store._documents().count() == 0
    open(log, "w").close()
    run = B.translate(found, make(10), str(tmp_path / "b"), Settings(context_chars=0, max_segments=3), store=store)
    calls, states = len(open(log).read()) // 2, run.states.collect()
    assert 11 <= calls <= 10 + spark.sparkContext.defaultParallelism and sum(r.status == "pending" for r in states) >= 8
    open(log, "w").close()
    last = B.translate(found, make(1000), str(tmp_path / "b"), Settings(context_chars=0, max_segments=3), store=store)
    assert {r.status for r in last.states.collect()} <= {"done", "cached"} and last.totals.agg({"pending": "sum"}).first()[0] == 0


def test_rate_is_of_the_run(spark, tmp_path):
    """Slots of all tasks, waves and passes are one schedule: no two calls are nearer than the gap, and none waits without need."""
    times = str(tmp_path / "times")

    def make():
        def provider(sources):
            with open(times, "a") as f:
                f.write(f"{time.time()}\n")
            return ["" if "Paragraph 3" in s else a for s, a in zip(sources, capitals(sources), strict=True)]

        return provider

    docs = spark.createDataFrame([(i, "\n".join(f"Paragraph {k} of {i}" for k in range(4))) for i in range(8)], "doc_id long, text string")
    T.translate(docs, make, str(tmp_path / "r"), options=T.Options(most=1, requests_per_minute=600, answer_attempts=1), salvage=make)
    at = sorted(float(x) for x in open(times))
    gaps = [b - a for a, b in zip(at, at[1:])]
    assert len(at) >= 40 and all(g > 0.1 - 0.06 for g in gaps) and at[-1] - at[0] >= (len(at) - 1) * 0.1 - 0.06
    assert sum(g < 0.16 for g in gaps) >= 0.6 * len(gaps)  # within a wave the rate is the one that was set, whatever the number of tasks


def test_failures_run_on_over_waves(spark, tmp_path):
    """With continuity a wave holds one batch a book; the guard counts over the waves."""
    log = str(tmp_path / "log")

    def make():
        def provider(sources):
            with open(log, "a") as f:
                f.write("x\n")
            raise ProviderError("busy", 400)

        return provider

    run = B.translate(table(spark, container(chapters=9)), make, str(tmp_path / "r"), Settings(context_chars=20, salvage_pass=False, max_segments=40))
    states = run.states.collect()
    assert sum(r.status == "pending" for r in states) >= 3 and len(open(log).read()) // 2 < 80


def test_progress_counts_once(spark, tmp_path):
    """A task that fails once and is repeated counts once."""
    failed, progress = str(tmp_path / "failed"), T.Progress(spark)

    def make():
        def provider(sources):
            if any("3 of" in s for s in sources) and not os.path.exists(failed):
                open(failed, "w").close()
                raise SystemExit
            return capitals(sources)

        return provider

    docs = spark.createDataFrame([(i, "\n".join(f"Paragraph {k} of {i}" for k in range(4))) for i in range(8)], "doc_id long, text string")
    segs = G.line_segments(docs)
    spark.sparkContext.setLogLevel("OFF")
    try:
        T.run(segs, make, str(tmp_path / "r"), progress=progress)
    except Exception:  # a local session does not repeat tasks: the run is started again
        T.run(segs, make, str(tmp_path / "r"), progress=progress)
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert progress.now()["segments"] == progress.now()["accepted"] == 32 and progress.now()["batches"] == 8


def test_second_pass_by_another_provider(spark, tmp_path):
    def first():
        return lambda sources: ["" if "Paragraph 1" in s else a for s, a in zip(sources, capitals(sources), strict=True)]

    def second():
        return lambda sources: ["SECOND <em>more</em>" for _ in sources]

    run = B.translate(table(spark, container(chapters=1)), first, str(tmp_path / "r"), Settings(), salvage=second)
    page = files_of(run)["b0"]["O/c0.xhtml"].decode()
    assert page.count("SECOND") == 1 and run.totals.first().pending == 0
    asked = spark.read.parquet(str(tmp_path / "r" / "salvage")).collect()
    assert [list(r.segs) for r in asked] == [[3]]


def test_metadata_and_worklist():
    files = {n: d for n, d, _ in E.unzip(container())}
    p = E.package(files)
    assert (p.path, p.title, p.language, p.version, p.nav, p.ncx) == ("O/p.opf", "A tale", "en", "3.0", "O/nav.xhtml", None)
    assert [w[0] for w in p.worklist()] == ["O/c0.xhtml", "O/c1.xhtml", "O/c2.xhtml", "O/nav.xhtml"]
    files["O/p.opf"] = files["O/p.opf"].replace(b"<spine>", b'<spine toc="x">').replace(b"</manifest>", b'<item id="x" href="t.ncx" media-type="text/xml"/></manifest>')
    files["O/t.ncx"] = b"<ncx><navMap><navPoint><navLabel><text>Old</text></navLabel><content src='c0.xhtml'/></navPoint></navMap></ncx>"
    p = E.package(files)
    assert p.ncx == "O/t.ncx" and p.chapters[0][1] == "Old" and p.worklist()[-1][0] == "O/t.ncx"


def test_command_line(spark, tmp_path, capsys):
    book, home = tmp_path / "Book.epub", str(tmp_path / "home" / "settings.json")
    book.write_bytes(container())
    assert cli.main(["--settings", home, "translate", str(book), "--to", "Dutch", "--code", "nl", "--format", "epub"], spark=spark) == 0
    out = capsys.readouterr()
    path = tmp_path / "Book.nl.epub"
    assert out.out.strip() == str(path) and "segments translated" in out.err and zipfile.is_zipfile(io.BytesIO(path.read_bytes()))
    glossary = tmp_path / "g.txt"
    glossary.write_text(" a: b \n")
    assert cli.main(["--settings", home, "--lang", "fr", "translate", str(book), "--format", "txt", "--chapters", "1", "--glossary-file", str(glossary), "-o", str(tmp_path / "o.txt")], spark=spark) == 0
    assert "segments traduits" in capsys.readouterr().err and (tmp_path / "o.txt").read_text().count("CHAPTER 0\n") == 1
    assert cli.main(["--settings", home, "translate", str(book), "--provider", "nobody"], spark=spark) == 2
    assert cli.main(["--settings", home, "config"]) == 0 and cli.main(["--settings", home, "providers"]) == 0 and cli.main(["version"]) == 0
    assert cli.VERSION in capsys.readouterr().out


def test_recipe_fields():
    from dataclasses import replace

    base = Settings()
    assert {c for c in R.RECIPE if replace(base, **{c: "other"}) != base} == set(R.RECIPE) and "requests_per_minute" not in R.RECIPE


@pytest.mark.parametrize("source,answer,block", [("a", None, True), ("a", " ", True), ("a", "x\x01", False), ("<b>a</b>", "<b>a", True), ("a &", "<b>", True), ("a", "<b>x</b>", False), ("a", "a" * 300, True), ("<b>a</b>", "a", True), ("a & b", "a & b", True)])
def test_judge_equals_the_columns(spark, source, answer, block):
    from quirelight.operators import verdicts as V

    rows = spark.createDataFrame([([source], [answer])], "lines array<string>, answers array<string>")
    from pyspark.sql import functions as F

    assert V.verdicts(rows, lambda i: F.lit(block)).first().verdicts == [V.judge(source, answer, block)[0]]


def test_documents_are_stored_once(spark, tmp_path, monkeypatch):
    """What a wave has stored and no later call has changed is not stored again, and containers are not read again for each wave."""
    scans, own = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, recipes, *a, **k: (scans.append(recipes._jdf.queryExecution().optimizedPlan().toString()), own(self, recipes, *a, **k))[1])
    store = Store(spark, str(tmp_path / "store"))
    B.translate(table(spark, container(chapters=2)), lambda: capitals, str(tmp_path / "r"), Settings(salvage_pass=False, context_chars=0), store=store)
    assert len(scans) >= 2 and all(s.startswith("Relation") for s in scans)
    rows = [r.path for r in spark.read.parquet(str(tmp_path / "store" / "judgements")).collect()]
    assert len(rows) == len(set(rows)) == 3 and [(r.documents, r.done, r.pending) for r in store.runs().collect()] == [(3, 3, 0)]
