"""License scan, decontamination, HTML extraction against brute force."""

import re
import time
from html.parser import HTMLParser

import pytest

from quirelight.llm import decontaminate as D
from quirelight.llm import html_extract as H
from quirelight.llm import license_scan as L
from quirelight.llm import registry as R


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_license(text):
    w, places, labels = words(text), [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_on_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in R.QUERIES["op1_license_scan"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        plain = f" {' '.join(words(texts[r.doc_id]))} "
        phrases = {label for label, text, keys in L.TEMPLATES if not keys and f" {text} " in plain} | set(filter(None, r.base_labels.split(",")))
        assert {x for x in r.labels.split(",") if x} - {label for label, _, keys in L.TEMPLATES if keys} == phrases


def test_license_messy(messy, empty):
    rows = L.digest(L.scan_licenses(messy)).collect()
    assert len(rows) == messy.count()
    seven = next(r for r in rows if r.doc_id == 7)
    assert (seven.base_labels, seven.n_base) == ("apache,cc-by,mit", 3)
    assert all(r.n_words == 0 and r.labels == "" and r.score == 0 and r.first_word is None for r in rows if r.doc_id in (3, 4, 10))
    assert L.digest(L.scan_licenses(empty)).count() == 0


def test_license_long_template(spark):
    text = "x y z. " + dict((a, b) for a, b, _ in L.TEMPLATES)["mit-text"].replace("the software to deal", "(the 'Software'), to deal") + " and more"
    docs = spark.createDataFrame([(1, text), (2, "permission is hereby granted to smile")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.digest(L.scan_licenses(docs)).collect()}
    assert "mit-text" in got[1].labels and got[1].score > 0.5 and got[2].labels == ""


LONG = [t for t in L.TEMPLATES if t[2]]


@pytest.mark.parametrize("label,text,keys", LONG)
def test_license_every_place(spark, label, text, keys):
    """Each copy of a long template, also with words put in, left out or spread over lines; none without a key phrase."""
    w = text.split()
    fill = [f"x{i}" for i in range(70)]
    inside = {i + k for key in keys for i in [next(i for i in range(len(w)) if w[i : i + len(key.split())] == key.split())] for k in range(1, len(key.split()))}
    cuts = [i for i in range(1, len(w)) if i not in inside]  # places between key phrases
    more = lambda at, n: w[:at] + [f"y{i}" for i in range(n)] + w[at:]
    rows = [(0, " ".join(fill + w + fill)), (1, " ".join(w + fill + w + fill + w)), (2, "\n* ".join(w).upper()), (3, " ".join(fill)), (4, " ".join(x for x in w if x not in keys[0].split()))]
    rows += [(10 + i, " ".join(fill + more(at, len(w) // 3) + fill)) for i, at in enumerate(cuts)]
    found = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), frequencies=({}, 100)).collect()
    places = {r.doc_id: [h.word for h in r.license_hits if h.label == label] for r in found}
    assert places[0] == [70] and places[1] == [0, len(w) + 70, 2 * (len(w) + 70)] and places[2] == [0] and places[3] == places[4] == []
    assert all(len(places[10 + i]) == 1 and abs(places[10 + i][0] - 70) <= len(w) // 3 for i in range(len(cuts)))
    assert all(h.score == 1 for r in found if r.doc_id < 3 for h in r.license_hits if h.label == label)


def test_license_words_are_compared(monkeypatch):
    """Words with one hash are no match."""
    import numpy as np
    import quirelight.llm.textbytes as tb

    index = L.Index()
    buf = np.frombuffer(b"mit license and mjt license", dtype=np.uint8)
    _, w, ids = L._vocabulary_ids(index, buf, np.array([0, len(buf)]))
    ids[3] = ids[0]
    hits = {label: at.tolist() for label, _, _, at, _ in L.match(index, tb.LOWER[buf], w, ids, 1)}
    assert hits["mit"] == [0]


def test_decontamination_on_table(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: D.brute_force(r.text, items) for r in docs.collect()}
    for bound, words in ((1 << 25, D.RUN_WORDS), (2_000, D.RUN_WORDS), (1 << 25, 7), (900, 3)):  # one set, chains of several, items in runs
        for r in D.digest(D.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), slice_bytes=bound, run_words=words)).collect():
            n, hit, found = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), D.sha(found), hit > 0)


def test_decontamination_compares_words(monkeypatch):
    """Windows of one hash are told apart, and each still finds its items."""
    import numpy as np
    import quirelight.llm.textbytes as tb

    monkeypatch.setattr(tb, "gram_hash", lambda hashed, n: np.zeros(max(0, len(hashed) - n + 1), dtype=tb.U64))
    own = D.WindowSet([(1, "a b c"), (2, "d e f"), (3, "d e f")], 3)
    buf = np.frombuffer(b"x d e f y a b d", dtype=np.uint8)
    _, hit, items = own.scan(buf, np.array([0, len(buf)]))
    assert np.flatnonzero(hit).tolist() == [1, 2, 3] and items == {0: {2, 3}}


def test_decontamination_messy(spark, messy, empty):
    bench = spark.createDataFrame([(1, "seven wizards quietly mix potions in the old tower by"), (1, "seven wizards quietly mix potions in the old tower by"), (2, "a b"), (3, None), (None, "jumps over the lazy dog while seven wizards quietly mix"), (12, "")], "item_id long, text string")
    found = D.decontaminate(messy, bench)
    rows = D.digest(found).collect()
    assert len(rows) == messy.count() and {r.doc_id for r in rows if r.contaminated} == {1, 2, 9, 11, 12, None}
    assert D.clean(found, ["doc_id"]).count() == messy.count() - sum(r.contaminated for r in rows)
    cut = {r.doc_id: r.text for r in D.clean(found, ["doc_id", "text"], how="spans").collect()}
    assert "wizards" not in cut[1] and cut[1].startswith("the quick") and cut[9].endswith("é€😀 fin")
    assert D.digest(D.decontaminate(empty, bench)).count() == 0
    assert not any(r.contaminated for r in D.digest(D.decontaminate(messy, bench.where("false"))).collect())


PAGE = """<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">The home of it</a></li></ul></nav><div class="cookie-notice">We use the cookies of this site and it is for you to accept that.</div>
<aside>In the sidebar there is a text of the kind that is not to be kept at all.</aside>
<article><h1>A &amp; B</h1><p>It was the best of times, it was the worst of times, it was the age of wisdom.<br>More of it</p><p>Short.</p><!-- c -->
<p>There is a <b>bold</b> word in this&nbsp;sentence and it is the last of the article.</p><form><p>Send the form to us and we will be in touch with you.</p></form></article>
<section id="comments"><p>I think that this is the best article of all that I have read in my life.</p></section><footer>&copy; The footer of the page</footer></body></html>"""


def test_html_rules():
    assert H.extract(PAGE).split("\n") == ["A & B", "It was the best of times, it was the worst of times, it was the age of wisdom. More of it", "Short.", "There is a bold word in this sentence and it is the last of the article."]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "<article>", "</p></p>", "&#x0;&bogus;", "<a" * 50, "<div>" * 500 + "x"])
def test_html_broken(page):
    assert isinstance(H.extract(page), str)


def test_html_without_article():
    body = "".join(f"<p>This is the paragraph number {i} of the text and it is as long as it has to be for the rules.</p>" for i in range(3))
    page = f"<div><a href=x>Home</a> <a href=y>About the site and all of us</a></div><div>{body}<p>Short one</p>{body}</div>"
    assert H.extract(page).count("\n") == 6 and "Home" not in H.extract(page)


def test_html_table(spark, sf):
    rows = R.QUERIES["op10_html_extraction"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)
    clash = spark.createDataFrame([(1, "u", None, "old"), (None, None, "<p>x", "old")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in H.extract_pages(clash).collect()} == {1: "", None: ""}
    none = H.digest(clash.where("page_id = -1"))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


PROSE = {
    "pl": "Wczoraj wieczorem mieszkańcy miasta spotkali się przed ratuszem, żeby porozmawiać o nowym moście przez rzekę.",
    "ru": "Вчера вечером жители города собрались перед ратушей, чтобы поговорить о новом мосте через широкую реку.",
    "ar": "اجتمع سكان المدينة مساء أمس أمام مبنى البلدية للحديث عن الجسر الجديد فوق النهر الكبير القريب.",
    "zh": "昨天晚上，城里的居民聚集在市政厅前，讨论横跨大河的新桥，许多人希望它能在明年春天之前完工。",
    "th": "เมื่อวานนี้ชาวเมืองมารวมตัวกันหน้าศาลากลางเพื่อพูดคุยเรื่องสะพานใหม่ข้ามแม่น้ำใหญ่",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_html_other_languages(lang):
    text = PROSE[lang]
    body, links = f"<p>{text}</p><p>{text} <a href=x>2024</a></p>", "<p><a href=x>source</a></p>"
    assert H.extract(f"<div><a href=x>{text}</a></div><div>{body}</div>").split("\n") == [text, text + " 2024"]
    assert H.extract(f"<article>{body}{links}<p>2024.</p>{links}</article>").split("\n") == [text, text + " 2024", "source", "2024.", "source"]
    assert H.extract(f"<nav>{text}</nav><footer>{text}</footer>") == ""


def test_html_headline_before_byline():
    text = "It was the best of times, it was the worst of times, it was the age of wisdom."
    page = f"<h1>A tale</h1><p><a href=x>By the author</a></p><p>{text}</p>"
    assert H.extract(f"<article>{page}</article>") == f"A tale\nBy the author\n{text}"  # in an article a linked line is text
    assert H.extract(f"<div>{page}</div>") == f"A tale\n{text}"


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>t</title><body>",
        "<html><head><meta charset=utf-8><title>t</title><style>p{}</style>",
        "<body><svg width=1 />",
        "<body><svg><path d='M0'/></svg><math/>",
        "<body><div><select><option>t</div>",
        "<body><button>t",
        "<body><noscript>",
        "<body><video src=x>t",
        "<body><canvas/><p><iframe src=x></p>",
        "<body><video-player></video-player><script-note></script-note>",
    ],
)
def test_html_unclosed_hidden(before):
    text = "It was the best of times, it was the worst of times, it was the age of wisdom."
    for after in ("", "<svg></svg><button>t</button><select><option>t</select><noscript><p>t</noscript><head></head><video>t</video>"):
        assert H.extract(f"{before}<article><p>{text}</p></article>{after}") == text


def test_html_closed_hidden():
    text = "It was the best of times, it was the worst of times, it was the age of wisdom."
    inside = f"<article><p>{text}</p><div></article>"
    for tag in ("noscript", "template", "select", "object"):
        assert H.extract(f"<div><{tag}><{tag}>{inside}</{tag}>{inside}</{tag}></div><article><p>So <{tag}>not</{tag}>it is.</p></article>") == "So it is."
    assert H.extract(f"<article><p>So it is.</p></article><script>{inside}") == "So it is."


BEST = "It was the best of times, it was the worst of times, it was the age of wisdom."


@pytest.mark.parametrize(
    "page",
    [
        "<main class='content with-sidebar'>{}</main>",
        "<article class='no-sidebar'>{}</article>",
        "<article class='post sidebar-left menu' role=banner>{}</article>",
        "<div class='page has-menu'><article>{}</article></div>",
        "<div class='page menu'><nav>The menu</nav><article>{}</article><div class=comments><article>{}</article></div></div>",
        "<form id=aspnetForm><article>{}</article></form>",
        "<form id=aspnetForm><div>{}</div><div class=ad>It is of the kind that is not to be kept at all.</div></form>",
        "<div class='layout widget'>{}</div>",
        "<article><div class='body sidebar'>{}</div></article>",
        "<article>{}</article><form><p>Send the form to us and we will be in touch with you.</p></form>",
        "<article>{}</article><div class=related><article><p>This is of the kind that is not to be kept at all.</p></article></div>",
        "<main>{}<div id=comments><article><p>I think that this is the best article of all that I have read.</p></article></div></main>",
    ],
)
def test_html_wrappers(page):
    text = f"<h1>A tale</h1><p>{BEST}</p><p>{BEST}</p><p>{BEST}</p>"
    assert H.extract(page.format(text, text)) == f"A tale\n{BEST}\n{BEST}\n{BEST}"


def test_html_links_in_article():
    """A linked paragraph is text of the article; a list of links is a menu; a link may stand around blocks."""
    rest = f"<p>{BEST}</p>"
    assert H.extract(f"<article>{rest}<p><a href=x>{BEST}</a></p><ul><li>{BEST}<li><a href=x>one</a></ul></article>").split("\n") == [BEST, BEST, BEST, "one"]
    assert H.extract(f"<article>{rest}<ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>") == BEST
    assert H.extract(f"<article>{rest}<a href=x><h2>A tale</h2><p>More of it.</p></a></article>").split("\n") == [BEST, "A tale", "More of it."]
    around = "".join(f"<div><a href=x><h3>The next one of them</h3><p>This is the teaser of the page and it is as long as it has to be.</p></a></div>" for _ in range(2))
    assert H.extract(f"<div>{rest}{rest}</div>{around}") == f"{BEST}\n{BEST}"
    assert H.extract(f"<div><p><a href=x>See it<p>{BEST}<p>{BEST}</div>") == f"{BEST}\n{BEST}"  # a link that is not closed ends with its paragraph


def test_html_blocks_of_their_own_name():
    """Paragraphs, headings and items that are hidden or named as advert or notice go; the next block stands on its own."""
    for attributes in ("class=ad", "class='cookie-notice big'", "id=newsletter", "hidden", "style='display: none'", "aria-hidden=true", 'class="sponsored"'):
        for tag in ("p", "h2", "li"):
            assert H.extract(f"<article><p>{BEST}</p><{tag} {attributes}>It is of the kind that is not to be kept.</{tag}>{'So it is.' if tag != 'p' else '<p>So it is.'}</article>") == f"{BEST}\nSo it is."
    assert H.extract(f"<article><p class='lead has-ads no-notice'>{BEST}</p><p class=address>{BEST}</p></article>") == f"{BEST}\n{BEST}"


def test_html_quotes_and_references():
    for page in (f'<article><p title="it>{BEST}</p></article>', f"<article><p class=a'b>{BEST}</p></article>", f"<!--><article><p title='a>b'>{BEST}</p></article>", f"<article><p>{BEST}</p><p"):
        assert H.extract(page) == BEST
    assert H.extract(f"<article><p>{BEST} &#{'9' * 9000}; &#{'0' * 9000}65; &#x{'0' * 50}41;&#x{'f' * 5000}</p></article>") == f"{BEST} \ufffd A A\ufffd"


N = 1 << 20


def hostile(n):
    """Pages of about ``n`` characters that a careless reader reads again and again."""
    return {
        "open quotes": '<a href="' * (n // 9), "open tags": "<a" * (n // 2), "declarations": "<!" * (n // 2), "comments": "<!--" * (n // 4), "raw": "<script" * (n // 7), "raw ends": "<script>" + "</script " * (n // 9),
        "deep": "<div>" * (n // 10) + "</p></ul>" * (n // 18), "misnested": "<div><ul>" * (n // 18) + "</div>" * (n // 12), "quotes": "<p " + "\">\" '" * (n // 6), "brackets": "<" * n, "references": "&#" + "9" * n, "attributes": "<p " + "class=' " * (n // 8) + ">",
        "hidden": "<svg><button>" * (n // 13), "words": "<p>" + "a " * (n // 2), "names": "<div class=menu>x" * (n // 17), "links": "<a href=x><p>a" * (n // 14), "one word": "<p>" + "a" * n,
    }


@pytest.mark.parametrize("kind", sorted(hostile(100)))
def test_html_hostile(kind):
    """Time in proportion to the length: a page four times as long takes no more than about four times as long."""

    def seconds(page):
        began = time.process_time()
        H.extract(page)
        return time.process_time() - began

    quarter, whole = (min(seconds(hostile(n)[kind]) for _ in range(2)) for n in (N // 4, N))
    assert whole < 9 * max(quarter, 0.02)


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=elementor-widget><p>{0}</p></div><div class=elementor-widget><p>{0}</p></div></body>",
        "<main><div class='wp-widget-text widget'><p>{0}</p></div><div class='wp-widget-text widget'><p>{0}</p></div></main>",
        "<fieldset><article><p>{0}</p><p>{0}</p></article></fieldset>",
        "<dialog><main><p>{0}</p><p>{0}</p></main>Close it</dialog>",
        "<article><p>{0}</p><div class=social-policy><p>{0}</p></div></article>",
        "<article><p>{0}</p><section class=alert-levels><p>{0}</p></section></article>",
        "<article><p>{0}</p><div class=share-price><p>{0}</p></div></article>",
        "<article><p>{0}</p><div class=notice-of-motion>{0}</div></article>",
        "<article><p>{0}</p><p>{0}</p><ol class=commentlist><li>{1}</li></ol></article>",
        "<article><p>{0}</p><p>{0}</p><div class=usercomments><p>{1}</p></div></article>",
        "<article><p>{0}</p><p>{0}</p><div id=userComments><p>{1}</p></div></article>",
        "<article><p>{0}</p><p class=comment>{1}</p><p>{0}</p></article>",
        "<article><p>{0}</p><p>{0}</p></article><article class=comment><p>{1}</p></article>",
        "<article><p>{0}</p><div class=comment-body>{1}</div><p>{0}</p></article>",
        "<article><div id=cookiebar>{1}</div><p>{0}</p><p>{0}</p></article>",
        "<article><p>{0}</p><div class=adsbygoogle>{1}</div><p>{0}</p></article>",
        "<article><p>{0}<span class=ad>Buy <span>it</span> now</span></p><p>{0}<span hidden>not</span></p></article>",
        "<article><p>{0}</p><p>{0}</p><option>One</article>",
        "<article><p>{0}</p><p>{0}</p></article><aside><article>{1}</article></aside>",
        "<div><p>{0}</p><div class=related-posts>{1}</div><p>{0}</p></div>",
        "<div class=widget>{0}</div><div class=widget>{0}</div><div class=cookie-notice>{1}</div>",
        "<article class=comment><p>{0}</p><p>{0}</p></article>",
    ],
)
def test_html_names(page):
    """Boxes of page builders, articles in any element, names inside other names; adverts, notices and comments go."""
    long = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."
    assert H.extract(page.format(long, "This is of the kind that is not to be kept at all.")) == f"{long}\n{long}"


def test_html_plain_paragraphs():
    """A long paragraph without stop words goes with its neighbours."""
    cities = "Paris London Berlin Madrid Rome Vienna Prague Warsaw Lisbon Athens Dublin Oslo"
    assert H.extract(f"<div><p>{BEST}</p><p>{cities}</p><p>{BEST}</p></div>") == f"{BEST}\n{cities}\n{BEST}"
    assert H.extract(f"<div><p>{BEST}</p></div><div class=sidebar><p>{cities}</p></div>") == BEST


def test_html_table_without_articles(spark):
    """The pages of the table without article elements, against the second reading of the pages as they are."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect()
    plain = [(H.extract(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html)), "\n".join(Article(r.html).blocks)) for r in rows]
    assert all(got == want for got, want in plain)


class Article(HTMLParser):
    """A second reading of a page, by the library's parser: the blocks inside article or main, without boilerplate elements."""

    SKIP = {"nav", "footer", "aside", "form", "script", "style", "header", "title", "head"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.text = [], [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in H._BLOCK:
            self.flush()
        if tag in ("article", "main", "div", "section") or tag in self.SKIP:
            name = dict(attrs).get("class", "") + " " + dict(attrs).get("id", "")
            self.open.append((tag, tag in self.SKIP or any(w in name.split() for w in ("ad", "comments", "cookie", "menu", "sidebar"))))

    def handle_endtag(self, tag):
        if tag in H._BLOCK:
            self.flush()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.text.append(data)


def test_html_equals_a_second_reading(spark):
    for r in R.QUERIES["op10_html_extraction"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == "\n".join(Article(r.html).blocks)


def test_html_header_in_article():
    for head in ("header class=entry-header", "div class=entry-header"):
        assert H.extract(f"<article><{head}><h1>A tale</h1></{head.split()[0]}><p>{BEST}</p></article>") == f"A tale\n{BEST}"
    assert H.extract(f"<div class=cookie-notice>{BEST}</div>") == ""
