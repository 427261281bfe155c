"""Registered queries of the document engine and their SQL oracles.

Every query reads whole tables, is built from the package's operators and has an
oracle of its own.  The tables stand in for books, runs and calls where there are
none: what a row stands for is said beside each query.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import markup, messages, tables
from quirelight.functions import text as X
from quirelight.operators import books as B
from quirelight.operators import cache as C
from quirelight.operators import ordered as O
from quirelight.operators import reports as R
from quirelight.operators import segments as G
from quirelight.operators import settings as S
from quirelight.operators import translate as T
from quirelight.operators import verdicts as V
from quirelight.operators import views as W
from quirelight.operators.provider import Completion, capitals
from quirelight.sources import containers, epub
from quirelight.sources.tables import scratch, spread

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, oracle: str | None = None):
    """Register ``fn(*tables)`` as a query; documents and pages are dealt to all cores, as their functions are costly."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[spread(table(spark, sf_dir, t)) if t in ("documents", "pages") else table(spark, sf_dir, t) for t in tables])
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return register


# --- oracle fragments -------------------------------------------------------

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _letters(x: str) -> str:
    return rf"regexp_matches(regexp_replace(regexp_replace({x}, '<[^>]*>?', '', 'g'), '&[^;]*;?', '', 'g'), '\p{{L}}')"


_LINES = f"SELECT doc_id, source AS src, list_filter(string_split(text, chr(10)), lambda l: {_letters('l')}) AS ls FROM documents"
_SEG = f"SELECT doc_id, i AS seg, ls[i + 1] AS source FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM ({_LINES}))"
_REF = "regexp_replace({x}, '&([A-Za-z0-9]+|#[0-9]+|#[xX][0-9A-Fa-f]+);', chr(1) || '\\1;', 'g')"


def _repair(x: str) -> str:
    return f"replace(replace({_REF.format(x=x)}, '&', '&amp;'), chr(1), '&')"


def _tags(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '<([A-Za-z][A-Za-z0-9:-]*)', 1), lambda t: lower(t))"


# --- scalar functions and predicates ----------------------------------------


@query("collapse_ws", "documents", oracle=f"SELECT doc_id, sha256({_collapse('text')}) AS digest FROM documents")
def _(docs):
    return docs.select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


@query("has_letter_filter", "documents", oracle=f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(ls) AS BIGINT) AS n_kept FROM ({_LINES.replace('source AS src', 'text')})")
def _(docs):
    lines = F.split("text", "\n")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, X.has_letter)).cast("long").alias("n_kept"))


#: Depth by windows: running sums of the brackets, lifted by the lowest sum so far.
_STRIP = f"""
WITH p AS (SELECT page_id, ps, unnest(range(len(ps))) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '([<>])', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM pages)),
 m AS (SELECT page_id, i, ps[i + 1] AS piece, CASE ps[i + 1][1] WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END AS d FROM p),
 s AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS total FROM m),
 e AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS depth FROM s)
SELECT page_id, sha256({_collapse("coalesce(string_agg(CASE WHEN d = 0 THEN piece ELSE substring(piece, 2) END, '' ORDER BY i) FILTER (depth = 0), '')")}) AS digest FROM e GROUP BY page_id"""


@query("strip_tags", "pages", oracle=_STRIP)
def _(pages):
    return pages.select("page_id", F.sha2(X.strip_tags(F.col("html")), 256).alias("digest"))


@query("rune_cuts", "documents", oracle="SELECT doc_id, CASE WHEN length(text) > 40 THEN trim(substring(text, 1, 40)) || '…' ELSE text END AS head, CASE WHEN length(text) > 400 THEN '…' || right(text, 400) ELSE text END AS tail FROM documents")
def _(docs):
    return docs.select("doc_id", X.first_runes(F.col("text"), 40).alias("head"), X.last_runes(F.col("text"), 400).alias("tail"))


# The letters that a slug folds, as the oracle writes them.
_FOLDED = {"a": "àáâãäåā", "c": "çćč", "d": "ď", "e": "èéêëēęě", "i": "ìíîïī", "l": "ł", "n": "ñńň", "o": "òóôõöøō", "r": "ř", "s": "śš", "t": "ť", "u": "ùúûüūů", "y": "ýÿ", "z": "źżž", "ss": "ß", "ae": "æ", "oe": "œ"}
_SLUG = "lower(text)"
for _plain, _letters_of in _FOLDED.items():
    _SLUG = f"regexp_replace({_SLUG}, '[{_letters_of}]', '{_plain}', 'g')"
_SLUG = f"regexp_replace(regexp_replace({_SLUG}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slug", "documents", oracle=f"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, {_SLUG} AS s FROM documents)")
def _(docs):
    return docs.select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("thousands_fmt", "customer", oracle="SELECT c_custkey, replace(format('{:,}', CAST(round(abs(c_acctbal) * 1000) AS BIGINT)), ',', ' ') AS grouped FROM customer")
def _(customer):
    return customer.select("c_custkey", X.thousands(F.round(F.abs("c_acctbal") * 1000).cast("long")).alias("grouped"))


_CODE = "lang || ['', '-gb', '_US', '-hans', '--x', '-Hant', '-BR'][doc_id % 7 + 1]"


@query("lang_map", "documents", oracle=f"""
SELECT doc_id, CASE WHEN u IN ('EN-GB', 'EN-US', 'PT-BR', 'PT-PT', 'ZH-HANT') THEN u WHEN u = 'ZH-HANS' THEN 'ZH' ELSE split_part(u, '-', 1) END AS mapped, regexp_matches(code, '{X.LANGUAGE_TAG}') AS valid
FROM (SELECT doc_id, code, replace(upper(code), '_', '-') AS u FROM (SELECT doc_id, {_CODE} AS code FROM documents))""")
def _(docs):
    ends = F.array(*[F.lit(x) for x in ("", "-gb", "_US", "-hans", "--x", "-Hant", "-BR")])
    code = F.concat("lang", F.get(ends, (F.col("doc_id") % 7).cast("int")))
    return docs.select("doc_id", X.direct_language(code).alias("mapped"), code.rlike(X.LANGUAGE_TAG).alias("valid"))


@query("lang_tag_valid", "documents", oracle=f"SELECT doc_id, regexp_matches(lang || '-' || source, '{X.LANGUAGE_TAG}') AS tagged, regexp_matches(lang, '{X.LANGUAGE_TAG}') AS plain FROM documents")
def _(docs):
    return docs.select("doc_id", F.concat_ws("-", "lang", "source").rlike(X.LANGUAGE_TAG).alias("tagged"), F.col("lang").rlike(X.LANGUAGE_TAG).alias("plain"))


@query("xml_safe", "documents", oracle=r"SELECT doc_id, NOT regexp_matches(CASE WHEN doc_id % 3 = 0 THEN text || chr(CAST(doc_id % 32 AS INTEGER) + 1) ELSE text END, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]') AS safe FROM documents")
def _(docs):
    spoilt = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.char(F.col("doc_id") % 32 + 1))).otherwise(F.col("text"))
    return docs.select("doc_id", X.xml_safe(spoilt).alias("safe"))


@query("repair_amp", "pages", oracle=f"SELECT page_id, sha256({_repair('html')}) AS digest FROM pages")
def _(pages):
    return pages.select("page_id", F.sha2(X.repair_ampersands(F.col("html")), 256).alias("digest"))


@query("normalise_text", "pages", oracle=f"SELECT page_id, sha256(replace(replace({_repair('html')}, '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def _(pages):
    return pages.select("page_id", F.sha2(X.normalise(F.col("html")), 256).alias("digest"))


_DECLS = ["", '<?xml version="1.0" encoding="UTF-8"?>', '<?xml version="1.0" encoding="ISO-8859-1"?>', '<?xml version="1.0" encoding="us-ascii"?>']


@query("encoding_gate", "pages", oracle="SELECT page_id, e AS declared, e IN ('', 'utf-8', 'utf8', 'us-ascii', 'ascii') AS readable FROM (SELECT page_id, lower(regexp_extract(substring(CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DECLS)) + r""" END || html, 1, 256), '^\s*<\?xml[^>]*encoding=["'']([^"'']*)["'']', 1)) AS e FROM pages)""")
def _(pages):
    decl = F.element_at(F.array(*[F.lit(d) for d in _DECLS]), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.lower(F.regexp_extract(F.substring(F.concat(decl, F.col("html")), 1, 256), r"""^\s*<\?xml[^>]*encoding=["']([^"']*)["']""", 1))
    return pages.select("page_id", name.alias("declared"), name.isin("", "utf-8", "utf8", "us-ascii", "ascii").alias("readable"))


@query("tag_multiset", "pages", oracle=f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest({_tags('html')}) AS tag FROM pages) GROUP BY ALL")
def _(pages):
    return pages.select("page_id", F.explode(X.tags(F.col("html"))).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_TITLE = "nullif(" + _collapse("regexp_replace(regexp_extract(html, '(?s)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g')") + ", '')"


@query("page_titles", "pages", oracle=f"SELECT page_id, coalesce({_TITLE.replace('{t}', 'h1')}, {_TITLE.replace('{t}', 'h2')}, {_TITLE.replace('{t}', 'title')}, 'Section ' || page_id) AS title FROM pages")
def _(pages):
    found = [F.nullif(X.collapse(F.regexp_replace(F.regexp_extract("html", f"(?s)<{t}[^>]*>(.*?)</{t}>", 1), "<[^>]*>", "")), F.lit("")) for t in ("h1", "h2", "title")]
    return pages.select("page_id", F.coalesce(*found, F.concat(F.lit("Section "), F.col("page_id").cast("string"))).alias("title"))


_HREF = """'(?s)<a href="([^"#?]*)[^"]*"[^>]*>(.*?)</a>'"""


@query("page_links", "pages", oracle=f"""
SELECT page_id, href, arg_min(label, i) AS label, CAST(min(i) AS BIGINT) AS first_at FROM (
  SELECT page_id, i, hs[i + 1] AS href, {_collapse("regexp_replace(ls[i + 1], '<[^>]*>', '', 'g')")} AS label
  FROM (SELECT page_id, hs, ls, unnest(range(len(hs))) AS i FROM (SELECT page_id, regexp_extract_all(html, {_HREF}, 1) AS hs, regexp_extract_all(html, {_HREF}, 2) AS ls FROM pages)))
WHERE label <> '' GROUP BY page_id, href""")
def _(pages):
    both = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(_HREF[1:-1]), F.lit(k)).alias(n) for k, n in ((1, "href"), (2, "label"))])
    rows = pages.select("page_id", F.posexplode(both).alias("i", "l")).select("page_id", "i", "l.href", X.collapse(F.regexp_replace("l.label", "<[^>]*>", "")).alias("label"))
    return rows.where("label <> ''").groupBy("page_id", "href").agg(F.min_by("label", "i").alias("label"), F.min("i").cast("long").alias("first_at"))


@query("set_doc_lang", "pages", oracle="SELECT page_id, regexp_extract(d, '<html[^>]*>') AS root, sha256(d) AS digest FROM (SELECT page_id, regexp_replace(html, '(<html[^>]*?\\slang=\")[^\"]*(\")', '\\1nl\\2') AS d FROM pages)")
def _(pages):
    done = pages.withColumn("d", F.expr("""regexp_replace(html, '(<html[^>]*?\\\\slang=")[^"]*(")', '$1nl$2', 1)"""))
    return done.select("page_id", F.regexp_extract("d", "<html[^>]*>", 0).alias("root"), F.sha2("d", 256).alias("digest"))


# --- segments, batches, answers ----------------------------------------------


@query("corpus_stats", "documents", oracle=f"SELECT src AS source, count(*) AS n_docs, CAST(sum(len(ls)) AS BIGINT) AS n_segments, CAST(sum(list_sum(list_transform(ls, lambda l: strlen(l)))) AS BIGINT) AS n_bytes FROM ({_LINES}) GROUP BY src")
def _(docs):
    lines = F.filter(F.split("text", "\n"), X.has_letter)
    size = F.aggregate(F.transform(lines, lambda s: F.octet_length(s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return docs.select("source", F.size(lines).alias("n"), size.alias("b")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_segments"), F.sum("b").alias("n_bytes"))


def _chunk_sql(budget: int, most: int) -> str:
    return f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, list_transform(ls, lambda s: strlen(s)) AS ns FROM ({_LINES})),
 w AS (SELECT doc_id, 0 AS i, 0 AS lo, CAST(0 AS BIGINT) AS b, false AS cut, 0 AS prev_lo, CAST(0 AS BIGINT) AS prev_b FROM l WHERE len(ns) > 0
       UNION ALL
       SELECT w.doc_id, w.i + 1, CASE WHEN c.cut THEN w.i ELSE w.lo END, CASE WHEN c.cut THEN l.ns[w.i + 1] ELSE w.b + l.ns[w.i + 1] END, c.cut, w.lo, w.b
       FROM w JOIN l USING (doc_id), LATERAL (SELECT w.i > w.lo AND (w.b + l.ns[w.i + 1] > {budget} OR w.i - w.lo >= {most}) AS cut) c
       WHERE w.i < len(l.ns)),
 done AS (SELECT doc_id, prev_lo AS lo, i - 1 AS hi, prev_b AS n_bytes FROM w WHERE cut
          UNION ALL SELECT w.doc_id, w.lo, w.i, w.b FROM w JOIN l USING (doc_id) WHERE w.i = len(l.ns))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS INTEGER) AS chunk, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks,
       CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, n_bytes FROM done"""


@query("chunk_plan", "documents", oracle=_chunk_sql(400, 4))
def _(docs):
    return G.chunk_plan(docs, budget=400, most=4)


@query("batches_table", "documents", oracle=_chunk_sql(400, 4))
def _(docs):
    """The same batches by the table function of SQL."""
    tables.register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT doc_id, chunk, n_chunks, lo, hi, n_bytes FROM batches(TABLE(SELECT doc_id, seg, source FROM {lines}), 400, 4)", lines=G.line_segments(docs))


@query("bisect_plan", "documents", oracle=f"""
WITH RECURSIVE c AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(k * 8 AS INTEGER) AS lo, CAST(least(len(ls), k * 8 + 8) AS INTEGER) AS hi FROM (SELECT doc_id, ls, unnest(range((len(ls) + 7) // 8)) AS k FROM ({_LINES}))),
 b AS (SELECT doc_id, chunk, 0 AS depth, lo, hi FROM c
       UNION ALL
       SELECT b.doc_id, b.chunk, b.depth + 1, CASE WHEN h = 0 THEN b.lo ELSE b.lo + (b.hi - b.lo) // 2 END, CASE WHEN h = 0 THEN b.lo + (b.hi - b.lo) // 2 ELSE b.hi END
       FROM b, (VALUES (0), (1)) AS v(h) WHERE b.hi - b.lo > 1 AND (b.hi + 3) // 7 > (b.lo + 3) // 7)
SELECT doc_id, chunk, depth, lo, hi, NOT ((hi + 3) // 7 > (lo + 3) // 7) AS ok FROM b""")
def _(docs):
    n = F.size(F.filter(F.split("text", "\n"), X.has_letter))
    whole = docs.select("doc_id", n.alias("n")).where("n > 0").select("doc_id", "n", F.posexplode(F.expr("sequence(0, int((n - 1) / 8))")).alias("chunk", "_c"))
    chunks = whole.selectExpr("doc_id", "chunk", "chunk * 8 as lo", "least(n, chunk * 8 + 8) as hi")
    return G.bisect_plan(chunks, F.expr("int((r.hi + 3) / 7) > int((r.lo + 3) / 7)"))


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _judged(docs: DataFrame) -> DataFrame:
    """Lines of each document with seeded answers (capitals, and every kind of spoilt answer) and their verdicts; even lines are markup."""

    def answer(doc: Column, s: Column, i: Column) -> Column:
        up, key = F.translate(s, _SMALL, _LARGE), (doc * 31 + i) % 11
        return F.when(key == 0, "").when(key == 1, F.concat(up, F.lit("\x02"))).when(key == 2, F.concat(F.lit("<b>"), up, F.lit("</b>"))).when(key == 3, F.repeat(up, 9)).when(key == 4, F.concat(F.lit("<b>"), up)).otherwise(up)

    lines = docs.select("doc_id", F.filter(F.split("text", "\n"), X.has_letter).alias("lines"))
    return V.verdicts(lines.withColumn("answers", F.transform("lines", lambda s, i: answer(F.col("doc_id"), s, i))), lambda i: i % 2 == 0)


_UP = f"translate(source, '{_SMALL}', '{_LARGE}')"
_ANS = f"SELECT doc_id, seg, source, CASE (doc_id * 31 + seg) % 11 WHEN 0 THEN '' WHEN 1 THEN {_UP} || chr(2) WHEN 2 THEN '<b>' || {_UP} || '</b>' WHEN 3 THEN repeat({_UP}, 9) WHEN 4 THEN '<b>' || {_UP} ELSE {_UP} END AS answer FROM ({_SEG})"
_VERDICT = f"""SELECT doc_id, seg, source, answer, CASE WHEN {_collapse('answer')} = '' THEN 'blank'
  WHEN regexp_matches(f, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]') THEN 'unsafe'
  WHEN block AND len(regexp_extract_all(f, '<b>')) <> len(regexp_extract_all(f, '</b>')) AND NOT contains({_REF.format(x='source')}, '&') THEN 'broken'
  WHEN NOT block AND NOT regexp_matches(source, '[<>]') AND regexp_matches(answer, '[<>]') THEN 'markup'
  WHEN strlen(f) > 6 * strlen(source) + 200 THEN 'long'
  WHEN list_sort({_tags('source')}) <> list_sort({_tags('f')}) THEN 'tags' ELSE 'ok' END AS verdict
  FROM (SELECT *, CASE WHEN block THEN {_repair('answer')} ELSE answer END AS f FROM (SELECT *, seg % 2 = 0 AS block FROM ({_ANS})))"""


@query("accept_verdict", "documents", oracle=f"SELECT doc_id, CAST(seg AS INTEGER) AS seg, verdict FROM ({_VERDICT})")
def _(docs):
    return G.exploded(_judged(docs), "doc_id", array="verdicts", place="seg", value="verdict")


def _done(verdicts: str = "verdicts") -> Column:
    return F.size(F.filter(verdicts, V.accepted)).cast("long")


@query("splice_docs", "documents", oracle=f"""
SELECT doc_id, sha256(string_agg(CASE WHEN verdict IN ('ok', 'tags') THEN answer ELSE source END, chr(10) ORDER BY seg)) AS digest, CAST(count(*) FILTER (verdict IN ('ok', 'tags')) AS BIGINT) AS n_done
FROM ({_VERDICT}) GROUP BY doc_id""")
def _(docs):
    text = V.spliced(F.col("lines"), F.col("answers"), F.col("verdicts"))
    return _judged(docs).where("size(lines) > 0").select("doc_id", F.sha2(text, 256).alias("digest"), _done().alias("n_done"))


@query("pending_select", "documents", oracle=f"SELECT doc_id, CAST(min(place) AS INTEGER) AS place, CAST(seg AS INTEGER) AS seg, any_value(source) AS source FROM (SELECT doc_id, p AS place, [1, 0, 1, 999999, doc_id % 7][p + 1] AS seg FROM (SELECT doc_id, unnest(range(5)) AS p FROM documents)) JOIN ({_SEG}) USING (doc_id, seg) GROUP BY doc_id, seg")
def _(docs):
    pending = docs.select("doc_id", F.expr("array(1, 0, 1, 999999, int(doc_id % 7))").alias("pending"))
    return V.pending_select(G.line_segments(docs), pending)


@query("retry_pending", "documents", oracle=f"SELECT doc_id, sha256(string_agg(CASE WHEN seg % 3 = 1 AND verdict IN ('ok', 'tags') THEN answer ELSE source END, chr(10) ORDER BY seg)) AS digest, CAST(count(*) FILTER (seg % 3 = 1 AND verdict NOT IN ('ok', 'tags')) AS BIGINT) AS still_pending FROM ({_VERDICT}) GROUP BY doc_id")
def _(docs):
    judged = _judged(docs).where("size(lines) > 0")
    again = F.transform("verdicts", lambda v, i: F.when(i % 3 == 1, v).otherwise("first"))  # what is not asked again keeps its earlier text
    left = F.size(F.filter("verdicts", lambda v, i: (i % 3 == 1) & ~V.accepted(v))).cast("long")
    return judged.select("doc_id", F.sha2(V.spliced(F.col("lines"), F.col("answers"), again), 256).alias("digest"), left.alias("still_pending"))


@query("structure_drift", "documents", oracle=f"SELECT doc_id, CAST(len(ls) AS BIGINT) AS before, CAST(len(ls) - (doc_id % 5 = 0)::INT AS BIGINT) AS after, doc_id % 5 = 0 AS drifted FROM ({_LINES}) WHERE len(ls) > 0")
def _(docs):
    seg = G.line_segments(docs)
    old = seg.groupBy("doc_id").agg(F.count("*").alias("before"))
    new = seg.where("not (doc_id % 5 = 0 and seg = 0)").groupBy("doc_id").agg(F.count("*").alias("after"))
    return old.join(new, "doc_id", "left").select("doc_id", "before", F.coalesce("after", F.lit(0)).alias("after")).withColumn("drifted", F.expr("before <> after"))


@query("titles_filter", "documents", oracle=f"SELECT doc_id, CAST(seg AS INTEGER) AS seg FROM ({_SEG}) JOIN (SELECT doc_id, doc_id % 10 = 0 AS nav FROM documents) USING (doc_id) WHERE NOT (length(source) < 20 OR nav)")
def _(docs):
    """Short lines stand for titles, every tenth document for a table of contents."""
    seg = G.line_segments(docs).withColumn("is_title", F.length("source") < 20).withColumn("navigation", F.col("doc_id") % 10 == 0)
    return B.translatable(seg, titles=False).select("doc_id", "seg")


@query("resume_route", "documents", "labels", oracle="SELECT doc_id, CASE WHEN l.id IS NULL THEN 'fresh' WHEN toxic = 1 THEN 'retry' ELSE 'cached' END AS route FROM documents LEFT JOIN (SELECT doc_id AS id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON doc_id = id")
def _(docs, labels):
    cache = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", F.when(F.col("toxic") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("pending"))
    return V.resume_route(docs.select("doc_id"), cache).select("doc_id", "route")


@query("recipe_key", "documents", oracle="SELECT doc_id, substring(sha256(concat_ws(chr(0), CAST(doc_id AS VARCHAR), coalesce(lang, ''), coalesce(source, ''), CAST(n_chars AS VARCHAR), '')), 1, 16) AS recipe FROM documents")
def _(docs):
    return docs.select("doc_id", X.recipe_key(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("n_chars"), F.lit(None)).alias("recipe"))


@query("encode_payload", "documents", oracle=f"""SELECT doc_id, sha256('[' || string_agg('"' || replace(replace(source, '\\', '\\\\'), '"', '\\"') || '"', ',' ORDER BY seg) || ']') AS digest FROM ({_SEG}) GROUP BY doc_id""")
def _(docs):
    lines = F.filter(F.split("text", "\n"), X.has_letter)
    return docs.select("doc_id", lines.alias("l")).where("size(l) > 0").select("doc_id", F.sha2(F.to_json("l"), 256).alias("digest"))


@query("book_plaintext", "documents", oracle=f"SELECT source, doc_id, sha256('Section ' || doc_id || chr(10) || repeat('-', length('Section ' || doc_id)) || chr(10) || chr(10) || body || chr(10) || chr(10)) AS digest FROM (SELECT doc_id, source, {_collapse('text')} AS body FROM documents) WHERE body <> ''")
def _(docs):
    """Chapters of each book, a row each: a book may hold a third of all documents, so it is never gathered into one row."""
    title = F.concat(F.lit("Section "), F.col("doc_id").cast("string"))
    whole = docs.select("doc_id", "source", X.collapse(F.col("text")).alias("body")).where("body <> ''")
    chapter = F.concat(title, F.lit("\n"), F.repeat(F.lit("-"), F.length(title)), F.lit("\n\n"), F.col("body"), F.lit("\n\n"))
    return whole.select("source", "doc_id", F.sha2(chapter, 256).alias("digest"))


# --- calls, limits, failures --------------------------------------------------


@query("limiter_slots", "events", oracle="""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, event_id, CAST(i * 600000000 + max(now - i * 600000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) - now AS BIGINT) AS wait_us FROM c""")
def _(events):
    calls = events.select("user_id", F.col("event_id").alias("order"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"))
    return O.limiter_slots(calls, 600_000_000, "user_id").select("user_id", F.col("order").alias("event_id"), (F.col("at") - F.col("now")).alias("wait_us"))


@query("backoff_bounds", "events", oracle="SELECT event_id, CAST(2000 * pow(2, event_id % 4) AS BIGINT) AS low_ms, CAST(3000 * pow(2, event_id % 4) AS BIGINT) AS high_ms FROM events")
def _(events):
    wait = 2000 * F.pow(F.lit(2.0), F.col("event_id") % 4)
    return events.select("event_id", wait.cast("long").alias("low_ms"), (wait * 1.5).cast("long").alias("high_ms"))


@query("failure_guard", "events", oracle="""
WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events),
 i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i WHERE failed) WHERE streak = 3""")
def _(events):
    calls = events.select("user_id", "event_id", F.struct("ts", "event_id").alias("order"), (F.col("event_type") == "error").alias("failed"))
    return O.failure_runs(calls, 3, "user_id", block=F.floor(F.unix_micros(F.col("order.ts").cast("timestamp")) / 3_600_000_000)).select("user_id", "event_id")


_STATUS = "[200, 401, 403, 404, 408, 409, 429, 400, 422, 500, 503]"


@query("error_class", "events", oracle=f"SELECT event_id, s AS status, CASE WHEN s IN (401, 403, 404) THEN 'fatal' WHEN s IN (408, 409, 429) OR s >= 500 THEN 'retryable' WHEN s >= 400 THEN 'rejected' ELSE 'ok' END AS class FROM (SELECT event_id, {_STATUS}[event_id % 11 + 1] AS s FROM events)")
def _(events):
    status = F.expr(f"element_at(array({_STATUS[1:-1]}), int(event_id % 11) + 1)")
    return events.select("event_id", status.alias("status")).withColumn("class", V.error_class(F.col("status")))


@query("log_squash", "events", oracle="SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x WHERE before IS NULL OR before <> event_type")
def _(events):
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows = O.last_before(events.select("user_id", "event_id", "event_type", "ts"), F.col("event_type"), ("user_id",), ("ts", "event_id"), block)
    return rows.where("before is null or before <> event_type").select("user_id", "event_id", "event_type")


@query("continuity_tail", "conversations", oracle="SELECT conv_id, turn, max(mark) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tail_turn FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn END AS mark FROM conversations) x")
def _(turns):
    rows = turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("turn")).alias("mark"))
    found = O.last_before(rows, F.col("mark"), ("conv_id",), ("turn",), F.floor(F.col("turn") / 1024), skip_nulls=True)
    return found.select("conv_id", "turn", F.col("before").alias("tail_turn"))


@query("report_topn", "conversations", oracle="SELECT conv_id, turn, CAST(greatest(n - 5, 0) AS BIGINT) AS more FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x WHERE r <= 5")
def _(turns):
    return R.first_of(turns.select("conv_id", "turn"), ["conv_id"], ["turn"], 5).select("conv_id", "turn", "more")


@query("remark_cap", "conversations", oracle=f"""
WITH n AS (SELECT conv_id AS doc, turn // 3 AS answer, turn AS place, CASE WHEN length({_collapse('text')}) > 200 THEN trim(substring({_collapse('text')}, 1, 200)) || '…' ELSE {_collapse('text')} END AS message FROM conversations),
 e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, answer ORDER BY place) AS k FROM n WHERE message <> '') WHERE k <= 3),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, message ORDER BY answer, place) AS k2 FROM e) WHERE k2 = 1)
SELECT doc, CAST(r AS INTEGER) AS rank, message FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY answer, place) AS r FROM f) WHERE r <= 6""")
def _(turns):
    return V.remarks(turns.select(F.col("conv_id").alias("doc"), F.expr("turn div 3").alias("answer"), F.col("turn").alias("place"), F.col("text").alias("message")))


# --- runs, books and lists -------------------------------------------------------


@query("attempt_rollup", "events", oracle="SELECT event_type, CAST(sum(1 + event_id % 3) AS BIGINT) AS attempted, count(*) FILTER (event_id % 11 <> 0) AS usable FROM events GROUP BY event_type")
def _(events):
    """Events stand for batches, each with up to three calls."""
    batches = events.select("event_type", (F.col("event_id") % 3 + 1).alias("calls"), (F.col("event_id") % 11 != 0).cast("int").alias("usable"))
    return R.attempted(batches, ["event_type"])


@query("usage_sum", "conversations", oracle="SELECT conv_id, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS input, CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT) AS output, CAST(sum(turn) FILTER (role = 'system') AS BIGINT) AS cache_read, CAST(NULL AS BIGINT) AS cache_write FROM conversations GROUP BY conv_id")
def _(turns):
    """Turns stand for answers that report one counter or none."""
    size = F.length("text").cast("long")
    own = F.struct(F.when(F.col("role") == "user", size).alias("input"), F.when(F.col("role") == "assistant", size).alias("output"), F.when(F.col("role") == "system", F.col("turn")).alias("cache_read"), F.lit(None).cast("long").alias("cache_write"))
    return R.usage_sum(turns.select("conv_id", own.alias("usage")), ["conv_id"])


def _states(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the status their labels stand for; lines are segments, the first toxic + 1 of them pending."""
    lines = F.size(F.filter(F.split("text", "\n"), X.has_letter))
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "done").otherwise("cached")
    left = F.when(F.col("quality").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col("toxic")))
    return rows.select("doc_id", "source", "lang", status.alias("status"), lines.alias("total"), F.when(status == "done", lines).otherwise(0).alias("done"), left.alias("pending"))


_STATES = f"""SELECT doc_id, src, lang, n, CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'done' ELSE 'cached' END AS status, coalesce(toxic + 1, 0) AS open
FROM (SELECT d.doc_id, d.src, d.lang, len(ls) AS n, max(quality) AS quality, max(toxic) AS toxic FROM ({_LINES.replace('source AS src', 'source AS src, lang')}) d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)"""


@query("run_rollup", "documents", "labels", oracle=f"""
SELECT src AS source, count(*) AS documents, CAST(sum(CASE WHEN status = 'cached' THEN 0 ELSE n END) AS BIGINT) AS segments, CAST(sum(CASE WHEN status = 'done' THEN n ELSE 0 END) AS BIGINT) AS translated,
       CAST(sum(open) AS BIGINT) AS pending, bool_or(status = 'failed' OR open > 0) AS retryable FROM ({_STATES}) GROUP BY src""")
def _(docs, labels):
    return R.rollup(_states(docs, labels), ["source"]).select("source", "documents", "segments", "translated", "pending", "retryable")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for s, n in (("done", "done"), ("cached", "cached"), ("failed", "failed"), ("pending", "waiting")))


@query("status_pivot", "documents", "labels", oracle=f"SELECT lang, {_COUNTS} FROM ({_STATES}) GROUP BY lang")
def _(docs, labels):
    return R.rollup(_states(docs, labels), ["lang"]).select("lang", "done", "cached", "failed", "waiting")


@query("list_runs", "documents", "labels", oracle=f"""
SELECT recipe, done, pending, row_number() OVER (ORDER BY updated DESC, recipe) AS place FROM (
  SELECT src || '/' || lang AS recipe, count(*) AS done, CAST(sum(open) AS BIGINT) AS pending, max(doc_id) // 3 AS updated FROM ({_STATES}) WHERE status IN ('done', 'cached', 'failed') GROUP BY src, lang)""")
def _(docs, labels):
    """Sources and languages stand for recipes, labelled documents for stored ones."""
    kept = _states(docs, labels).where("status <> 'pending'").withColumn("recipe", F.concat_ws("/", "source", "lang"))
    seen = kept.select("recipe", "doc_id", F.explode_outer("pending").alias("seg"))
    judgements = seen.select("recipe", F.col("doc_id").alias("path"), F.when(F.col("seg").isNull(), "ok").otherwise("blank").alias("verdict"))
    newest = kept.groupBy("recipe").agg(F.floor(F.max("doc_id") / 3).alias("updated_at"))
    return C.listed(C.counted(judgements).join(newest, "recipe")).select("recipe", "done", "pending", F.col("place").cast("long").alias("place"))


@query("note_counts", "conversations", oracle="SELECT conv_id, count(*) FILTER (role <> 'system') AS problems, count(*) FILTER (role = 'system') AS remarks FROM conversations GROUP BY conv_id")
def _(turns):
    """Turns stand for notes, those of the system for remarks."""
    return R.note_counts(turns.select("conv_id", (F.col("role") == "system").alias("remark")), ["conv_id"])


@query("notes_split", "conversations", oracle="SELECT conv_id, turn, role = 'system' AS remark FROM conversations")
def _(turns):
    problems, remarks = R.split(turns.select("conv_id", "turn", (F.col("role") == "system").alias("remark")))
    return problems.unionByName(remarks)


_WORD1 = "split_part(text, ' ', 1)"


def _lists(turns: DataFrame) -> list[DataFrame]:
    """Conversations stand for books; the first words of a role's turns for the paths of a list."""
    return [turns.where(F.col("role") == r).select(F.col("conv_id").alias("book"), F.split_part("text", F.lit(" "), F.lit(1)).alias("path"), F.split_part("text", F.lit(" "), F.lit(2)).alias("label"), F.col("turn").alias("ordinal")) for r in ("user", "assistant", "system")]


_LIST_NO = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"


@query("worklist", "conversations", oracle=f"""
SELECT conv_id AS book, path, row_number() OVER (PARTITION BY conv_id ORDER BY l, turn, path) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY l, turn) AS nth FROM (SELECT conv_id, turn, {_WORD1} AS path, {_LIST_NO} AS l FROM conversations)) WHERE nth = 1""")
def _(turns):
    return W.ordered_union(*_lists(turns)).select("book", "path", F.col("place").cast("long").alias("place"))


@query("toc_labels", "conversations", oracle=f"""
SELECT DISTINCT conv_id AS book, path, first_value(label) OVER (PARTITION BY conv_id, path ORDER BY l, turn) AS label
FROM (SELECT conv_id, turn, {_WORD1} AS path, split_part(text, ' ', 2) AS label, {_LIST_NO} AS l FROM conversations) WHERE label <> ''""")
def _(turns):
    return W.first_labels(*_lists(turns))


@query("title_coalesce", "documents", "labels", oracle=f"""
SELECT doc_id, coalesce(CASE WHEN q = 1 THEN 'Label ' || doc_id END, nullif({_collapse("CASE WHEN length(string_split(text, chr(10))[1]) < 60 THEN string_split(text, chr(10))[1] ELSE '' END")}, ''), 'Section ' || n) AS title
FROM (SELECT doc_id, text, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS q, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents d)""")
def _(docs, labels):
    """Sources stand for books, labels for a table of contents, short first lines for the documents' own titles."""
    line = F.get(F.split("text", "\n"), 0)
    chapters = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("path"), F.col("doc_id").alias("k"), X.collapse(F.when(F.length(line) < 60, line).otherwise("")).alias("own"))
    toc = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id").select(F.col("source").alias("book"), F.col("doc_id").alias("path"), F.concat(F.lit("Label "), F.col("doc_id").cast("string")).alias("label"))
    return W.chapter_titles(chapters, toc).select(F.col("path").alias("doc_id"), "title")


@query("spine_join", "documents", oracle="""
WITH m AS (SELECT source, doc_id % 97 AS id, arg_max(doc_id, doc_id) AS href FROM documents GROUP BY source, doc_id % 97)
SELECT s.source AS book, s.doc_id AS ordinal, CAST(m.href AS VARCHAR) AS path, row_number() OVER (PARTITION BY s.source ORDER BY s.doc_id) - 1 AS k
FROM documents s JOIN m ON m.source = s.source AND m.id = s.doc_id % 97 WHERE m.href % 5 <> 0 AND m.href % 7 <> 0""")
def _(docs):
    """Sources stand for books, documents for references, manifest items (of equal ids the last counts) and files."""
    refs = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 97).alias("idref"))
    items = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 97).alias("item_id"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, "text/css").otherwise("application/xhtml+xml").alias("media_type"))
    files = docs.where("doc_id % 7 <> 0").select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("path"))
    return epub.reading_order(refs, items, files).select("book", "ordinal", "path", F.col("k").cast("long").alias("k"))


@query("range_select", "documents", oracle="""
SELECT source AS book_id, doc_id AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE p BETWEEN 1 AND 2 OR p >= 4""")
def _(docs):
    """Sources stand for books: the documents 1-2 and from the fourth."""
    taken = B.selected(docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("k"), F.col("doc_id").alias("path")), spec="1-2, 4-")
    return taken.select("book_id", "k", F.col("place").cast("long").alias("place"))


@query("only_documents", "documents", "labels", oracle="""
WITH named AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 = 0)
SELECT source AS book_id, doc_id AS k FROM documents d WHERE doc_id IN (SELECT doc_id FROM named) OR NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.doc_id IN (SELECT doc_id FROM named))""")
def _(docs, labels):
    """Books without a named document are taken whole."""
    all_of = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("k"), F.col("doc_id").alias("path"))
    only = labels.where("quality = 1 and doc_id % 3 = 0").select("doc_id").distinct().join(docs, "doc_id").select(F.col("source").alias("book_id"), F.col("doc_id").alias("path"))
    return B.selected(all_of, only).select("book_id", "k")


def _containers(docs: DataFrame) -> DataFrame:
    """A container for each document: its lines are the paragraphs of one chapter."""
    title = F.concat(F.lit("Book "), F.col("doc_id").cast("string"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), X.xml_escape(x), F.lit("</p>"))), "\n")
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>\n"), lines, F.lit("</body></html>"))
    chapter = F.struct(F.lit("one 1.xhtml").alias("name"), F.concat(F.lit("Label "), "source").alias("title"), page.alias("data"))
    return epub.bound(docs.select(F.col("doc_id").cast("string").alias("book_id"), title.alias("title"), F.col("lang").alias("language"), F.array(chapter).alias("chapters")))


@query("container_tables", "documents", oracle="""
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'OEBPS/package.opf' AS package, 'Book ' || doc_id AS title, lang AS language, '3.0' AS version, 1 AS chapters FROM documents""")
def _(docs):
    return epub.packages(_containers(docs)).select("book_id", "package", "title", "language", "version", "chapters")


@query("container_files", "documents", oracle="""
SELECT 'b' || doc_id || '.epub' AS file, 'OEBPS/package.opf' AS package, 'Book ' || doc_id AS title, 1 AS chapters, 'OEBPS/one 1.xhtml' AS name, CAST(1 AS BIGINT) AS found FROM documents WHERE doc_id IS NOT NULL""")
def _(docs):
    """Containers written as files by the sink, read back by the source: packages by seek, one entry of each by its name."""
    folder = scratch(docs.sparkSession, "books")
    docs = docs.where("doc_id is not null")
    books = _containers(docs).join(docs.select(F.col("doc_id").cast("string").alias("book_id")), "book_id")
    containers.save(books.select(F.concat(F.lit("b"), "book_id").alias("name"), "content"), folder)
    read = lambda table: containers.read(docs.sparkSession, folder, table)
    page = read("entries").where("name = 'OEBPS/one 1.xhtml'").groupBy("book_id").agg(F.first("name").alias("name"), F.count_if(F.length("data") > 0).alias("found"))
    return read("packages").join(page, "book_id").select(F.element_at(F.split("book_id", "/"), -1).alias("file"), "package", "title", "chapters", "name", "found")


@query("container_worklist", "documents", oracle="""
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'Book ' || doc_id AS book_title, k, CASE k WHEN 0 THEN 'OEBPS/one 1.xhtml' ELSE 'OEBPS/nav.xhtml' END AS path, CASE k WHEN 0 THEN 'Label ' || source ELSE 'Navigation' END AS title, k = 1 AS navigation
FROM documents, (VALUES (0), (1)) AS v(k)""")
def _(docs):
    return epub.documents(_containers(docs)).select("book_id", "book_title", "k", "path", "title", "navigation")


_ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RUN_LINES = f"list_transform(string_split(translate(text, '{_SMALL}', '{_LARGE}'), chr(10)), lambda l: '<p>' || {_ESCAPED.format(x='l')} || '</p>')"


@query("container_run", "documents", oracle=f"""
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'OEBPS/one 1.xhtml' AS path, 'done' AS status, CAST(2 + len(ls) AS INTEGER) AS total, CAST(2 + len(ls) AS INTEGER) AS done,
  sha256('<html xmlns="http://www.w3.org/1999/xhtml" lang="fr"><head><title>BOOK ' || doc_id || '</title></head><body><h1>BOOK ' || doc_id || '</h1>' || chr(10) || array_to_string({_RUN_LINES}, chr(10)) || '</body></html>') AS digest
FROM ({_LINES.replace('source AS src', 'text').replace("string_split(text, chr(10)), lambda l: ", "string_split(replace(text, '&', '&amp;'), chr(10)), lambda l: ")})
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'OEBPS/nav.xhtml', 'done', 1, 1, sha256('<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="one%201.xhtml">LABEL ' || upper(source) || '</a></li></ol></nav></body></html>') FROM documents""")
def _(docs):
    """A whole run over containers, offline: from the container's bytes to the bytes of its new documents."""
    run = B.translate(_containers(docs), lambda: capitals, scratch(docs.sparkSession, "run"), S.Settings(salvage_pass=False, context_chars=0))
    return run.states.join(run.changed.select("book_id", "path", "data"), ["book_id", "path"], "left").select("book_id", "path", "status", "total", "done", F.sha2("data", 256).alias("digest"))


def _leaves_out(needle: str):
    """Makes a provider that has no answer to strings with ``needle``."""
    return lambda: lambda sources: ["" if needle in s else a for s, a in zip(sources, capitals(sources), strict=True)]


@query("container_resume", "documents", oracle=f"""
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'OEBPS/one 1.xhtml' AS path, CASE WHEN open = 0 THEN 'cached' ELSE 'done' END AS status, CAST(2 + n AS INTEGER) AS done, CAST(open AS BIGINT) AS asked
FROM (SELECT doc_id, len(ls) AS n, len(list_filter(ls, lambda l: contains(l, 'é'))) AS open FROM ({_LINES.replace('source AS src', 'text').replace("string_split(text, chr(10)), lambda l: ", "string_split(replace(text, '&', '&amp;'), chr(10)), lambda l: ")}))
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'OEBPS/nav.xhtml', 'cached', 1, 0 FROM documents""")
def _(docs):
    """A run that leaves strings out, then another that asks again for those, and only for those, out of the store."""
    spark, settings = docs.sparkSession, S.Settings(salvage_pass=False, context_chars=0)
    path, store = scratch(spark, "found"), C.Store(spark, scratch(spark, "store"))
    _containers(docs).write.parquet(path)  # made once, as both runs read them several times
    found = spark.read.parquet(path)
    B.translate(found, _leaves_out("é"), scratch(spark, "run"), settings, store=store)
    last = scratch(spark, "run")
    run = B.translate(found, _leaves_out("\x00"), last, settings, store=store, retry=True)
    asked = spark.read.parquet(f"{last}/attempts").groupBy("doc_id").agg(F.sum(F.size("segs")).cast("long").alias("asked"))
    return run.states.join(asked, "doc_id", "left").select("book_id", "path", "status", "done", F.coalesce("asked", F.lit(0)).cast("long").alias("asked"))


@query("container_interrupted", "documents", oracle=f"""
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'OEBPS/one 1.xhtml' AS path, 'done' AS status, CAST(2 + len(ls) AS INTEGER) AS done, CAST(0 AS BIGINT) AS asked_again, true AS resumed
FROM ({_LINES.replace('source AS src', 'text').replace("string_split(text, chr(10)), lambda l: ", "string_split(replace(text, '&', '&amp;'), chr(10)), lambda l: ")})
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'OEBPS/nav.xhtml', 'done', 1, 0, true FROM documents""")
def _(docs):
    """A run whose provider dies at one book, and the next start on its path: what was committed before is not asked again."""
    spark, settings, path = docs.sparkSession, S.Settings(salvage_pass=False, context_chars=0), scratch(docs.sparkSession, "run")
    found, last = _containers(docs), f"Book {docs.agg(F.max('doc_id')).first()[0]}"

    def deadly():
        def provider(sources):
            if last in sources:
                raise SystemExit("killed")
            return capitals(sources)

        return provider

    try:
        B.translate(found, deadly, path, settings)
    except Exception:  # the job has failed
        pass
    before = T.committed(spark, path, T.Options.of(settings)).select("doc_id", "chunk", "slot")
    before.write.parquet(f"{path}/before")
    before = spark.read.parquet(f"{path}/before")
    run = B.translate(found, lambda: capitals, path, settings)
    again = spark.read.parquet(f"{path}/attempts").select("doc_id", "chunk", F.col("slot").alias("now")).join(before, ["doc_id", "chunk"]).where("now != slot").groupBy("doc_id").count()
    resumed = F.lit(before.first() is not None)
    return run.states.join(again, "doc_id", "left").select("book_id", "path", "status", "done", F.coalesce("count", F.lit(0)).cast("long").alias("asked_again"), resumed.alias("resumed"))


_ESCAPED_LINES = _LINES.replace("source AS src", "source, text").replace("string_split(text, chr(10)), lambda l: ", "string_split(replace(text, '&', '&amp;'), chr(10)), lambda l: ")
_SAID = f"replace(replace(replace(translate(l, '{_SMALL}', '{_LARGE}'), '&AMP;', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("container_continuity", "documents", oracle=f"""
WITH d AS (SELECT doc_id, list_concat(['BOOK ' || doc_id, 'BOOK ' || doc_id], list_transform(ls, lambda l: {_collapse(_SAID)})) AS segs FROM ({_ESCAPED_LINES})),
 c AS (SELECT doc_id, CAST(j AS INTEGER) AS chunk, array_to_string(segs[40 * j + 1 : 40 * j + 40], ' ') AS said FROM (SELECT doc_id, segs, unnest(range((len(segs) + 39) // 40)) AS j FROM d)),
 t AS (SELECT doc_id, chunk, CASE WHEN length(said) <= 60 THEN said ELSE '…' || right(said, 60) END AS tail FROM c)
SELECT CAST(doc_id AS VARCHAR) AS book_id, 'OEBPS/one 1.xhtml' AS path, chunk, lag(tail) OVER (PARTITION BY doc_id ORDER BY chunk) AS tail FROM t
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'OEBPS/nav.xhtml', 0, max_by(tail, chunk) FROM t GROUP BY doc_id""")
def _(docs):
    """What each batch is shown of the translation so far, wave by wave: the service repeats it as a remark."""

    def repeats():
        class Service:
            def complete(self, request):
                sources = json.loads(request.user.rsplit("\n", 1)[1])
                said = request.user.split("so far ends:\n")
                return Completion(json.dumps({"translations": capitals(sources), "notes": [said[1].rsplit("\n", 2)[0]] if len(said) > 1 else []}))

        return Service()

    path = scratch(docs.sparkSession, "run")
    B.translate(_containers(docs), repeats, path, S.Settings(salvage_pass=False, context_chars=60, max_segments=40, chunk_chars=1 << 40))
    asked = docs.sparkSession.read.parquet(f"{path}/attempts")
    return asked.select("book_id", F.element_at(F.split("doc_id", "!/"), 2).alias("path"), "chunk", F.get("remarks", F.lit(0)).alias("tail"))


@query("model_list", "part", oracle="SELECT DISTINCT m AS model FROM (SELECT p_brand AS m FROM part UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'name of ' || p_brand END FROM part) WHERE m <> ''")
def _(part):
    """Parts stand for entries of a service's list, some with an id, some with a name only, some blank."""
    own = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("id"), F.concat(F.lit("name of "), "p_brand").alias("name"))
    return W.model_names(part.select(F.array("p_brand", F.lit("")).alias("data"), F.array(own).alias("models")))





@query("preset_rank", "supplier", oracle="""
SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 0 WHEN s_acctbal < 0 THEN 1 WHEN s_nationkey % 2 = 0 THEN 2 ELSE 3 END, s_suppkey) AS BIGINT) AS place FROM supplier""")
def _(supplier):
    """Suppliers stand for services: those in the red are free, those of even nations want no key; the first of all stays first."""
    rows = supplier.select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").cast("string").alias("id"), (F.col("s_acctbal") < 0).alias("free_tier"), (F.col("s_nationkey") % 2 == 0).alias("no_key"))
    first = supplier.agg(F.min("s_suppkey")).first()[0]
    return S.ranked(rows, str(first)).select(F.col("ordinal").alias("s_suppkey"), F.col("place").cast("long").alias("place"))


_WRONG = [("provider", "nobody"), ("target_language", " "), ("base_url", "ftp://x"), ("chunk_chars", "0"), ("format", "pdf")]


@query("validate_cascade", "customer", oracle="""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'provider' WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN 'model' WHEN c_custkey % 5 = 0 THEN 'target_language' WHEN c_custkey % 11 = 0 THEN 'base_url'
  WHEN c_acctbal < 0 THEN 'chunk_chars' WHEN length(c_name) % 2 = 0 AND c_custkey % 13 = 0 THEN 'format' END AS problem FROM customer""")
def _(customer):
    """Customers stand for settings with several faults each; the first in order is reported."""
    key = F.col("c_custkey")
    needs = (key % 3 == 0) & (F.col("c_nationkey") % 2 == 0)
    rows = customer.select(
        "c_custkey",
        F.when(key % 7 == 0, "nobody").when(needs, "openai").otherwise("offline").alias("provider"),
        F.when(key % 5 == 0, " ").otherwise("French").alias("target_language"),
        F.when(key % 11 == 0, "ftp://x").otherwise("").alias("base_url"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(4000).alias("chunk_chars"),
        F.when((F.length("c_name") % 2 == 0) & (key % 13 == 0), "pdf").otherwise("txt").alias("format"),
    )
    return S.problems(rows).select("c_custkey", "problem")


_MESSAGES = "(SELECT 'en' AS locale, n_name AS key FROM nation UNION ALL SELECT 'fr', n_name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'fr', r_name FROM region)"


def _messages(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nations stand for keys of messages; some lack a French one, regions an English one."""
    own = nation.select(F.lit("en").alias("locale"), F.col("n_name").alias("key")).unionByName(nation.where("n_nationkey % 4 <> 0").select(F.lit("fr").alias("locale"), F.col("n_name").alias("key")))
    return own.unionByName(region.select(F.lit("fr").alias("locale"), F.col("r_name").alias("key"))).withColumn("text", F.concat_ws(" ", "key", F.lit("in"), "locale", F.lit("%s of %d")))


@query("locale_parity", "nation", "region", oracle=f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'en' ELSE 'fr' END AS only_in FROM (SELECT key FROM {_MESSAGES} WHERE locale = 'en') a FULL JOIN (SELECT key FROM {_MESSAGES} WHERE locale = 'fr') b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL")
def _(nation, region):
    return messages.unmatched(_messages(nation, region), "en", "fr")


@query("message_lookup", "nation", "region", "customer", oracle=f"""
SELECT c_custkey, CASE WHEN f.key IS NOT NULL THEN k || ' in fr ' || c_name || ' of ' || c_custkey WHEN e.key IS NOT NULL THEN k || ' in en ' || c_name || ' of ' || c_custkey ELSE k END AS text
FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'unknown' WHEN c_custkey % 6 = 1 THEN (SELECT min(r_name) FROM region) ELSE n_name END AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
LEFT JOIN (SELECT key FROM {_MESSAGES} WHERE locale = 'fr') f ON f.key = k LEFT JOIN (SELECT key FROM {_MESSAGES} WHERE locale = 'en') e ON e.key = k""")
def _(nation, region, customer):
    """Messages of customers in French, else in English, else the key itself, with their arguments."""
    first = region.agg(F.min("r_name").alias("first"))
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(first))  # one row
    keys = asked.select("c_custkey", "c_name", F.lit("fr").alias("locale"), F.when(F.col("c_custkey") % 6 == 0, "unknown").when(F.col("c_custkey") % 6 == 1, F.col("first")).otherwise(F.col("n_name")).alias("key"))
    found = messages.looked_up(keys, _messages(nation, region))
    return found.select("c_custkey", F.when(F.col("text") == F.col("key"), F.col("text")).otherwise(messages.templated(F.col("text"), F.col("c_name"), F.col("c_custkey"))).alias("text"))


@query("duration_fmt", "events", oracle="""
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS took, strftime(ts, '%Y-%m-%d %H:%M') AS at
FROM (SELECT event_id, ts, CAST(event_id * 7 % 9000 AS BIGINT) AS s FROM events)""")
def _(events):
    return events.select("event_id", W.duration(F.col("event_id") * 7 % 9000).alias("took"), W.minute(F.col("ts")).alias("at"))


@query("scroll_window", "customer", oracle="""
SELECT c_custkey, CAST(a AS INTEGER) AS first, CAST(least(t, a + r) AS INTEGER) AS last FROM (SELECT c_custkey, t, r, greatest(0, least(c - r // 2, greatest(0, t - r))) AS a
FROM (SELECT c_custkey, c_custkey % 40 AS c, c_nationkey * 2 AS t, greatest(1, CASE WHEN c_nationkey * 2 > c_custkey % 17 THEN c_custkey % 17 - 2 ELSE c_custkey % 17 END) AS r FROM customer))""")
def _(customer):
    start, end = W.scroll_window((F.col("c_custkey") % 40).cast("int"), F.col("c_nationkey") * 2, (F.col("c_custkey") % 17).cast("int"))
    return customer.select("c_custkey", start.cast("int").alias("first"), end.cast("int").alias("last"))


@query("name_filter", "part", oracle="SELECT p_partkey FROM part WHERE p_type ILIKE '%aNdar%'")
def _(part):
    return W.named_like(part, "p_type", "aNdar").select("p_partkey")


# --- markup: byte-exact work in Arrow batches; tests hold the answers -----------


def _sql_list(names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names.split()) + ")"


# The element sets of the segment scan, as the oracle writes them.
_SQL_BLOCKS = _sql_list("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd figcaption caption text")
_SQL_SKIPPED = _sql_list("script style pre svg math audio video meta link")
_SQL_VOID = _sql_list("area base basefont br col embed frame hr img input isindex link meta param source track wbr")

#: The segment scan as a recursion over tokens: a stack of elements, the block that is open, and what is skipped.
_SEGMENTS = rf"""
WITH RECURSIVE w AS (SELECT page_id, i, ps[i + 1] AS x FROM (SELECT page_id, ps, unnest(range(len(ps))) AS i FROM (
   SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>|[^<]+') AS ps FROM pages))),
 k AS (SELECT page_id, i, x, CAST(coalesce(sum(strlen(x)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, lower(regexp_extract(x, '^</?(?:[^\s/>:]*:)?([^\s/>:]+)', 1)) AS n FROM w),
 tok AS MATERIALIZED (SELECT page_id, i, s, CAST(s + strlen(x) AS BIGINT) AS e, n, CASE WHEN x[1] <> '<' THEN 't' WHEN regexp_matches(x, '(?i)^<([!?]|script|style)') THEN 'x' WHEN x[2] = '/' THEN 'c' WHEN n IN {_SQL_VOID} OR x LIKE '%/>' THEN 'v' ELSE 'o' END AS t FROM k),
 st AS (SELECT page_id, 0 AS i, CAST([] AS VARCHAR[]) AS stack, '' AS opened, 0 AS depth, CAST(0 AS BIGINT) AS began, 0 AS skip, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS elem FROM pages
   UNION ALL
   SELECT page_id, i + 1, CASE WHEN t = 'o' THEN list_append(rest, n) ELSE rest END,
     CASE WHEN t = 'o' AND open1 = '' AND skip1 = 0 AND n IN {_SQL_BLOCKS} AND n NOT IN {_SQL_SKIPPED} THEN n ELSE open1 END,
     CASE WHEN t = 'o' AND open1 = '' AND skip1 = 0 AND n IN {_SQL_BLOCKS} AND n NOT IN {_SQL_SKIPPED} THEN 1 WHEN t = 'o' AND open1 = n THEN depth1 + 1 ELSE depth1 END,
     CASE WHEN t = 'o' AND open1 = '' AND skip1 = 0 AND n IN {_SQL_BLOCKS} AND n NOT IN {_SQL_SKIPPED} THEN e ELSE began END,
     CASE WHEN t = 'o' AND open1 = '' AND (skip1 > 0 OR n IN {_SQL_SKIPPED}) THEN skip1 + 1 ELSE skip1 END,
     CASE WHEN closes THEN began WHEN t = 't' AND opened = '' AND skip = 0 THEN s END, CASE WHEN closes THEN s WHEN t = 't' AND opened = '' AND skip = 0 THEN e END,
     CASE WHEN closes THEN 'block' ELSE 'text' END, CASE WHEN closes THEN opened ELSE coalesce(stack[-1], '') END
   FROM (SELECT *, CASE WHEN closes THEN '' ELSE opened END AS open1, CASE WHEN opened <> '' THEN depth - hits ELSE depth END AS depth1, CASE WHEN opened = '' THEN greatest(0, skip - len(popped)) ELSE skip END AS skip1,
                stack[1 : len(stack) - len(popped)] AS rest
         FROM (SELECT *, opened <> '' AND hits > 0 AND depth - hits <= 0 AS closes
               FROM (SELECT *, len(list_filter(popped, lambda x: x = opened)) AS hits
                     FROM (SELECT st.*, tok.s, tok.e, tok.n, tok.t, CASE WHEN tok.t = 'c' AND list_contains(stack, tok.n) THEN stack[len(stack) - list_position(list_reverse(stack), tok.n) + 1 :]
                                  WHEN tok.t IN ('o', 'v') AND tok.n IN {_SQL_BLOCKS} AND stack[-1] = 'p' THEN ['p'] ELSE CAST([] AS VARCHAR[]) END AS popped
                           FROM st JOIN tok USING (page_id, i)))))),
 ends AS (SELECT page_id, arg_max(opened, i) AS opened, arg_max(began, i) AS began FROM st GROUP BY page_id),
 found AS (SELECT page_id, a, b, kind, elem FROM st WHERE a IS NOT NULL UNION ALL SELECT page_id, began, strlen(html), 'block', opened FROM ends JOIN pages USING (page_id) WHERE opened <> ''),
 cut AS (SELECT f.*, decode(from_hex(substring(hex(encode(html)), CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)))) AS source FROM found f JOIN pages USING (page_id) WHERE b > a)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS INTEGER) AS seg, a AS start, CAST(b AS BIGINT) AS "end", kind, elem, elem IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'title') AS is_title, source
FROM cut WHERE {_letters('source')}"""


@query("page_segments", "pages", oracle=_SEGMENTS)
def _(pages):
    return markup.page_segments(pages)


@query("segments_table", "pages", oracle=_SEGMENTS)
def _(pages):
    """The same segments by the table function of SQL."""
    tables.register(pages.sparkSession)
    return pages.sparkSession.sql("SELECT page_id, s.seg, s.start, s.end, s.kind, s.elem, s.is_title, s.source FROM {pages}, LATERAL segments(encode(html, 'utf-8'), 'html') AS s", pages=pages)


_BREAKS = "p|div|h1|h2|h3|h4|h5|h6|li|blockquote|tr|dt|dd|figcaption|caption|section|article|header|footer|hr|table|ul|ol|dl|pre"
_PLAIN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "head"):
    _PLAIN = f"regexp_replace({_PLAIN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '(?i)</?({_BREAKS})(\\s[^>]*)?/?>', chr(1), 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
for _ref, _char in {"copy": "©", "middot": "·", "nbsp": "\u00a0", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}.items():
    _PLAIN = f"replace({_PLAIN}, '&{_ref};', '{_char}')"


@query("page_plaintext", "pages", oracle=f"SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(1)), lambda x: {_collapse('x')}), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM pages")
def _(pages):
    return pages.select("page_id", F.sha2(markup.plain_text_udf()("html"), 256).alias("digest"))


@query("answer_parse", "conversations", oracle="SELECT conv_id, turn, CAST(1 AS BIGINT) AS n, sha256(text) AS digest FROM conversations")
def _(turns):
    """A turn's text as the one answer of a reply, in an envelope in a code fence, or in a list inside chatter."""
    listed = F.to_json(F.array("text"))
    envelope = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array("text").alias("translations"))), F.lit("\n```"))
    reply = F.when(F.col("turn") % 3 == 0, envelope).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), listed, F.lit(" done."))).otherwise(listed)
    return turns.select("conv_id", "turn", markup.answers_udf()(reply).alias("a")).select("conv_id", "turn", F.size("a").cast("long").alias("n"), F.sha2(F.get("a", 0), 256).alias("digest"))
