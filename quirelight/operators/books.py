"""Runs over book containers: container in, translated container out.

    documents -> segments -> (titles, only, ranges) -> batches -> attempts -> verdicts -> splice -> containers

Segments are numbered in the whole document whatever is selected, a document with nothing accepted is failed and keeps its
bytes, and one unreadable document does not stop the others.  States, notes and totals are tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions import markup
from quirelight.functions.batches import ddl, mapped
from quirelight.operators import ordered as O
from quirelight.operators import reports as R
from quirelight.operators import translate as T
from quirelight.operators import verdicts as V
from quirelight.operators.cache import Store, document
from quirelight.operators.provider import Provider
from quirelight.operators.selection import parse_ranges
from quirelight.operators.settings import Settings
from quirelight.sources import epub as E

#: What a verdict means for the reader of a report.
PROBLEMS = {
    "blank": "no usable answer, the source is kept",
    "unsafe": "the answer held characters that no book may hold, the source is kept",
    "broken": "the answer's markup was broken, the source is kept",
    "markup": "the answer put markup into plain text, the source is kept",
    "long": "the answer was far longer than its source, the source is kept",
    "tags": "the answer is kept, but its tags are not those of the source",
}


@dataclass
class Run:
    """Tables of a finished run."""

    states: DataFrame  # a row a document
    notes: DataFrame  # problems and remarks
    changed: DataFrame  # documents whose bytes are new
    books: DataFrame  # containers
    totals: DataFrame  # a row a book


def selected(docs: DataFrame, only: DataFrame | None = None, spec: str = "") -> DataFrame:
    """``docs`` (book_id, k, path) that a run takes, with place and places among them.

    ``only``: (book_id, path); no rows of a book are no restriction for it.  ``spec``: places among the documents, as in "1-3,7".
    """
    if only is not None:
        bound = only.select("book_id").distinct().withColumn("_bound", F.lit(True))
        wanted = only.select("book_id", "path").distinct().withColumn("_wanted", F.lit(True))
        docs = docs.join(bound, "book_id", "left").join(wanted, ["book_id", "path"], "left").where("_bound is null or _wanted").drop("_bound", "_wanted")
    numbered = lambda d: O.numbered(d, ("book_id",), ("k",), F.floor(F.col("k") / O.SPAN)).withColumns({c: F.col(c).cast("int") for c in ("place", "places")})
    docs = numbered(docs)
    if not spec.strip():
        return docs

    @F.udf("array<int>")
    def places(n: int) -> list[int]:
        return parse_ranges(spec, n)

    taken = docs.select("book_id", "places").distinct().select("book_id", F.explode(places("places")).alias("place"))
    return numbered(docs.join(taken, ["book_id", "place"], "left_semi").drop("place", "places"))


def segments(docs: DataFrame, mode: str = "strict") -> DataFrame:
    """Segments of the documents with what a batch is told about them; those of a refused document are one row with its error, and so is a document without any."""
    about = [c for c in docs.columns if c != "data"]

    def rows(data: bytes | None, doc_id: str, *given) -> Iterator[tuple]:
        try:
            found, error = markup.extract(data or b"", mode), None
        except markup.MarkupError as e:
            found, error = [], str(e) or type(e).__name__
        for k, s in enumerate(found):
            yield *given, doc_id, error, k, s.source, s.kind == "block", s.is_title
        if not found:
            yield *given, doc_id, error, None, None, None, None

    named = docs.select("data", document(F.col("book_id"), F.col("path")).alias("doc_id"), *about)
    return mapped(named, rows, f"{ddl(docs, *about)}, doc_id string, error string, seg int, source string, block boolean, is_title boolean")


def translatable(segs: DataFrame, titles: bool) -> DataFrame:
    """Segments to work on: without titles, neither title segments nor anything of a table of contents."""
    segs = segs.where("seg is not null")
    return segs if titles else segs.where("not (is_title or navigation)")


def spliced(docs: DataFrame, mode: str, code: str) -> DataFrame:
    """The documents (book_id, k, path, title, data, a: array<struct<seg,answer>>) with their answers in place: data, and why not if they could not be."""

    def rows(book, k, path, title, raw: bytes, own: list[dict]) -> list[tuple]:
        try:
            found = markup.extract(raw, mode)
            given: list[str | None] = [None] * len(found)
            for a in own:
                given[a["seg"]] = a["answer"]
            return [(book, k, path, title, markup.set_language(markup.apply(raw, found, given, mode), code), None)]
        except (markup.MarkupError, IndexError) as e:
            return [(book, k, path, title, raw, str(e))]

    return mapped(docs.select("book_id", "k", "path", "title", "data", "a"), rows, f"{ddl(docs, 'book_id', 'k', 'path', 'title')}, data binary, error string")


def translate(found: DataFrame, make: Callable[[], Provider], path: str, settings: Settings, *, store: Store | None = None, retry: bool = False, only: DataFrame | None = None, spec: str = "", salvage: Callable[[], Provider] | None = None, mode: str = "strict", progress: T.Progress | None = None) -> Run:
    """Translate the containers of ``found`` (book_id, content); intermediate tables go under ``path``.

    ``store`` holds earlier judgements by recipe; ``retry`` asks again for what was pending there.  ``salvage`` makes the
    provider of the second pass over what the first left (without it the same provider, if the settings ask for a pass).
    """
    spark = found.sparkSession
    table = lambda df, name: (df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    docs = table(E.documents(found, True), "documents")
    if only is None and not spec.strip():  # all of them, in the places that their containers give them
        chosen, taken = docs.drop("data"), docs
    else:
        chosen = selected(docs.drop("data", "place", "places"), only, spec)
        taken = chosen.join(docs.select("book_id", "path", "data"), ["book_id", "path"])
    segs = table(segments(taken, mode), "segments")
    wanted = translatable(segs, settings.translate_titles)
    recipes = found.select("book_id", R.recipe(F.sha2("content", 256), settings).alias("recipe"))
    cache = None
    if store is not None and settings.resume:
        recipes = table(recipes, "recipes")  # containers are hashed once, not for each wave
        cache = store.judgements(recipes)
    again = salvage or make
    finished, settled = None, []
    if store is not None and settings.resume:
        titles = table(docs.groupBy("book_id").agg(F.min("book_title").alias("title")), "titles")
        places = table(chosen.select(document(F.col("book_id"), F.col("path")).alias("doc_id"), "book_id", "path"), "places")

        def finished(judgements: DataFrame) -> None:
            """Documents are stored as waves finish them; the run is listed with the first."""
            judgements = table(judgements, f"finished/{len(settled)}")
            if judgements.first() is not None:
                store.put(recipes, judgements, places, settings, titles, listed=not settled)
                settled.append(judgements.groupBy("doc_id").agg(F.every(V.accepted(F.col("verdict"))).alias("good")).where("good").select("doc_id"))

    verdicts = T.run(wanted.drop("error", "navigation", "is_title"), make, path, options=T.Options.of(settings), salvage=again if settings.salvage_pass else None, cache=cache, retry=retry, progress=progress, resume=settings.resume, finished=finished)
    attempts = spark.read.parquet(f"{path}/attempts")
    if settings.salvage_pass:
        attempts = attempts.withColumn("second", F.lit(False)).unionByName(spark.read.parquet(f"{path}/salvage").withColumn("second", F.lit(True)))
    else:
        attempts = attempts.withColumn("second", F.lit(False))
    states = table(R.states(segs, verdicts, attempts, cache is not None), "states")
    good = verdicts.where(V.accepted(F.col("verdict"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg", "answer"))).alias("a"))
    done = states.where("status in ('done', 'cached')").select("doc_id")
    new = docs.withColumn("doc_id", document(F.col("book_id"), F.col("path"))).join(good, "doc_id").join(done, "doc_id", "left_semi")
    changed = table(spliced(new, mode, settings.target_code), "changed")
    if store is not None and settings.resume:
        for known in settled:  # nothing of these was asked again
            done = done.join(known, "doc_id", "left_anti")
        store.put(recipes, verdicts.join(done, "doc_id", "left_semi"), states, settings, titles)
    return Run(states, table(R.notes(verdicts, attempts, PROBLEMS), "notes"), changed, E.replaced(found, changed, settings.target_code), R.totals(states, attempts))


def texts(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Plain text of the books in ordered pieces (book_id, k, at, piece), with the changed documents in place."""
    new = changed.select("book_id", "path", F.col("data").alias("new"))
    docs = E.documents(found).where("not navigation").join(new, ["book_id", "path"], "left").withColumn("now", F.coalesce("new", "data"))

    @F.pandas_udf("struct<title:string,body:string>")
    def read(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(markup.document_title(bytes(d)), markup.plain_text(bytes(d))) for d in docs], columns=["title", "body"])

    chapters = docs.withColumn("r", read("now")).select("book_id", "k", "r.title", F.col("title").alias("label"), "r.body")
    return E.book_text(chapters, E.packages(found).select("book_id", "title"))
