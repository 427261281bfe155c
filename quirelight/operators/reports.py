"""States, notes and totals of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import verdicts as V
from quirelight.operators.provider import COUNTERS
from quirelight.operators.settings import Settings

#: Settings that change an answer; pacing, bounds of batches and places of files don't.
RECIPE = ("provider", "model", "effort", "target_language", "target_code", "source_language", "source_code", "glossary", "style_notes", "about", "translate_titles", "context_chars")


def recipe(fingerprint: Column, settings: Settings) -> Column:
    """The key under which judgements may be reused."""
    return X.recipe_key(fingerprint, *[F.lit(str(getattr(settings, c))) for c in RECIPE])


def usage_sum(rows: DataFrame, by: list[str], usage: str = "usage") -> DataFrame:
    """Sums of the counters; what no row reports stays null, so nothing is shown as zero that is not known."""
    return rows.groupBy(*by).agg(*[F.sum(f"{usage}.{c}").alias(c) for c in COUNTERS])


def attempted(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Calls that were made and calls that could be used."""
    return attempts.groupBy(*by).agg(F.sum("calls").cast("long").alias("attempted"), F.sum("usable").cast("long").alias("usable"))


def status(total: Column, done: Column, asked: Column, stopped: Column, refused: Column, hit: Column) -> Column:
    """Status of a document: refused, never asked, stopped half-way or without one accepted answer; else done, or cached where nothing was asked."""
    return F.when(refused, "failed").when(hit & ~asked & ~stopped, "cached").when(stopped & ~asked, "pending").when(stopped, "failed").when((total > 0) & (done == 0), "failed").otherwise("done")


def states(segs: DataFrame, verdicts: DataFrame, attempts: DataFrame, cached: bool) -> DataFrame:
    """A row a document: status, segments, accepted ones, pending numbers, and how it was asked."""
    about = ["doc_id", "book_id", "k", "path", "title"]
    own = segs.groupBy(*about).agg(F.max("error").alias("refused"))
    good = V.accepted(F.col("verdict"))
    judged = verdicts.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"), F.count_if(good).cast("int").alias("done"), F.array_sort(F.collect_list(F.when(~good, F.col("seg")))).alias("pending"))
    tried = attempts.groupBy("doc_id").agg(F.max("asked").alias("asked"), F.max(~F.col("asked") | F.col("answers").isNull() & F.col("error").isNotNull()).alias("stopped"), F.max("error").alias("error"), F.sum("calls").cast("long").alias("calls"), F.sum("usable").cast("long").alias("usable"))
    rows = own.join(judged, "doc_id", "left").join(tried, "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.fillna(0, ["total", "done", "calls", "usable"]).withColumn("pending", F.coalesce("pending", F.array().cast("array<int>")))
    how = status(F.col("total"), F.col("done"), no("asked"), no("stopped"), F.col("refused").isNotNull(), F.lit(cached) & (F.col("total") > 0))
    return rows.select(*about, how.alias("status"), "total", "done", "pending", "calls", "usable", F.coalesce("refused", F.when(no("stopped") | (F.col("total") > 0) & (F.col("done") == 0), F.col("error"))).alias("error"))


def notes(verdicts: DataFrame, attempts: DataFrame, problems: dict[str, str]) -> DataFrame:
    """(doc_id, seg, message, remark): a problem for every segment that kept its source or changed its tags, and the bounded remarks (seg -1)."""
    said = F.create_map(*[F.lit(x) for pair in problems.items() for x in pair])
    kept = verdicts.where(F.col("verdict") != "ok").select("doc_id", "seg", said[F.col("verdict")].alias("message"), F.lit(False).alias("remark"))
    given = attempts.select(F.col("doc_id").alias("doc"), (F.col("chunk") + F.when(F.col("second"), 1 << 20).otherwise(0)).alias("answer"), F.posexplode("remarks").alias("place", "message"))
    passed = V.remarks(given, each=1 << 20).select(F.col("doc").alias("doc_id"), F.lit(-1).alias("seg"), "message", F.lit(True).alias("remark"))
    return kept.unionByName(passed)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems, remarks)."""
    return found.where("not remark"), found.where("remark")


def note_counts(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.count_if(~F.col("remark")).alias("problems"), F.count_if("remark").alias("remarks"))


def first_of(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``rank``, and in ``more`` how many the group has beyond them."""
    taken = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)  # prunes each partition before the shuffle
    size = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return taken.join(size, by).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def rollup(states: DataFrame, by: list[str]) -> DataFrame:
    """Totals of documents: segments, pending ones, documents by status, and whether another run could do better.

    ``states``: status, total, done, pending.  Cached documents add nothing to the segments of this run.
    """
    fresh = F.col("status") != "cached"
    rolled = states.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.when(fresh, F.col("total"))), F.lit(0)).cast("long").alias("segments"),
        F.coalesce(F.sum(F.when(fresh, F.col("done"))), F.lit(0)).cast("long").alias("translated"),
        F.sum(F.size("pending")).cast("long").alias("pending"),
        *[F.count_if(F.col("status") == s).alias(s if s != "pending" else "waiting") for s in ("done", "cached", "failed", "pending")],
    )
    return rolled.withColumn("retryable", (F.col("failed") > 0) | (F.col("pending") > 0))


def totals(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row a book: the roll-up, calls and usage."""
    spent = usage_sum(attempts, ["book_id"]).join(attempted(attempts, ["book_id"]), "book_id")
    return rollup(states, ["book_id"]).join(spent, "book_id", "left").fillna(0, ["attempted", "usable"])
