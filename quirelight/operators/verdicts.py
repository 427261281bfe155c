"""Answers to segments: validation, splicing, retries and roll-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions import markup
from quirelight.functions import text as X


def verdict(source: Column, answer: Column, block: Column, broken: Column | None = None) -> Column:
    """First reason to keep the source, else ``tags`` (accepted, but its tags changed) or ``ok``.

    ``broken``: the answer is ill-formed where its source is not (``broken_udf``); without it that reason is left out.
    Text functions come after cheap tests that most answers pass.
    """
    fixed = F.when(block, X.repair_ampersands(answer)).otherwise(answer)
    marked = F.contains(source, F.lit("<")) | F.contains(fixed, F.lit("<"))
    return (
        F.when(answer.isNull() | X.blank(answer), "blank")
        .when(~X.xml_safe(answer), "unsafe")
        .when(F.lit(False) if broken is None else block & broken, "broken")
        .when(~block & ~source.rlike("[<>]") & answer.rlike("[<>]"), "markup")
        .when(F.octet_length(fixed) > 6 * F.octet_length(source) + 200, "long")
        .when(block & marked & (X.tag_counts(source) != X.tag_counts(fixed)), "tags")
        .otherwise("ok")
    )


def suspicious(answer: Column, block: Column) -> Column:
    """The repaired answer where it may be ill-formed, else null: few answers go to ``broken_udf``."""
    return F.when(block & (F.contains(answer, F.lit("<")) | F.contains(answer, F.lit("&")) | F.contains(answer, F.lit("]]>"))), X.repair_ampersands(answer))


def broken_udf():
    """(sources, suspicious answers) -> for each whether it is ill-formed while its source is not; nulls are not."""

    @F.pandas_udf("array<boolean>")
    def run(sources: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([None if own is None or said is None else [a is not None and not markup.well_formed(a) and markup.well_formed(s) for s, a in zip(own, said, strict=True)] for own, said in zip(sources, answers, strict=True)])

    return run


def verdicts(rows: DataFrame, block) -> DataFrame:
    """``rows`` (lines, answers: arrays of one document) with ``verdicts``, judged inside the document's array.

    ``block(i)`` says whether the i-th line is markup.
    """
    rows = rows.withColumn("_doubt", F.transform("answers", lambda a, i: suspicious(a, block(i))))
    rows = rows.withColumn("_broken", F.when(F.exists("_doubt", lambda a: a.isNotNull()), broken_udf()("lines", F.when(F.exists("_doubt", lambda a: a.isNotNull()), F.col("_doubt")))))
    judged = F.transform("lines", lambda s, i: verdict(s, F.get(F.col("answers"), i), block(i), F.coalesce(F.get(F.col("_broken"), i), F.lit(False))))
    return rows.withColumn("verdicts", judged).drop("_doubt", "_broken")


def judge(source: str, answer: str | None, block: bool) -> tuple[str, str]:
    """(verdict, repaired answer) of one segment, where the provider is called."""
    if answer is None:
        return "blank", ""
    fixed = markup.repair_ampersands(answer) if block else answer
    if not fixed.strip():
        return "blank", fixed
    if not markup.xml_safe(fixed):
        return "unsafe", fixed
    if block and ("<" in fixed or "&" in fixed) and not markup.well_formed(fixed) and markup.well_formed(source):
        return "broken", fixed
    if not block and not ("<" in source or ">" in source) and ("<" in fixed or ">" in fixed):
        return "markup", fixed
    if len(fixed.encode("utf-8", "surrogatepass")) > 6 * len(source.encode("utf-8", "surrogatepass")) + 200:
        return "long", fixed
    if block and ("<" in source or "<" in fixed) and markup.tag_counts(source) != markup.tag_counts(fixed):
        return "tags", fixed
    return "ok", fixed


ACCEPTED = ("ok", "tags")


def accepted(of: Column) -> Column:
    return of.isin(*ACCEPTED)


def splice(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, text): lines by place, those with an accepted answer replaced; a missing answer keeps its source.

    ``lines``: doc_id, seg, source; ``answers``: doc_id, seg, answer.
    """
    joined = lines.join(answers, ["doc_id", "seg"], "left")
    parts = F.array_sort(F.collect_list(F.struct("seg", F.coalesce("answer", "source").alias("text"))))
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def resume_route(docs: DataFrame, cache: DataFrame, *, retry: bool = True) -> DataFrame:
    """``docs`` with ``route``: cached, retry (cached with known pending segments) or fresh.

    ``cache``: doc_id, pending (null: unknown).
    """
    known = cache.select("doc_id", "pending", F.lit(True).alias("hit"))
    again = F.lit(retry) & F.col("pending").isNotNull() & (F.size("pending") > 0)
    return docs.join(known, "doc_id", "left").withColumn("route", F.when(F.col("hit").isNull(), "fresh").when(again, "retry").otherwise("cached")).drop("hit")


def pending_select(segments: DataFrame, pending: DataFrame) -> DataFrame:
    """(doc_id, place, seg, source): pending segments in the order of the pending list, first mention of each, those that exist."""
    wanted = pending.select("doc_id", F.posexplode("pending").alias("place", "seg"))
    first = wanted.groupBy("doc_id", "seg").agg(F.min("place").alias("place"))
    return first.join(segments, ["doc_id", "seg"]).select("doc_id", "place", "seg", "source")


def spliced(lines: Column, answers: Column, verdicts: Column) -> Column:
    """The text of a document's lines, those with an accepted answer replaced."""
    return F.array_join(F.transform(lines, lambda s, i: F.when(accepted(F.get(verdicts, i)), F.get(answers, i)).otherwise(s)), "\n")


def error_class(status: Column) -> Column:
    """fatal, retryable or rejected, by status; null (no answer) is retryable."""
    return F.when(status.isin(401, 403, 404), "fatal").when(status.isNull() | status.isin(408, 409, 429) | (status >= 500), "retryable").when(status >= 400, "rejected").otherwise("ok")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """First row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def remarks(notes: DataFrame, *, each: int = 3, most: int = 6, runes: int = 200) -> DataFrame:
    """Bounded remarks: white space collapsed, blank dropped, cut, at most ``each`` an answer, first mention in a document, at most ``most`` a document.

    ``notes``: doc, answer, place, message.
    """
    clean = notes.withColumn("message", X.first_runes(X.collapse(F.col("message")), runes)).where("message <> ''")
    own = clean.withColumn("k", F.row_number().over(Window.partitionBy("doc", "answer").orderBy("place"))).where(F.col("k") <= each)
    first = keep_first(own, ["doc", "message"], ["answer", "place"])
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("answer", "place"))).where(F.col("rank") <= most).select("doc", "rank", "message")
