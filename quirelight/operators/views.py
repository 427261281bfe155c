"""What lists and reports show: windows on lists, filters by name, durations and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.operators import ordered as O


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``value`` within [low, high]; where those cross, the lower bound."""
    return F.greatest(low, F.least(value, high))


def clamp_index(at: Column, length: Column) -> Column:
    """A place in a list of ``length`` rows; 0 in an empty one."""
    return F.when(length <= 0, F.lit(0)).otherwise(clamp(at, F.lit(0), length - 1))


def scroll_window(cursor: Column, total: Column, budget: Column) -> tuple[Column, Column]:
    """[start, end) of the rows of a list that fit around the cursor; a list that doesn't fit leaves two lines for what is hidden."""
    rows = F.greatest(F.lit(1), F.when(total > budget, budget - 2).otherwise(budget))
    start = clamp(cursor - F.floor(rows / 2).cast("int"), F.lit(0), F.greatest(F.lit(0), total - rows))
    return start, F.least(total, start + rows)


def named_like(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose name holds ``needle`` in any case; all for an empty one."""
    return rows.where(F.contains(F.lower(column), F.lit(needle.lower()))) if needle else rows


def duration(seconds: Column) -> Column:
    """Whole seconds as 1h2m3s, without leading zero parts."""
    whole = F.round(seconds).cast("long")
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60) % 60
    head = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"))).when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.lit(""))
    return F.concat(head, (whole % 60).cast("string"), F.lit("s"))


def minute(moment: Column) -> Column:
    """A moment to the minute."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def model_names(lists: DataFrame) -> DataFrame:
    """(model) of ``lists`` (data: array<string>, models: array<struct<id,name>>): by id, else by name, without blanks, each once, sorted."""
    data = lists.select(F.explode("data").alias("model"))
    more = lists.select(F.explode("models").alias("m")).select(F.coalesce(F.nullif(F.col("m.id"), F.lit("")), F.col("m.name")).alias("model"))
    return data.unionByName(more).where("model <> ''").distinct().orderBy("model")


def _marked(lists: tuple[DataFrame, ...], *columns: str) -> DataFrame:
    """Rows of the lists with their place: the list, then ``ordinal``."""
    return reduce(DataFrame.unionByName, [x.select("book", "path", *columns, F.struct(F.lit(k).alias("list"), F.col("ordinal").cast("long").alias("ordinal")).alias("at")) for k, x in enumerate(lists)])


def ordered_union(*lists: DataFrame) -> DataFrame:
    """(book, path, place) of the lists (book, path, ordinal) one after another, each path of a book where it stands first; place from 1."""
    first = _marked(lists).groupBy("book", "path").agg(F.min("at").alias("at"))
    block = F.struct("at.list", F.floor(F.col("at.ordinal") / O.SPAN).alias("run"))
    return O.numbered(first, ("book",), ("at", "path"), block).select("book", "path", "place")


def first_labels(*lists: DataFrame) -> DataFrame:
    """(book, path, label): of the lists (book, path, label, ordinal) one after another, the first label of a path that is not blank."""
    return _marked(lists, "label").where("label <> ''").groupBy("book", "path").agg(F.min_by("label", "at").alias("label"))


def chapter_titles(chapters: DataFrame, labels: DataFrame) -> DataFrame:
    """``chapters`` (book, path, k, own) with ``title``: the label of the table of contents, else the document's own, else "Section n"."""
    numbered = O.numbered(chapters, ("book",), ("k",), F.floor(F.col("k") / O.SPAN))
    named = numbered.join(labels.select("book", "path", F.nullif("label", F.lit("")).alias("_label")), ["book", "path"], "left")
    return named.withColumn("title", F.coalesce("_label", F.nullif("own", F.lit("")), F.concat(F.lit("Section "), F.col("place").cast("string")))).drop("place", "places", "_label")
