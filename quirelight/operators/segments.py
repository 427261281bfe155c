"""Segments and size-bounded batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions import text as X


def exploded(rows: DataFrame, *keep: str, array: str, place: str, value: str) -> DataFrame:
    """A row for each entry of a computed array, with its place.

    The outer form, as the inner one lets the optimiser infer a filter on the array's size, which computes it twice.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


def line_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg, source) for every line of ``text`` that holds a letter, numbered from 0 in document order."""
    lines = F.filter(F.split("text", "\n"), X.has_letter)
    return exploded(docs.select("doc_id", lines.alias("_lines")), "doc_id", array="_lines", place="seg", value="source")


def chunk_bounds(sizes: Column, budget: int, most: int) -> Column:
    """Greedy batches of an ordered array of sizes: array of (lo, hi, bytes).

    A batch ends before an item that would exceed ``budget`` or ``most`` items;
    one item over the budget is a batch of its own.  It is a fold, because each
    end depends on the one before.
    """
    start = F.struct(F.array().cast("array<struct<lo:int,hi:int,bytes:bigint>>").alias("done"), F.lit(0).alias("lo"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("bytes"))

    def step(s: Column, n: Column) -> Column:
        cut = (s["at"] > s["lo"]) & ((s["bytes"] + n > budget) | (s["at"] - s["lo"] >= most))
        closed = F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["at"].alias("hi"), s["bytes"].alias("bytes"))))
        return F.struct(F.when(cut, closed).otherwise(s["done"]).alias("done"), F.when(cut, s["at"]).otherwise(s["lo"]).alias("lo"), (s["at"] + 1).alias("at"), F.when(cut, n).otherwise(s["bytes"] + n).alias("bytes"))

    def finish(s: Column) -> Column:
        return F.when(s["at"] > s["lo"], F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["at"].alias("hi"), s["bytes"].alias("bytes"))))).otherwise(s["done"])

    return F.aggregate(sizes, start, step, finish)


def chunk_plan(docs: DataFrame, *, budget: int = 4000, most: int = 40) -> DataFrame:
    """(doc_id, chunk, n_chunks, lo, hi, n_bytes): batches of each document's line segments."""
    lines = F.filter(F.split("text", "\n"), X.has_letter)
    sizes = F.transform(lines, lambda s: F.octet_length(s).cast("bigint"))
    planned = docs.select("doc_id", chunk_bounds(sizes, budget, most).alias("chunks")).withColumn("n_chunks", F.size("chunks"))
    return exploded(planned, "doc_id", "n_chunks", array="chunks", place="chunk", value="c").select("doc_id", "chunk", "n_chunks", "c.lo", "c.hi", F.col("c.bytes").alias("n_bytes"))


def bisect_plan(chunks: DataFrame, bad: Column) -> DataFrame:
    """Requests of the adaptive split: a batch that holds a bad segment is split in two, down to single segments.

    ``bad`` decides on the struct column ``r`` (lo, hi).  A batch splits to whatever depth its size asks for: the split points
    depend on the bounds alone, so all ranges that could be asked are laid out (2 n - 1 for n segments), and a range is asked
    if every range around it was bad.
    """
    size = F.col("hi") - F.col("lo")
    depths = F.sequence(F.lit(0), F.when(size > 1, F.ceil(F.log2(size)).cast("int")).otherwise(F.lit(0)))
    def halves(r: Column) -> Column:
        mid = r["lo"] + F.floor((r["hi"] - r["lo"]) / 2).cast("int")
        return F.array(F.struct(r["lo"].alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), r["hi"].alias("hi")))

    ranges = F.aggregate(
        depths,
        F.struct(F.array(F.struct("lo", "hi", F.lit(0).alias("depth"))).alias("all"), F.array(F.struct("lo", "hi")).alias("level"), F.lit(0).alias("depth")),
        lambda s, _: _deeper(s, halves),
        lambda s: s["all"],
    )
    laid = chunks.select("doc_id", "chunk", F.explode(ranges).alias("n")).select("doc_id", "chunk", "n.depth", F.struct("n.lo", "n.hi").alias("r")).withColumn("bad", bad)
    own = F.struct("depth", "r.lo", "r.hi", "bad")
    tree = laid.groupBy("doc_id", "chunk").agg(F.collect_list(own).alias("tree"))
    around = lambda n: F.forall("tree", lambda o: (o["depth"] >= n["depth"]) | (o["lo"] > n["lo"]) | (o["hi"] < n["hi"]) | o["bad"])
    return tree.select("doc_id", "chunk", F.explode(F.filter("tree", around)).alias("n")).select("doc_id", "chunk", "n.depth", "n.lo", "n.hi", (~F.col("n.bad")).alias("ok"))


def _deeper(s: Column, halves) -> Column:
    level = F.flatten(F.transform(F.filter(s["level"], lambda r: r["hi"] - r["lo"] > 1), halves))
    depth = s["depth"] + 1
    return F.struct(F.concat(s["all"], F.transform(level, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), depth.alias("depth")))).alias("all"), level.alias("level"), depth.alias("depth"))
