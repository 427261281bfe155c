"""Judgements of earlier runs, by recipe.

A store is two tables of Parquet files that only grow: a row for each put of a document (all its judgements in one value, so
an answer and what is pending never part ways), and a row for each run, or for its being discarded.  Of equal documents and
runs the latest row counts.  Small books share files; nothing is a folder or a file of its own.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.operators.settings import Settings

_JUDGEMENTS = "recipe string, path string, judged array<struct<seg:int,source:string,answer:string,verdict:string>>, put long"
_RUNS = "recipe string, source string, book_title string, target_language string, model string, documents long, updated_at timestamp, gone boolean, put long"


def document(book: Column, path: Column) -> Column:
    """Name of a document of a book in the tables of a run."""
    return F.concat(book, F.lit("!/"), path)


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _add(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _documents(self, recipes: DataFrame | None = None) -> DataFrame:
        """(recipe, path, judged): the latest row of each document whose run was not discarded after it."""
        rows = self._read("judgements", _JUDGEMENTS)
        if recipes is not None:
            rows = rows.join(recipes.select("recipe").distinct(), "recipe", "left_semi")
        latest = rows.groupBy("recipe", "path").agg(F.max("put").alias("put"), F.max_by("judged", "put").alias("judged"))
        cut = self._read("runs", _RUNS).where("gone").groupBy("recipe").agg(F.max("put").alias("cut"))
        return latest.join(cut, "recipe", "left").where("cut is null or put > cut").select("recipe", "path", "judged")

    def judgements(self, recipes: DataFrame) -> DataFrame:
        """(doc_id, seg, source, answer, verdict) of the books (book_id, recipe); a book that was moved finds its own again."""
        found = self._documents(recipes).join(recipes.select("book_id", "recipe"), "recipe")
        return found.select(document(F.col("book_id"), F.col("path")).alias("doc_id"), F.inline("judged"))

    def put(self, recipes: DataFrame, judgements: DataFrame, states: DataFrame, settings: Settings, titles: DataFrame, listed: bool = True) -> None:
        """Remember the judgements (doc_id, seg, source, answer, verdict) of documents and, if it is to be ``listed``, a row for each book's run."""
        now = F.lit(time.time_ns() // 1000)
        books = states.select("doc_id", "book_id", "path").join(recipes, "book_id")
        whole = judgements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg", "source", "answer", "verdict"))).alias("judged"))
        rows = whole.join(books, "doc_id").groupBy("recipe", "path").agg(F.min_by("judged", "book_id").alias("judged"))  # copies of a book are one
        self._add(rows.select("recipe", "path", "judged", now.alias("put")), "judgements")
        if not listed:
            return
        sized = books.groupBy("recipe").agg(F.countDistinct("path").alias("documents"), F.min("book_id").alias("source"))
        named = titles.select(F.col("book_id").alias("source"), F.coalesce(F.nullif("title", F.lit("")), "book_id").alias("book_title"))
        runs = sized.join(named, "source", "left").select("recipe", "source", "book_title", F.lit(settings.target_language).alias("target_language"), F.lit(settings.model).alias("model"), "documents", F.current_timestamp().alias("updated_at"), F.lit(False).alias("gone"), now.alias("put"))
        self._add(runs, "runs")

    def runs(self) -> DataFrame:
        """Stored runs with the documents that are done and the segments that are pending, most recent first."""
        rows = self._read("runs", _RUNS)
        latest = rows.groupBy("recipe").agg(F.max_by(F.struct("source", "book_title", "target_language", "model", "documents", "updated_at", "gone"), "put").alias("r")).where("not r.gone").select("recipe", "r.*").drop("gone")
        done = counted(self._documents().select("recipe", "path", F.inline_outer("judged")))
        return recent_first(latest.join(done, "recipe", "left").fillna(0, ["done", "pending"]))

    def discard(self, recipe: str) -> bool:
        """Forget a run; whether there was anything to forget."""
        known = self.runs().where(F.col("recipe") == recipe).drop("done", "pending")
        if known.first() is None:
            return False
        self._add(known.withColumns({"updated_at": F.current_timestamp(), "gone": F.lit(True), "put": F.lit(time.time_ns() // 1000)}).select(*[c.split()[0] for c in _RUNS.split(", ")]), "runs")
        return True


def counted(judgements: DataFrame) -> DataFrame:
    """(recipe, done, pending): documents that are stored, and segments of theirs without an accepted answer."""
    return judgements.groupBy("recipe").agg(F.countDistinct("path").alias("done"), F.count_if(~F.col("verdict").isin("ok", "tags")).alias("pending"))


def recent_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("updated_at").desc_nulls_last(), "recipe")


def listed(runs: DataFrame) -> DataFrame:
    """``runs`` with ``place``, the most recent first; a row a run, so the list is small."""
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.col("updated_at").desc_nulls_last(), "recipe")))
