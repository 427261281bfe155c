"""Interaction audit of document filters, as one relational word pipeline (DataFrame operations only).

Five filters fail a document on conditions of its whole text:

A  fewer than 200 words;
B  100 * distinct words < 50 * words;
C  100 * capital letters A-Z > 2 * code points;
D  holds one of ``# $ % & * |``;
E  the same text as a document of smaller id, anywhere in the table.

1. A narrow pass writes what characters alone decide (C, D, the text's digest and bytes), a short row a document.
2. Texts are dealt once by (id, text hash), 8 MB to a task.  Words are exploded, counted by (document, word), then by
   document for totals and distincts: both sums keep the dealing, so words are never shuffled.
3. The flags, the smallest id of each repeated digest (E) and the quality and toxicity labels are outer-joined to the
   totals; each document becomes a mask of the five failures.
4. Each part (source) sums 32 conditional counts, one a mask, for all, good and toxic documents.  All answers for the 120
   orders follow from those counts: ``clean[S]``, the documents that fail none of the filters in S, gives what is kept
   after any prefix of an order, and the Shapley sums.

A hot source is summed before it is shuffled; a document with very many words is one task's stream of words, spilled by
the aggregate; copies of a text that a third of the rows repeat are reduced to their smallest id before the join.

Defined results: null text is empty (fails A, not B, C, D); a null source is the part ``''``, as an empty one is; a row
without an id is judged by A to D and neither fails E nor makes another row fail it; repeated rows (same id and text) each
count, and don't fail E by each other; rows of one id with different texts are judged apart; several label rows of a
document count if one of them says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Fixed values of the filters: words, percentages, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
#: Bytes of text that one task explodes.
DEALT_BYTES = 8 << 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All of the orders, and for each step the filters before it and its own.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, known, part, text, h): ``known`` says whether the row has an id, ``h`` tells texts of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    return rows.withColumn("h", F.xxhash64("text", "known"))


def word_totals(rows: DataFrame, tasks: int) -> DataFrame:
    """(id, h, words, distinct) of each document; a null stands for the row itself, so that repeated rows are known."""
    words = rows.select("id", "h", "text").repartition(tasks, "id", "h").select("id", "h", F.explode(F.concat(F.split("text", "[\\x20\\x09-\\x0D]+"), F.array(F.lit(None).cast("string")))).alias("word")).where("word is null or word != ''")
    each = words.groupBy("id", "h", "word").agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    return each.groupBy("id", "h").agg(F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("said"), same.alias("same"), F.count("word").alias("distinct")).select("id", "h", F.expr("said div same").alias("words"), "distinct")


def flags(rows: DataFrame) -> DataFrame:
    """(id, h, part, known, bytes, digest, c, d): the conditions that need characters only."""
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    return rows.select("id", "h", "part", "known", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"), (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(f"[{SYMBOLS}]").alias("d"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of the documents."""
    rows = keyed(docs)
    marked = written(flags(rows), "flags")
    tasks = max(1, -(-(marked.agg(F.sum("bytes")).first()[0] or 0) // DEALT_BYTES))
    first = marked.where("known").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).withColumn("known", F.lit(True)).where("good + toxic > 0")
    joined = marked.join(word_totals(rows, tasks), ["id", "h"], "left").join(said, ["id", "known"], "left").join(first.select("digest", "first"), "digest", "left")
    failed = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.coalesce(F.col("known") & (F.col("first") < F.col("id")), F.lit(False)),
    }
    mask = sum((F.when(failed[x], _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    return joined.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def counted(judged: DataFrame) -> DataFrame:
    """A row a part: 32 conditional counts of all, good and toxic documents."""
    which = {"n": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    return judged.groupBy("part").agg(*[F.count_if((F.col("mask") == m) & test).alias(f"{name}_{m}") for name, test in which.items() for m in range(MASKS)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""

    def clean(name: str, avoided: int) -> Column:
        return sum((F.col(f"{name}_{m}") for m in range(MASKS) if not m & avoided), F.lit(0))

    sets = counted(masks(docs, labels)).select("part", *[F.array(*[clean(name, s) for s in range(MASKS)]).alias(name) for name in ("n", "good", "toxic")], F.array(*[F.col(f"n_{_bit(x)}") for x in FILTERS]).alias("alone"))
    # for each filter: the orders in which exactly the filters of a set come before it
    k = len(FILTERS)
    worth = [sum((factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (F.col("n")[s] - F.col("n")[s | _bit(x)]) for s in range(MASKS) if not s & _bit(x)), F.lit(0)) for x in FILTERS]
    sets = sets.withColumn("worth", F.array(*worth))
    steps = [(order, i + 1, letter, sum(map(_bit, order[:i])), _bit(letter), FILTERS.index(letter)) for order in ORDERS for i, letter in enumerate(order)]
    spec = F.from_json(F.lit(_steps_json(steps)), "array<struct<filter_order:string,step:int,filter:string,before:int,own:int,place:int>>")
    rows = sets.select("*", F.explode(spec).alias("s")).select("part", "n", "good", "toxic", "alone", "worth", "s.*")
    after = F.col("before").bitwiseOR(F.col("own"))
    at = lambda name, place: F.get(F.col(name), place)
    lost = lambda name: at(name, F.col("before")) - at(name, after)
    failing = at("n", F.lit(0)) - at("n", F.col("own"))
    return rows.select(
        "part", "filter_order", "step", "filter", at("n", after).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"), at("alone", F.col("place")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("worth", F.col("place")).alias("shapley"),
    )


def _steps_json(steps: list[tuple]) -> str:
    return "[" + ",".join(f'{{"filter_order":"{o}","step":{i},"filter":"{x}","before":{b},"own":{w},"place":{p}}}' for o, i, x, b, w, p in steps) + "]"


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels).drop("filter")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT row_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(first < d.doc_id, false)] AS fails
  FROM d JOIN first ON d.t = first.t LEFT JOIN l ON l.doc_id = d.doc_id),
 one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq FROM one a, one b, one c, one d, one e
  WHERE b.i != a.i AND c.i NOT IN (a.i, b.i) AND d.i NOT IN (a.i, b.i, c.i) AND e.i NOT IN (a.i, b.i, c.i, d.i)),
 steps AS (SELECT filter_order, seq, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
 kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS failing FROM f GROUP BY part, fails),
 judged AS (SELECT k.part, s.filter_order, s.step, s.seq[s.step] AS i, k.n, k.good, k.toxic, k.failing, k.fails[s.seq[s.step]] AS own, len(list_filter(s.seq[1 : s.step - 1], lambda j: k.fails[j])) > 0 AS gone FROM kinds k, steps s),
 totals AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN own AND failing = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM totals
"""
