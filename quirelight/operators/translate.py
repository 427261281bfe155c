"""Runs over documents: plan, ask, validate, splice, remember, try again.

A run is a sequence of waves.  Each asks some of the planned batches and is committed to a log before the next begins, so a
run that is interrupted has lost one wave at most: started again on its path, it asks for what the log does not hold.

* The first wave is one batch: a service that refuses the key is asked once.
* With continuity (``context_chars``) wave k holds the k-th open batch of every book, and is shown the end of the
  translation so far, which travels from wave to wave with the replies; a lost executor repeats its part of one wave.
* Without it waves hold whole documents, as many as keep all cores busy for a while: ``wave`` batches a core at least, and
  where those are done sooner than in ``SECONDS``, up to four times as many as in the wave before.

Rate and failure guard are of the run, not of its tasks: a wave's tasks take the slots of one schedule in turn, and where
one wave's slots and its run of failures end the next wave's begin, over both passes and over restarts.  A provider that
can't go on ends the run after the wave; what was not asked stays pending.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import ordered as O
from quirelight.operators import prompt as P
from quirelight.operators import segments as G
from quirelight.operators import verdicts as V
from quirelight.operators.provider import COUNTERS, Aborted, Limiter, Provider, Request, Runner, Usage, interval
from quirelight.operators.log import Log
from quirelight.operators.settings import Settings

_USAGE = f"struct<{', '.join(f'{c}:bigint' for c in COUNTERS)}>"
_REPLIES = (
    "book_id string, chunk int, parts int, segs array<int>, answers array<string>, verdicts array<string>, remarks array<string>, messages array<string>, "
    f"calls int, usable int, usage {_USAGE}, asked boolean, error string"
)
#: What the log has beside: the batch's strings and their hash, its place in the book, the end of the translation after it, its last slot, the failures it ended with, and why it ended the run.
_LOGGED = "sources array<string>, mark long, turn long, tail string, slot double, streak int, stop string"
_LOG_COLUMNS = [c.split()[0] for c in _LOGGED.split(", ")]
_GIVEN = "doc_id book_id book_title title k place places chunk parts segs sources blocks mark turn tail".split()
_REPLY_COLUMNS = "book_id chunk parts segs answers verdicts remarks messages calls usable usage asked error".split()
#: How long a wave should take at least, as each costs some jobs beside its calls, and parts of the plan that waves are made of at most.
SECONDS, PARTS = 60.0, 256
#: Batches of a wave whose tails are broadcast.
FEW = 10_000
#: What a batch is told about the book, with the values for documents that are no part of one.
CONTEXT = {"book_title": "", "title": "", "k": 0, "place": 1, "places": 1}


@dataclass(frozen=True)
class Options:
    """Bounds of a run; the second pass shrinks the first two."""

    budget: int = 4000
    most: int = 40
    attempts: int = 4
    base_wait: float = 2.0
    failure_limit: int = 6
    answer_attempts: int = 2
    max_tokens: int = 16_000
    context_chars: int = 0
    requests_per_minute: int = 0
    wave: int = 64  # batches that a core asks in one wave, where batches don't follow each other
    second: bool = False
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def of(cls, settings: Settings) -> Options:
        return cls(settings.chunk_chars, settings.max_segments, settings.attempts, max_tokens=settings.max_tokens, context_chars=P.continuity(settings.context_chars), requests_per_minute=settings.requests_per_minute, settings=settings)

    def salvage(self) -> Options:
        return replace(self, budget=min(800, self.budget), most=min(4, self.most), second=True)


class Progress:
    """What a run has done so far, for the driver to look at while it runs: waves add up as they are committed.

    Counts come from the log, so a task that is repeated after a failure counts once.
    """

    COUNTS = ("batches", "segments", "accepted", "calls", "usable", "input", "output")

    def __init__(self, spark: SparkSession) -> None:
        self._own = dict.fromkeys(self.COUNTS, 0)

    def add(self, **more: int | None) -> None:
        self._own = {c: n + (more.get(c) or 0) for c, n in self._own.items()}

    def now(self) -> dict[str, int]:
        return dict(self._own)


def batches(segs: DataFrame, options: Options) -> DataFrame:
    """Ordered batches of the segments (doc_id, seg, source; block, book_id and ``CONTEXT`` where they have them)."""
    given = {"book_id": F.col("doc_id").cast("string"), "block": F.lit(False)} | {c: F.lit(v) for c, v in CONTEXT.items()}
    segs = segs.withColumns({c: v for c, v in given.items() if c not in segs.columns})
    keys = ["doc_id", "book_id", *CONTEXT]
    ordered = segs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg", "source", "block"))).alias("s"))
    sizes = F.transform("s", lambda x: F.octet_length(x["source"]).cast("bigint"))
    planned = ordered.withColumn("c", G.chunk_bounds(sizes, options.budget, options.most))
    cut = G.exploded(planned.withColumn("parts", F.size("c")), *keys, "s", "parts", array="c", place="chunk", value="c")
    part = F.slice("s", F.col("c.lo") + 1, F.col("c.hi") - F.col("c.lo"))
    return cut.select(*keys, "chunk", "parts", part.alias("part")).select(*keys, "chunk", "parts", F.col("part.seg").alias("segs"), F.col("part.source").alias("sources"), F.col("part.block").alias("blocks"))


@dataclass
class Pace:
    """The schedule of a run's calls, shared by its waves and passes: seconds since the epoch of the next free slot, and the failures that the calls so far end with."""

    gap: float = 0.0
    free: float = 0.0
    streak: int = 0

    @classmethod
    def of(cls, options: Options) -> Pace:
        return cls(interval(options.requests_per_minute))


def planned(segs: DataFrame, options: Options, log: Log, path: str) -> DataFrame | None:
    """The batches that the log has no usable reply to, with ``turn`` (place in the book), the wave they are asked in, and the tail that the log has before them; written by wave.  None if there are none."""
    spark = segs.sparkSession
    plan = batches(segs, options).withColumn("mark", F.xxhash64("segs", "sources", "blocks"))
    plan.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}-batches")
    plan = spark.read.parquet(f"{path}-batches")
    known = log.usable().select("doc_id", "chunk", "mark", F.lit(True).alias("known"), F.col("tail").alias("known_tail"))
    keys = plan.select("book_id", "k", "doc_id", "chunk", "mark").join(known, ["doc_id", "chunk", "mark"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if options.context_chars > 0:
        # numbers within a book in two levels, as a book may be any part of the rows
        block = F.floor(F.col("k") / O.SPAN)
        keys = O.numbered(keys, ("book_id",), ("k", "doc_id", "chunk"), block).withColumnRenamed("place", "turn").drop("places")
        last = O.last_before(keys, F.when(F.col("known"), F.struct("turn", "known_tail")), ("book_id",), ("turn",), F.floor(F.col("turn") / O.SPAN), skip_nulls=True)
        open_ = O.numbered(last.where("not known"), ("book_id",), ("turn",), F.floor(F.col("turn") / O.SPAN))
        keys = open_.select("book_id", "k", "doc_id", "chunk", "turn", F.col("place").alias("wave"), F.col("before.turn").alias("known_turn"), F.col("before.known_tail").alias("known_tail"))
    else:
        slots = max(1, spark.sparkContext.defaultParallelism) * options.wave
        size = keys.where("not known").count()
        shares = max(1, min(PARTS, -(-size // slots)))
        keys = keys.where("not known").select("book_id", "k", "doc_id", "chunk", F.lit(0).cast("long").alias("turn"), (F.pmod(F.xxhash64("doc_id"), F.lit(shares)) + 1).alias("wave"), F.lit(None).cast("long").alias("known_turn"), F.lit(None).cast("string").alias("known_tail"))
    # the lowest wave need not be the first one: documents of a share are few, or all of them in the log
    first = keys.orderBy("wave", "book_id", "k", "doc_id", "chunk").select("book_id", "doc_id", "chunk").first()
    if first is None:
        return None
    rows = plan.join(keys.drop("book_id", "k"), ["doc_id", "chunk"])
    # one batch goes ahead, and the book that follows it with it
    ahead = F.col("book_id") == F.lit(first.book_id) if options.context_chars > 0 else (F.col("doc_id") == F.lit(first.doc_id)) & (F.col("chunk") == first.chunk)
    rows = rows.withColumn("wave", F.when(ahead, F.col("wave") - 1 if options.context_chars > 0 else 0).otherwise(F.col("wave")))
    if options.context_chars <= 0:
        rows = rows.repartition("wave")  # a file for each, not for each task and each
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("wave").parquet(f"{path}-plan")
    return spark.read.parquet(f"{path}-plan")


def attempts(segs: DataFrame, make: Callable[[], Provider], options: Options, path: str, progress: Progress | None = None, *, pace: Pace | None = None, after: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Ask for the answers of ``segs`` in waves of batches; the judged replies are written to ``path`` and read back.

    ``after`` gets the replies of every document that a wave has finished.  Replies of an earlier start on ``path`` with the
    same options are kept; the log goes with ``forget``.
    """
    spark, pace = segs.sparkSession, pace or Pace.of(options)
    log = Log(spark, f"{path}-log", options, _log_schema(segs.schema["doc_id"].dataType.simpleString()))
    pace.free = max(pace.free, log.last_slot() + pace.gap)
    plan, stop = planned(segs, options, log, path), ""
    sizes = {} if plan is None else {r["wave"]: r["count"] for r in plan.groupBy("wave").count().collect()}  # two numbers a wave
    left, most, before = sorted(sizes), 1, 0
    while left and not stop:
        now, left, began = left[:most], left[most:], time.monotonic()
        stop = _wave(plan.where(F.col("wave").isin(now)), sum(sizes[w] for w in now), make, options, log, pace, progress, before <= FEW)
        before = sum(sizes[w] for w in now)
        if after is not None:
            after(log.finished(options.context_chars <= 0))
        if options.context_chars <= 0 and now != [0]:
            most = larger(len(now), time.monotonic() - began)
    given = spark.read.parquet(f"{path}-batches")
    columns = ["doc_id", *_REPLY_COLUMNS, "slot"]
    replies = log.rows()
    if log.before:  # else all of them are of this plan
        replies = replies.join(given.select("doc_id", "chunk", "mark"), ["doc_id", "chunk", "mark"], "left_semi")
    none = {"answers": "array<string>", "verdicts": "array<string>", "usage": _USAGE}
    unasked = given.join(replies.select("doc_id", "chunk"), ["doc_id", "chunk"], "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    unasked = unasked.withColumns({"remarks": F.array().cast("array<string>"), "messages": F.array().cast("array<string>"), "calls": F.lit(0), "usable": F.lit(0), "asked": F.lit(False), "error": F.lit(stop or None).cast("string"), "slot": F.lit(None).cast("double")})
    replies = replies.select(*columns)
    if stop or log.before:  # else every batch was asked
        replies = replies.unionByName(unasked.select(*columns))
    replies.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def larger(parts: int, took: float) -> int:
    """Parts of the plan for the wave after one of ``parts`` that took so many seconds."""
    return max(1, min(4 * parts, int(parts * SECONDS / max(took, 1e-3))))


def _log_schema(doc_type: str) -> str:
    return f"doc_id {doc_type}, {_REPLIES}, {_LOGGED}"


def committed(spark: SparkSession, path: str, options: Options, doc_type: str = "string") -> DataFrame:
    """The replies that a run on ``path`` has committed and may go on from."""
    return Log(spark, f"{path}/attempts-log", options, _log_schema(doc_type)).rows()


def _wave(rows: DataFrame, size: int, make: Callable[[], Provider], options: Options, log: Log, pace: Pace, progress: Progress | None, few: bool = False) -> str:
    """Ask one wave and commit its replies; why the run can't go on, if so.  ``few``: the wave before had so few batches that their tails go to every task."""
    spark = rows.sparkSession
    if options.context_chars > 0:
        said = F.broadcast(log.tails()) if log.own and few else log.tails()
        rows = rows.join(said, "book_id", "left").withColumn("tail", F.coalesce(F.when(F.col("said_turn") > F.coalesce("known_turn", F.lit(-1)), F.col("said")), F.col("known_tail"), F.lit("")))
    else:
        rows = rows.withColumn("tail", F.lit(""))
    tasks = max(1, min(size, spark.sparkContext.defaultParallelism))  # all at once, so that the rate is the one that was set
    given = rows.select(*_GIVEN).repartition(tasks).sortWithinPartitions("book_id", "k", "doc_id", "chunk")
    start, streak, system = max(time.time(), pace.free), pace.streak, P.system_text(options.settings, second=options.second)
    gap = pace.gap

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about: dict = {}

        def prompt(sources, second) -> Request:
            return Request(system, P.user_text(sources, **about), options.max_tokens, P.REPLY)

        task = TaskContext.get()
        limiter = Limiter(gap * tasks, time.time, next=start + gap * (task.partitionId() if task else 0), fixed=True)
        runner = Runner(make(), attempts=options.attempts, base_wait=options.base_wait, failure_limit=options.failure_limit, answer_attempts=options.answer_attempts, limiter=limiter, prompt=prompt, streak=streak)
        stopped = None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                about |= {"book": r.book_title, "passage": r.title, "k": r.place, "n": r.places, "part": r.chunk + 1, "parts": r.parts, "tail": r.tail}
                runner.remarks, runner.messages, runner.usage, runner.last_error = [], [], Usage(), ""
                calls, usable, got, asked = runner.calls, runner.usable, None, stopped is None
                sources, blocks = list(r.sources), [bool(b) for b in r.blocks]
                if asked:
                    try:
                        got = runner.answers(sources, blocks, options.second)
                    except Aborted as e:
                        stopped = str(e)
                judged = [V.judge(s, a, b) for s, a, b in zip(sources, got or [None] * len(sources), blocks, strict=True)]
                said = " ".join(X.plain_strip(a) for v, a in judged if v in V.ACCEPTED).strip() if options.context_chars > 0 else ""
                tail = P.last_runes(said, options.context_chars) if said else r.tail
                reply = (r.doc_id, r.book_id, r.chunk, r.parts, list(r.segs), got, None if got is None else [v for v, _ in judged], runner.remarks, runner.messages, runner.calls - calls, runner.usable - usable, {c: getattr(runner.usage, c) for c in COUNTERS}, asked, stopped if stopped else runner.last_error or None)
                out.append((*reply, sources, r.mark, r.turn, tail, limiter.last if runner.calls > calls else None, runner.streak, stopped if asked else None))
            yield pd.DataFrame(out, columns=["doc_id", *_REPLY_COLUMNS, *_LOG_COLUMNS])

    done = log.add(given.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_REPLIES}, {_LOGGED}"))
    good = F.size(F.filter("verdicts", lambda v: v.isin(*sorted(V.ACCEPTED))))
    total = done.agg(
        F.count_if("asked").alias("batches"), F.sum(F.when(F.col("asked"), F.size("segs"))).alias("segments"), F.sum(F.when(F.col("answers").isNotNull(), good)).alias("accepted"), F.sum("calls").alias("calls"), F.sum("usable").alias("usable"),
        F.sum("usage.input").alias("input"), F.sum("usage.output").alias("output"), F.max("slot").alias("slot"), F.max(F.when(F.col("usable") > 0, F.col("slot"))).alias("good"), F.min("stop").alias("stop"), F.count_if(F.expr("asked and usable = 0 and calls > 0")).alias("failed"),
    ).first()
    if progress is not None:
        progress.add(**{c: total[c] for c in Progress.COUNTS})
    if total.slot is not None:
        pace.free = total.slot + gap
    if total.stop is None and options.failure_limit > 0:  # the failures that the wave ends with, in the order of the calls
        pace.streak = (0 if total.good is not None else pace.streak) + (done.where("asked and usable = 0 and calls > 0").where(F.col("slot") > (total.good or 0.0)).count() if total.failed else 0)
        if pace.streak >= options.failure_limit:
            return f"{pace.streak} failures in a row"
    return total.stop or ""


def judged(segs: DataFrame, replies: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """``segs`` with answer and verdict; ``first``: earlier judgements that stand where nothing better came."""
    flat = replies.where("answers is not null").select("doc_id", F.inline(F.arrays_zip(F.col("segs").alias("seg"), F.col("answers").alias("answer"), F.col("verdicts").alias("verdict"))))
    new = segs.select("doc_id", "seg", "source").join(flat, ["doc_id", "seg"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("blank")))
    if first is None:
        return new
    again = flat.select("doc_id", "seg", F.col("answer").alias("answer2"), F.col("verdict").alias("verdict2"))
    better = V.accepted(F.coalesce("verdict2", F.lit("blank")))
    return first.join(again, ["doc_id", "seg"], "left").select("doc_id", "seg", "source", F.when(better, F.col("answer2")).otherwise(F.col("answer")).alias("answer"), F.when(better, F.col("verdict2")).otherwise(F.col("verdict")).alias("verdict"))


def results(verdicts: DataFrame) -> DataFrame:
    """(doc_id, text, total, done, pending, status) of judged segments; a document with nothing accepted is failed and unchanged."""
    good = V.accepted(F.col("verdict"))
    parts = F.array_sort(F.collect_list(F.struct("seg", F.when(good, F.col("answer")).otherwise(F.col("source")).alias("text"))))
    rolled = verdicts.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("total"), F.count_if(good).alias("done"), F.array_sort(F.collect_list(F.when(~good, F.col("seg")))).alias("pending"))
    return rolled.withColumn("status", F.when(F.col("done") == 0, "failed").otherwise("done"))


def reusable(segs: DataFrame, cache: DataFrame) -> DataFrame:
    """Judgements of ``cache`` (doc_id, seg, source, answer, verdict) for documents whose segments are the same as then."""
    known = cache.select("doc_id", "seg", "source", "answer", "verdict")
    here, there = (x.groupBy("doc_id").agg(F.count("*").alias(c)) for x, c in ((segs, "n"), (known, "m")))
    same = segs.select("doc_id", "seg", "source").join(known, ["doc_id", "seg", "source"]).groupBy("doc_id").agg(F.count("*").alias("both"))
    whole = here.join(there, "doc_id").join(same, "doc_id").where("n = both and m = both").select("doc_id")  # a changed structure is not patched
    return known.join(whole, "doc_id", "left_semi")


def translate(docs: DataFrame, make: Callable[[], Provider], path: str, *, options: Options | None = None, salvage: Callable[[], Provider] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Results of all documents: cached ones as they are, pending segments again, the rest afresh; then a second pass over what is pending.

    ``cache``: doc_id, seg, source, answer, verdict of an earlier run with the same recipe.  A run that was interrupted may be
    started again on its path.
    """
    return results(run(G.line_segments(docs), make, path, options=options, salvage=salvage, cache=cache))


def run(segs: DataFrame, make: Callable[[], Provider], path: str, *, options: Options | None = None, salvage: Callable[[], Provider] | None = None, cache: DataFrame | None = None, retry: bool = True, progress: Progress | None = None, resume: bool = True, finished: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Judgements (doc_id, seg, source, answer, verdict) of all segments; ``retry``: ask again for what is pending in the cache.

    ``resume``: go on where an interrupted run on ``path`` stopped.  ``finished`` gets the judgements of documents that the
    cache does not know as waves finish them.
    """
    options = options or Options()
    spark, pace = segs.sparkSession, Pace.of(options)
    if not resume:
        forget(spark, path)
    if cache is None:
        after = (lambda replies: finished(stored(replies))) if finished else None
        first = judged(segs, attempts(segs, make, options, f"{path}/attempts", progress, pace=pace, after=after))
    else:
        reusable(segs, cache).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/kept")  # every wave asks for it
        kept = spark.read.parquet(f"{path}/kept")
        known = kept.where(V.accepted(F.col("verdict"))) if retry else kept
        ask = segs.join(known.select("doc_id", "seg"), ["doc_id", "seg"], "left_anti")
        base = segs.select("doc_id", "seg", "source").join(kept.drop("source"), ["doc_id", "seg"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("blank")))
        after = (lambda replies: finished(stored(replies.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")))) if finished else None
        first = judged(ask, attempts(ask, make, options, f"{path}/attempts", progress, pace=pace, after=after), base)
    whole_run = spark.read.parquet(f"{path}/attempts").where("not asked").first() is None
    if salvage is not None:
        first.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/first")
        first = spark.read.parquet(f"{path}/first")
        left = first.where(~V.accepted(F.col("verdict"))).select("doc_id", "seg")
        # a document that was not asked to its end waits for another run
        whole = spark.read.parquet(f"{path}/attempts").groupBy("doc_id").agg(F.every(F.col("asked") & F.col("answers").isNotNull()).alias("whole")).where("whole").select("doc_id")
        ask = segs.join(left, ["doc_id", "seg"], "left_semi").join(whole, "doc_id", "left_semi")
        first = judged(ask, attempts(ask, salvage, options.salvage(), f"{path}/salvage", progress, pace=pace), first)
    first.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/verdicts")
    if whole_run:
        forget(spark, path)
    return spark.read.parquet(f"{path}/verdicts")


def stored(replies: DataFrame) -> DataFrame:
    """Judgements of whole documents out of their replies in the log."""
    flat = replies.select("doc_id", F.inline(F.arrays_zip(F.col("segs").alias("seg"), F.col("sources").alias("source"), F.col("answers").alias("answer"), F.col("verdicts").alias("verdict"))))
    return flat.select("doc_id", "seg", "source", "answer", F.coalesce("verdict", F.lit("blank")).alias("verdict"))


def forget(spark: SparkSession, path: str) -> None:
    """Delete the logs of a run on ``path``."""
    for name in ("attempts", "salvage"):
        Log.delete(spark, f"{path}/{name}-log")


def recipe(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the key under which results may be reused: every setting that changes an answer is part of it."""
    fields = [F.lit(settings[k]) for k in sorted(settings)]
    return docs.withColumn("recipe", X.recipe_key(F.sha2(F.coalesce("text", F.lit("")), 256), *fields))
