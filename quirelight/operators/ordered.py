"""Running states over ordered rows of a key, in two levels.

A key may hold a third of all rows, so no window here spans a whole key.  The
caller names a ``block``: a deterministic expression that rises with the order
(an hour of a time, a run of turns).  States are folded inside (key, block),
the blocks' few summaries are folded along the key, and the two are joined.
Null keys and null blocks are groups of their own; null blocks come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def inside(by: tuple[str, ...], *order: str) -> Window:
    return Window.partitionBy(*by, BLOCK).orderBy(*order)


def along(by: tuple[str, ...], *more: str) -> Window:
    return Window.partitionBy(*by, *more).orderBy(F.col(BLOCK).asc_nulls_first())


def earlier(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def so_far(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def with_carry(rows: DataFrame, carried: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns that ``carried`` has for their (key, block)."""
    keys = (*by, BLOCK)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    return rows.alias("r").join(carried.alias("c"), same).select("r.*", *[f"c.{c}" for c in carried.columns if c not in keys])


#: Rows of a dense number that share a block.
SPAN = 1024


def numbered(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], block: Column) -> DataFrame:
    """``rows`` with ``place`` (from 1, in their key's order) and ``places`` (rows of the key)."""
    held = rows.withColumn(BLOCK, block)
    sums = held.groupBy(*by, BLOCK).agg(F.count("*").alias("_n"))
    carry = sums.select(*by, BLOCK, F.coalesce(F.sum("_n").over(earlier(along(by))), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    placed = with_carry(held.withColumn("_k", F.row_number().over(inside(by, *order))), carry, by)
    return placed.withColumns({"place": F.col("_before") + F.col("_k"), "places": F.col("_all")}).drop(BLOCK, "_k", "_before", "_all")


def last_before(rows: DataFrame, value: Column, by: tuple[str, ...], order: tuple[str, ...], block: Column, *, skip_nulls: bool = False) -> DataFrame:
    """``rows`` with ``before``: the value of the row before in its key, or with ``skip_nulls`` the latest that is not null."""
    held = rows.withColumns({BLOCK: block, "_value": value})
    place = F.struct(*order)
    if skip_nulls:
        own = F.last("_value", ignorenulls=True).over(earlier(inside(by, *order)))
        ends = held.groupBy(*by, BLOCK).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_end"))
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier(along(by)))).drop("_end")
        return with_carry(held.withColumn("_own", own), carry, by).withColumn("before", F.coalesce("_own", "_carry")).drop(BLOCK, "_value", "_own", "_carry")
    ends = held.groupBy(*by, BLOCK).agg(F.max_by("_value", place).alias("_end"))
    carry = ends.withColumn("_carry", F.lag("_end").over(along(by))).drop("_end")
    numbered = held.withColumns({"_k": F.row_number().over(inside(by, *order)), "_own": F.lag("_value").over(inside(by, *order))})
    return with_carry(numbered, carry, by).withColumn("before", F.when(F.col("_k") == 1, F.col("_carry")).otherwise(F.col("_own"))).drop(BLOCK, "_value", "_own", "_carry", "_k")


def limiter_slots(calls: DataFrame, gap: int, *by: str, span: int = 3_600_000_000) -> DataFrame:
    """``calls`` (now, order) with ``at``: start of each call's slot, slots at least ``gap`` apart, idle time not banked.

    at_i = i * gap + max over j <= i of (now_j - j * gap).  With B calls in the
    blocks before and k the place in the block, i = B + k, so a block's own
    maximum shifts by B * gap.  ``span`` is a block's length in units of ``now``.
    """
    held = calls.withColumn(BLOCK, F.floor(F.col("now") / span))
    held = held.withColumn("_k", (F.row_number().over(inside(by, "now", "order")) - 1).cast("long"))
    held = held.withColumn("_v", F.col("now") - F.col("_k") * gap)
    sums = held.groupBy(*by, BLOCK).agg(F.count("*").alias("_n"), F.max("_v").alias("_m"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier(along(by))), F.lit(0)))
    carry = sums.withColumn("_top", F.max(F.col("_m") - F.col("_base") * gap).over(earlier(along(by)))).drop("_n", "_m")
    rows = with_carry(held.withColumn("_own", F.max("_v").over(so_far(inside(by, "_k")))), carry, by)
    at = (F.col("_base") + F.col("_k")) * gap + F.greatest(F.col("_own") - F.col("_base") * gap, F.col("_top"))
    return rows.withColumn("at", at).drop(BLOCK, "_k", "_v", "_own", "_base", "_top")


def failure_runs(calls: DataFrame, limit: int, *by: str, block: Column) -> DataFrame:
    """Call at which each run of failures reaches ``limit``; ``calls``: order, failed.  A limit under 1 never trips.

    A block carries on the run that the blocks before end with: failures since
    the last block that holds a success, those after that success included.
    """
    held = calls.withColumn(BLOCK, block)
    held = held.withColumn("_island", F.sum((~F.col("failed")).cast("int")).over(so_far(inside(by, "order"))))
    held = held.withColumn("_k", F.sum(F.col("failed").cast("int")).over(so_far(Window.partitionBy(*by, BLOCK, "_island").orderBy("order"))))
    ends = held.groupBy(*by, BLOCK).agg(F.max_by("_k", "order").alias("_tail"), F.max(~F.col("failed")).cast("int").alias("_broke"))
    ends = ends.withColumn("_era", F.sum("_broke").over(so_far(along(by))))
    ends = ends.withColumn("_open", F.sum("_tail").over(so_far(along(by, "_era"))))
    carry = ends.select(*by, BLOCK, F.coalesce(F.lag("_open").over(along(by)), F.lit(0)).alias("_carry"))
    streak = F.col("_k") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return with_carry(held, carry, by).where(F.col("failed") & (streak == limit) & F.lit(limit > 0)).drop(BLOCK, "_island", "_k", "_carry")
