"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that
speaker as ``assistant`` (unnamed) and everybody else as a named ``user``;
``system`` turns stay system turns and rotate to nobody.  Every message carries
its place in the rendered text and a mask that is true for the assistant's own
content only.

All DataFrame operations.  A conversation may hold a third of all turns, so it is
never gathered by its id alone: turns meet their perspectives by conversation and
run of ``CHUNK`` turns.  Character places are prefix sums in two levels: the
lengths of runs follow from the turns before any rotation (a message's length as
``user`` and as ``assistant`` is known from its speaker), a running sum over the
runs gives each run's start, and a running sum inside the run each message's.

Defined results: a null text is empty; a null role is the speaker ``unknown``;
null conversation ids form one conversation; turns are ordered by (turn, role,
text), nulls first, repeated rows one after another; a conversation of system
turns only has no participant and gives no row; control markers and line feeds in
a name, and control markers in a text, are escaped; very long texts stay whole;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
CHUNK = 1024


def _escaped(text: Column) -> Column:
    """Control markers inside a message can't open or close one."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _name(speaker: Column) -> Column:
    """A name stays on the header's line."""
    return F.replace(F.replace(_escaped(speaker), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn: role, name, rendered message, [start, end) of the message and of its content in the rendered dialogue, mask."""
    speaker = F.coalesce("role", F.lit("unknown"))
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    system = F.col("speaker") == SYSTEM
    as_other = F.concat(F.lit(OPEN), F.when(system, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _name(F.col("speaker")))), F.lit("\n"))
    as_own = F.lit(f"{OPEN}assistant\n")
    body = F.length(_escaped(F.col("text"))).cast("long") + len(CLOSE) + 1
    # by conversation, run of turns and speaker: small, whatever the texts
    runs = said.groupBy("conv_id", "chunk", "speaker").agg(F.sum(F.length(as_other) + body).alias("other"), F.sum(F.length(as_own) - F.length(as_other)).alias("more"))
    whole = runs.groupBy("conv_id", "chunk").agg(F.sum("other").alias("total"))
    people = runs.where(~system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seats = whole.alias("w").join(people.alias("p"), F.expr("w.conv_id <=> p.conv_id")).select("w.*", "perspective").alias("s")
    own = runs.where(~system).alias("o")
    sums = seats.join(own, F.expr("s.conv_id <=> o.conv_id and s.chunk <=> o.chunk and s.perspective = o.speaker"), "left").select("s.conv_id", "s.chunk", "perspective", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    joined = said.alias("t").join(starts.alias("b"), F.expr("t.conv_id <=> b.conv_id and t.chunk <=> b.chunk")).select("t.*", "perspective", "base")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(system, F.lit(SYSTEM)).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.when(mine, as_own).otherwise(as_other)
    rows = joined.select("conv_id", "perspective", "turn", "chunk", "speaker", "text", "base", role.alias("role"), F.when(role == "user", F.col("speaker")).alias("name"), head.alias("head"), mine.alias("mask"))
    rows = rows.withColumn("size", F.length("head") + body)
    inside = Window.partitionBy("conv_id", "perspective", "chunk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    end = F.col("start") + F.col("size")
    message = F.concat("head", _escaped(F.col("text")), F.lit(CLOSE + "\n"))
    return placed.select("conv_id", "perspective", "turn", "role", "name", message.alias("message"), "start", end.alias("end"), (F.col("start") + F.length("head")).alias("content_start"), (end - len(CLOSE) - 1).alias("content_end"), "mask")


def digest(turns: DataFrame) -> DataFrame:
    """Every rendered message by its hash, with its place and mask."""
    return rotate(turns).select("conv_id", "perspective", "turn", "role", "name", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "content_start", "content_end", "mask", F.sha2("message", 256).alias("message_sha256"))


ORACLE = """
WITH said AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
     people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
     parts AS (SELECT s.*, p.perspective,
                 CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
                 speaker = perspective AS mask
               FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
     heads AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
                 '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(replace(speaker, '<|', '<\\|'), chr(13), '\\r'), chr(10), '\\n') ELSE '' END || chr(10) AS head FROM parts),
     msgs AS (SELECT *, head || replace(text, '<|', '<\\|') || '<|im_end|>' || chr(10) AS message FROM heads),
     placed AS (SELECT *, coalesce(sum(length(message)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM msgs)
SELECT conv_id, perspective, turn, role, name, CAST(s AS BIGINT) AS start_char, CAST(s + length(message) AS BIGINT) AS end_char,
       CAST(s + length(head) AS BIGINT) AS content_start, CAST(s + length(message) - 11 AS BIGINT) AS content_end, mask, sha256(message) AS message_sha256
FROM placed
""".replace("\\\\", "\\")
