"""Chat formatting: every participant's perspective of a dialogue of several parties (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, running_start

#: Instructions are no participant; they stand in every perspective and are never trained on.
SYSTEM = "system"
NO_NAME = "unknown"
#: A rendered dialogue is given out in parts: a turn is in the part that its start, divided by this many characters, says.
PART_CHARS = 1 << 20
#: Turns of a cell, in which places are summed before cells are.
CELL_TURNS = 4096


def _plain(text: Column) -> Column:
    """Text that can't be taken for a mark of the format."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspective_turns(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and turn: conv_id, perspective, turn, role, body (the turn as rendered), skip (characters of its head),
    own (the participant speaks), start (its place in the rendered dialogue). See perspectives."""
    c, no_turn = F.col, F.lit(-1).cast("long")
    cleaned = turns.select(
        F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.regexp_replace(_plain(F.coalesce("role", F.lit(NO_NAME))), r"[\r\n]", " ").alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text")
    )
    speakers = cleaned.filter(c("role") != SYSTEM).groupBy("conv").agg(F.collect_set("role").alias("speakers"))
    rows = dealt_join(cleaned, speakers, "conv", "turn").withColumn("perspective", F.explode("speakers")).drop("speakers")
    who = F.when(c("role") == c("perspective"), F.lit("assistant")).when(c("role") == SYSTEM, F.lit("system")).otherwise(F.concat(F.lit("user name="), c("role")))
    head = F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))
    rows = rows.select(F.struct("conv", "perspective").alias("of"), "turn", "role", "text", F.concat(head, c("text"), F.lit("<|im_end|>\n")).alias("body"), F.char_length(head).alias("skip"))
    rows = rows.withColumn("cell", F.coalesce(F.floor(c("turn") / CELL_TURNS), no_turn - (1 << 40)))
    placed = running_start(rows, "of", "cell", ["turn", "role", "text"], F.char_length("body").cast("long"), "start")
    return placed.select(c("of.conv.conv_id").alias("conv_id"), c("of.perspective").alias("perspective"), "turn", "role", "body", "skip", (c("role") == c("of.perspective")).alias("own"), "start")


def perspectives(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and part: conv_id, perspective, part, rendered, n_turns, spans (array of start, end in rendered).

    turns: conv_id, turn, role, text. A turn is `<|im_start|>assistant`, newline, text, `<|im_end|>`, newline, if the
    perspective's participant speaks, `<|im_start|>user name=<speaker>` if another does, `<|im_start|>system` for instructions.
    spans cover text and end mark of the assistant's turns: those characters carry loss. `<|` in a text or role becomes `< |`, a line end in a
    role a space, so no turn can forge another.

    A dialogue of up to PART_CHARS characters is one part, numbered 0; a longer one has several, cut between turns, so that no row or task holds more
    than that and one turn. Turns are ordered by turn, role, text, so that ties and repeated rows have one result. A null role is a speaker called
    unknown, a null text an empty turn, a null turn comes first, rows without conv_id form one conversation. A dialogue of instructions alone has no
    perspective. Other columns are ignored. An empty table gives no rows.
    """
    placed = perspective_turns(turns).withColumn("part", F.floor(F.col("start") / PART_CHARS))
    said = F.sort_array(F.collect_list(F.struct("start", "body", "skip", "own")))
    parts = placed.groupBy("conv_id", "perspective", "part").agg(said.alias("said"))
    first = F.col("said")[0]["start"]

    def span(t: Column) -> Column:
        begin = (t["start"] - first).cast("int")
        return F.struct((begin + t["skip"]).alias("start"), (begin + F.char_length(t["body"]) - 1).alias("end"))

    spans = F.transform(F.filter("said", lambda t: t["own"]), span)
    return parts.select("conv_id", "perspective", "part", F.array_join("said.body", "").alias("rendered"), F.size("said").alias("n_turns"), spans.alias("spans"))


def perspective_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and part: conv_id, perspective, part, n_turns, n_chars, n_own (spans), own_chars, rendered_sha256, mask_sha256."""
    p = perspectives(turns)
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return p.select(
        "conv_id", "perspective", "part", F.col("n_turns").cast("long").alias("n_turns"), F.char_length("rendered").cast("long").alias("n_chars"), F.size("spans").cast("long").alias("n_own"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("own_chars"),
        F.sha2("rendered", 256).alias("rendered_sha256"), F.sha2(mask, 256).alias("mask_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\r\n]', ' ', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
x AS (SELECT p.conv_id, perspective, turn, role, text, role = perspective AS own,
  '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS body FROM x),
s AS (SELECT *, (sum(length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - length(body) AS start FROM y),
z AS (SELECT *, start // 1048576 AS part, min(start) OVER (PARTITION BY conv_id, perspective, start // 1048576) AS base FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, sum(length(body))::BIGINT AS n_chars, count(*) FILTER (own) AS n_own,
  coalesce(sum(length(body) - length(head) - 1) FILTER (own), 0)::BIGINT AS own_chars,
  sha256(string_agg(body, '' ORDER BY start)) AS rendered_sha256,
  sha256(coalesce(string_agg((start - base + length(head))::VARCHAR || '-' || (start - base + length(body) - 1)::VARCHAR, ',' ORDER BY start) FILTER (own), '')) AS mask_sha256
FROM z GROUP BY conv_id, perspective, part
"""
