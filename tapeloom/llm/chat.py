"""Perspective rotation: each dialogue once per participant, with that speaker as the assistant.

Only DataFrame functions. A dialogue is cut into blocks by its turn number
(`block_turns` numbers each), so that one endless conversation is many bounded
rows: a usual one is a single block. Every participant gets every block of the
conversation, also those where they say nothing. `context_roles` are no
participants; their turns are shown under their own name in each rendering.

One segment is `<|im_start|>NAME\\nTEXT<|im_end|>\\n`: NAME is `assistant` for
the participant, `user name=SPEAKER` for all others, the role itself for
context. `<|` inside a text or name becomes `< |`, so no text can forge a mark.
The mask lists the characters to learn: the participant's texts with their end
marks, without the headers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rendering.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
NO_TURN_CELLS = 1024


def _safe(column: str, empty: str) -> Column:
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit(empty)), F.lit("<|"), F.lit("< |"))


def blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """One row per conversation and block: `said`, its turns in order of (turn, role, text), null first.

    A row without a turn number has no place in the order: such rows lie in up
    to 1,024 blocks of their own per conversation, numbered below zero and dealt
    by a hash of role and text. More than `block_turns` rows of one block, from
    repeated turn numbers, are cut into further parts.
    """
    no_turn = -1 - F.pmod(F.xxhash64("speaker", "text"), F.lit(NO_TURN_CELLS))
    rows = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), _safe("role", "unknown").alias("speaker"), _safe("text", "").alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), no_turn).cast("long"))
    counted = rows.groupBy("conv_id", "block", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    ordered = counted.selectExpr(
        "*",
        "sum(copies) over (partition by conv_id, block order by turn, speaker, text rows between unbounded preceding and current row) - copies as before",
    )
    each = ordered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = F.col("before") + F.col("copy")
    placed = each.select("conv_id", "block", F.floor(place / block_turns).cast("int").alias("part"), place.alias("place"), "turn", "speaker", "text")
    return placed.groupBy("conv_id", "block", "part").agg(
        F.min("turn").alias("first_turn"), F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("said"))


def rotate(turns: DataFrame, *, context_roles: Sequence[str] = ("system",), block_turns: int = 64) -> DataFrame:
    """Rows (conv_id, speaker, block, part, first_turn, n_turns, rendered, mask, n_learn).

    `rendered` is the block as the speaker sees it, `mask` an array of
    (start, end) in characters of it, end exclusive, `n_learn` their total. A
    null role is the participant `unknown`, a null text is empty, a null conv_id
    is one conversation. A conversation with context turns only has no
    participant and gives no rows. Columns other than conv_id, turn, role and
    text are ignored; an empty table gives no rows.
    """
    context = F.array(*[F.lit(r) for r in context_roles]).cast("array<string>")
    speakers = turns.select("conv_id", _safe("role", "unknown").alias("speaker")).where(~F.array_contains(context, F.col("speaker"))).distinct()
    made = blocks(turns, block_turns).alias("b").join(
        speakers.alias("s"), F.col("b.conv_id").eqNullSafe(F.col("s.conv_id"))).select("b.*", "s.speaker")

    def segment(x: Column) -> Column:
        other = F.when(F.array_contains(context, x["speaker"]), x["speaker"]).otherwise(F.concat(F.lit("user name="), x["speaker"]))
        own = x["speaker"] == F.col("speaker")
        head = F.concat(F.lit(START), F.when(own, F.lit("assistant")).otherwise(other), F.lit(BREAK))
        body = F.concat(x["text"], F.lit(END))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"), F.length(head).alias("h"), F.length(body).alias("n"))

    made = made.withColumn("parts", F.transform("said", segment))
    sizes = F.transform("parts", lambda x: x["h"] + x["n"] + len(BREAK))
    ends = F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda done, x: done + x))
    spans = F.zip_with("parts", "ends", lambda x, end: F.struct(
        x["own"].alias("own"), (end - len(BREAK) - x["n"]).alias("start"), (end - len(BREAK)).alias("end")))
    mask = F.transform(F.filter(spans, lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    made = made.withColumn("sizes", sizes).withColumn("ends", ends).withColumn("mask", mask)
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(BREAK))), "")
    learn = F.aggregate("mask", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return made.select(
        "conv_id", "speaker", "block", "part", "first_turn", F.size("said").alias("n_turns"), text.alias("rendered"), "mask", learn.alias("n_learn"))


def flat_mask(rotated: DataFrame) -> DataFrame:
    """The rows with `mask` as text, `start:end` joined by commas."""
    return rotated.withColumn("mask", F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ","))


SQL = """
WITH t AS (
  SELECT conv_id, turn, CAST(floor(turn / 64.0) AS BIGINT) AS block, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, speaker, body) - 1 AS place FROM t),
s AS (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> 'system'),
j AS (
  SELECT r.conv_id, s.speaker, block, CAST(floor(place / 64.0) AS INTEGER) AS part, turn, place, r.speaker = s.speaker AS own,
    '<|im_start|>' || CASE WHEN r.speaker = s.speaker THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
      ELSE 'user name=' || r.speaker END || chr(10) AS head, body || '<|im_end|>' AS said
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (
  SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, speaker, block, part ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM j)
SELECT conv_id, speaker, block, part, min(turn) AS first_turn, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || said || chr(10), '' ORDER BY place) AS rendered,
  coalesce(string_agg((done - 1 - length(said)) || ':' || (done - 1), ',' ORDER BY place) FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(said)) FILTER (WHERE own), 0) AS INTEGER) AS n_learn
FROM w GROUP BY conv_id, speaker, block, part"""
