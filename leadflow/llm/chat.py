"""Chat formatting by perspective rotation.

Of a dialogue between any number of speakers, one training text is made for every participant:
that speaker's messages are the assistant's, the others' are named users', and the mask marks
what the assistant says. A dialogue of more than PART_TURNS messages comes in several rows, so that
no group grows without bound; put together in the order of `part` they are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.operators.ranking import group_rank

PART_TURNS = 4096
SYSTEM = "system"


def _header(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))


END = "<|end|>\n"


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conversations {conv_id, turn, role, text} -> one row per dialogue part and participant:
    conv_id, part, perspective, n_messages, n_target, text, mask (array of structs start, end).

    Messages are ordered by turn, then role, then text; a null turn comes first, a null role is the speaker
    "unknown", a null text is empty. A part has part_turns messages in this order, the last one what is left,
    whatever their turns are. `system` is no participant: it keeps its own header, and a dialogue in which only
    it speaks has rows with a null perspective. Every participant of the dialogue has each of its parts; where
    one is silent n_target is 0. Repeated rows are repeated messages. A row with a null conv_id belongs to no dialogue: it
    makes one of its own. "<|" in a name or text is written "< |", so that it cannot be taken for a
    header; a name's "|>" becomes "| >" and its line breaks spaces, so that it cannot end one. Other columns of
    `conversations` are not part of a rendering and do not come out. mask gives characters, from 0, of the assistant's words and end marks. An empty table gives one.
    """
    clean = lambda c, default: F.replace(F.coalesce(c.cast("string"), F.lit(default)), F.lit("<|"), F.lit("< |"))
    name = F.translate(F.replace(clean(F.col("role"), "unknown"), F.lit("|>"), F.lit("| >")), "\r\n", "  ")
    rows = conversations.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), name.alias("role"), clean(F.col("text"), "").alias("text")).alias("m"),
    )
    some = rows.where("conv_id is not null")
    ordered = F.array_sort(F.collect_list("m"))
    # only dialogues of more than one part are ranked; there are rows / part_turns of them at most
    long = some.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns).select("conv_id")
    whole = some.join(long, "conv_id", "left_anti").groupBy("conv_id").agg(ordered.alias("ms")).select("conv_id", F.lit(0).cast("long").alias("part"), "ms")
    ranked = group_rank(some.join(long, "conv_id", "left_semi"), [F.col("conv_id")], [F.col("m")])  # no task sorts a whole dialogue
    cut = ranked.withColumn("part", F.floor((F.col("rank") - 1) / part_turns).cast("long")).groupBy("conv_id", "part").agg(ordered.alias("ms"))
    together = whole.unionByName(cut)
    # the whole dialogue's participants meet each of its parts; a dialogue of `system` alone has none
    speakers = some.where(F.col("m.role") != SYSTEM).select("conv_id", F.col("m.role").alias("perspective")).distinct()
    joined = together.join(speakers, "conv_id", "left").select("conv_id", "part", "ms", "perspective")
    alone = rows.where("conv_id is null").select("conv_id", F.lit(0).cast("long").alias("part"), F.array("m").alias("ms"), F.when(F.col("m.role") != SYSTEM, F.col("m.role")).alias("perspective"))
    each = joined.unionByName(alone)
    own = lambda m: m["role"].eqNullSafe(F.col("perspective"))

    def piece(m: Column) -> Column:
        head = _header(m["role"], F.coalesce("perspective", F.lit("")))
        return F.struct(head.alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), own(m).alias("own"))

    pieces = each.select("conv_id", "part", "perspective", F.transform("ms", piece).alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def walk(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["mask"]).alias("mask"))

    return pieces.select(
        "conv_id",
        "part",
        "perspective",
        F.size("ps").cast("long").alias("n_messages"),
        F.size(F.filter("ps", lambda p: p["own"])).cast("long").alias("n_target"),
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("ps", start, walk, lambda s: s["mask"]).alias("mask"),
    )


def rotation_rows(conversations: DataFrame) -> DataFrame:
    """rotate() with the mask written as text, "start-end" joined by commas."""
    out = rotate(conversations)
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


#: The same rows in DuckDB: parts by the rank of a message, participants of the whole dialogue.
ROTATION_SQL = f"""
WITH m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, translate(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (SELECT *, CASE WHEN conv_id IS NULL THEN r ELSE 0 END AS alone FROM m),
k AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text, r) - 1) // {PART_TURNS} AS BIGINT) AS part FROM n),
p AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM k WHERE role <> 'system'
  UNION ALL SELECT conv_id, alone, NULL FROM k GROUP BY ALL HAVING bool_and(role = 'system')),
j AS (
  SELECT k.conv_id, k.part, k.alone, p.perspective, k.turn, k.role, k.text, k.r, k.role IS NOT DISTINCT FROM p.perspective AS own,
    CASE WHEN k.role = 'system' THEN '<|system|>' WHEN k.role = p.perspective THEN '<|assistant|>' ELSE '<|user:' || k.role || '|>' END || chr(10) AS head,
    k.text || '<|end|>' || chr(10) AS body
  FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.alone = p.alone),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, alone, perspective ORDER BY turn NULLS FIRST, role, text, r ROWS UNBOUNDED PRECEDING) AS e FROM j)
SELECT conv_id, part, perspective, count(*) AS n_messages, count(*) FILTER (own) AS n_target,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text, r) AS text,
  coalesce(string_agg((e - length(body)) || '-' || e, ',' ORDER BY e) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, part, alone, perspective
"""
