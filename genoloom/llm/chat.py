"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.sources.files import numbered

BLOCK = 64
#: Letters of a text that ranges of messages are cut by.
PREFIX = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_TURN = 1 << 56


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each participant of each dialogue: that speaker rendered as assistant, all others as named users.

    A row is one chunk of a participant's rendering: ``block`` messages in their order, the last of a dialogue fewer, so a
    usual dialogue is one row and a long one spreads over rows that follow one another by ``chunk`` (0-based, of
    ``n_chunks``). Messages are numbered by ranges of the whole order, so nothing of a dialogue is gathered but its size
    and its speakers. ``rendered`` is the text, ``n_messages`` and ``first_message`` place it in the dialogue,
    ``mask_starts`` and ``mask_ends`` are the character spans (end exclusive, closing marker included) on which the
    participant is trained.

    Messages are ordered by (turn, speaker, text); equal rows are kept, and those that are equal in these up to PREFIX
    letters of the text are sorted by one task. A null turn comes after all others. A null or empty speaker is named
    ``unknown``, null text is empty, null ids form one dialogue. Other columns are dropped. No message, no row.
    """
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn), F.lit(NO_TURN)).cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col(speaker), F.lit("")), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first("conv_id"), F.col("turn"), F.col("speaker")]
    rows = numbered(rows, [*order, F.left("text", F.lit(PREFIX))], within=[*order, F.col("text")])
    sizes = rows.groupBy(F.col("conv_id").alias("id")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    placed = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("id"))).withColumn("part", F.floor((F.col("number") - F.col("first")) / block))
    blocks = placed.groupBy("first", "part").agg(F.any_value("conv_id").alias("conv_id"), F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("number", "speaker", "text"))).alias("messages"))
    people = placed.select("first", F.col("speaker").alias("participant")).distinct()
    views = blocks.join(people, "first").select(
        "conv_id", "participant", F.col("part").alias("chunk"), F.ceil(F.col("n") / block).alias("n_chunks"), (F.col("part") * block).alias("first_message"),
        F.size("messages").cast("long").alias("n_messages"), "messages",
    )

    def own(m: Column) -> Column:
        return m["speaker"] == F.col("participant")

    def head(m: Column) -> Column:
        return F.when(own(m), F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), m["speaker"], F.lit("\n")))

    def body(m: Column) -> Column:
        return F.concat(m["text"], F.lit(CLOSE))

    pieces = views.withColumn("pieces", F.transform("messages", lambda m: F.struct(F.concat(head(m), body(m)).alias("all"), F.length(head(m)).alias("head"), F.length(body(m)).alias("body"), own(m).alias("own"))))
    ends = F.expr("aggregate(pieces, cast(array(0) as array<int>), (a, p) -> concat(a, array(element_at(a, -1) + p.head + p.body)))")
    spans = F.filter(F.transform("pieces", lambda p, i: F.when(p["own"], F.struct((F.get("ends", i) + p["head"]).alias("start"), F.get("ends", i + 1).alias("end")))), lambda s: s.isNotNull())
    return (
        pieces.withColumn("ends", ends)
        .withColumn("spans", spans)
        .select(
            "conv_id", "participant", "chunk", "n_chunks", "first_message", "n_messages",
            F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("rendered"),
            F.transform("spans", lambda s: s["start"]).alias("mask_starts"), F.transform("spans", lambda s: s["end"]).alias("mask_ends"),
        )
    )


SQL = """
WITH m AS (
  SELECT conv_id, coalesce(turn, 72057594037927936) AS turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
o AS (
  SELECT *, (pos - 1) // 64 AS part FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) AS pos FROM m)),
v AS (
  SELECT o.*, p.participant, o.speaker = p.participant AS own,
    CASE WHEN o.speaker = p.participant THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || o.speaker || chr(10) END AS head,
    o.text || '<|im_end|>' || chr(10) AS body
  FROM o JOIN (SELECT DISTINCT conv_id AS id, speaker AS participant FROM m) p ON o.conv_id IS NOT DISTINCT FROM p.id),
s AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, part ORDER BY pos) AS stop FROM v),
g AS (
  SELECT conv_id, participant, part, count(*) AS n_messages, min(pos) - 1 AS first_message,
    string_agg(head || body, '' ORDER BY pos) AS rendered,
    coalesce(list((stop - length(body))::INTEGER ORDER BY pos) FILTER (WHERE own), []) AS mask_starts,
    coalesce(list(stop::INTEGER ORDER BY pos) FILTER (WHERE own), []) AS mask_ends
  FROM s GROUP BY conv_id, participant, part)
SELECT conv_id, participant, row_number() OVER (PARTITION BY conv_id, participant ORDER BY part) - 1 AS chunk,
  count(*) OVER (PARTITION BY conv_id, participant) AS n_chunks, first_message, n_messages, rendered, mask_starts, mask_ends
FROM g
"""
