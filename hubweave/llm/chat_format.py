"""Chat formatting: multi-party perspective rotation. DataFrame operations only.

Every participant of a conversation gets a rendering of it in which that speaker is the assistant, the other speakers
are users by name, and the loss mask covers what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 256  # turns of one row at most; a longer conversation goes on in the next row
SYSTEM = "system"


def _cell(text):
    """Text in which no marker can be read."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role):
    """A role in a header, which ends with its line."""
    return F.regexp_replace(_cell(role), r"[\r\n]", " ")


def rotate_perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, participant and page: conv_id, participant, page, n_turns, text_offset, text, spans.

    Participants are the distinct roles of a conversation but ``system``, whose turns stay system turns for all; a
    conversation of system turns only is rendered once, with participant null. ``spans`` lists the (start, end) offsets
    in the whole rendering to train on: the assistant's words and end marker. Turns stand in order of turn, role, text, null turns
    first on the page of turn 0; repeated rows are rendered as often. A null role is the speaker ``unknown``, a null text is empty, rows with
    a null conv_id form one conversation. An empty table gives an empty result; other columns play no part.

    A conversation of up to PAGE turns is one row for each participant, whatever its turn numbers. A row can't hold a
    conversation of any length, so longer ones are cut after every PAGE turns. ``text_offset`` is where a page's text
    begins in the whole rendering, and spans count from the rendering's start: the pages, put together in order, are the
    whole rendering with its spans, wherever they are cut.
    """
    speaker = F.coalesce(F.col(role).cast("string"), F.lit("unknown"))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), speaker.alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # places in a conversation in two steps, as it may be long: within a stretch of turn numbers, then over stretches
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / PAGE), F.lit(-(2**62))))
    order = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.withColumn("place", F.row_number().over(order)).join(sizes, F.expr("conv_id <=> c and stretch = s"))
    placed = placed.select("conv_id", (F.col("before") + F.col("place")).alias("place"), "role", "text").withColumn("page", F.expr(f"cast((place - 1) div {PAGE} + 1 as int)"))
    pages = placed.groupBy("conv_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    speakers = rows.groupBy("conv_id", "role").count().withColumn("participant", F.when(F.col("role") != SYSTEM, F.col("role")))
    alone = speakers.groupBy("conv_id").agg(F.count("participant").alias("n"))
    speakers = speakers.join(alone.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c")).where("participant is not null or n = 0").select(F.col("conv_id").alias("c"), "participant")
    seen = pages.join(speakers, F.expr("conv_id <=> c")).drop("c")

    def head(t):
        name = F.when(t["role"].eqNullSafe(F.col("participant")), F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _name(t["role"])))
        return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))

    def length(t):
        return F.length(head(t)) + F.length(_cell(t["text"])) + len("<|im_end|>\n")

    # where each page begins, from lengths alone; rows of a long conversation's pages are narrow here
    lengths = seen.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("page").alias("g"), F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + length(t)).alias("length"))
    before = F.sum("length").over(Window.partitionBy("c", "p").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = lengths.where("g > 1").select("c", "p").distinct().join(lengths.withColumnsRenamed({"c": "c2", "p": "p2"}), F.expr("c <=> c2 and p <=> p2")).select("c", "p", "g", "length")
    offsets = offsets.select("c", "p", "g", before.alias("text_offset"))
    seen = seen.join(offsets, F.expr("conv_id <=> c and participant <=> p and page = g"), "left").withColumn("text_offset", F.coalesce("text_offset", F.lit(0).cast("long")))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_cell(t["text"]), F.lit("<|im_end|>\n")).alias("body"), t["role"].eqNullSafe(F.col("participant")).alias("own")))
    seen = seen.withColumn("parts", parts)
    span_type = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.col("text_offset").alias("at"), F.array().cast(span_type).alias("spans"))

    def add(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), (end - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return seen.select(
        "conv_id",
        "participant",
        "page",
        F.size("turns").alias("n_turns"),
        "text_offset",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("parts", start, add)["spans"].alias("spans"),
    )


def formatted_query(turns: DataFrame) -> DataFrame:
    """The renderings with their spans as text: start-end, start-end, ..."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate_perspectives(turns).withColumn("spans", spans)


ORACLE_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM r),
q AS (SELECT *, (place - 1) // {PAGE} + 1 AS page FROM o),
s AS (SELECT DISTINCT conv_id, CASE WHEN role <> 'system' THEN role END AS participant FROM r),
k AS (SELECT * FROM s WHERE participant IS NOT NULL UNION ALL SELECT conv_id, NULL FROM s GROUP BY conv_id HAVING count(participant) = 0),
t AS (SELECT q.conv_id, k.participant, q.page, q.place, q.role IS NOT DISTINCT FROM k.participant AS own,
             '<|im_start|>' || CASE WHEN q.role IS NOT DISTINCT FROM k.participant THEN 'assistant' WHEN q.role = 'system' THEN 'system' ELSE 'user name=' || replace(replace(replace(q.role, '<|', '< |'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head,
             replace(q.text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
      FROM q JOIN k ON q.conv_id IS NOT DISTINCT FROM k.conv_id),
u AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY place) AS upto FROM t)
SELECT conv_id, participant, CAST(page AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(min(upto - length(head) - length(body)) AS BIGINT) AS text_offset, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY place), '') AS spans
FROM u GROUP BY conv_id, participant, page
"""
