"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

The mix is a row of slots of BLOCK words each. Slot k has the point frac(k * golden ratio), which the sources'
cumulative target shares map to a source; the slots of a source are ranked, and rank r takes block r modulo the
source's number of blocks, out of the source's documents laid end to end in shuffled order. Every pass over a source
takes each of its blocks once, so repeats are spread evenly and three passes are the most that the targets allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

BLOCK = 32
WEIGHTS = (5, 2, 1)
LIMIT = 3
GOLDEN = 2654435769  # 2^32 / golden ratio, odd
SPAN = 1 << 32
CELLS = 1 << 12
BUCKETS = 1024
RUN = 1 << 16


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source and size (words) of every row, and its row_col as ``given`` (null without one); the shuffle key is a digest of the id."""
    words = F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN))
    key = F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), key.alias("key"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("given"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, src (1, 2, ... by code point, null last), source_size, target.

    All words are shared by weight; a source takes 3 times its own size at most, and what is over goes to the others by
    weight. Sources reach their limit in the order of limit / weight, so one sorted pass settles who does. One row per
    source goes through here, sums that were made before the shuffle.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("src") - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = per_source.withColumn("src", F.row_number().over(in_order)).withColumn("weight", weight).withColumn("limit", LIMIT * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limits_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("limits_before")) / F.col("weight_left"))
    # the level of the first source that stays below its limit holds for all after it
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("limits_before", "level"))).over(everything)["level"]
    target = F.coalesce(F.least(final * F.col("weight"), F.col("limit")), F.col("limit"))
    return rows.select("source", "src", "source_size", target.alias("target"), "total")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    Size: words of the text, 0 for null. ``taken``: words that the mix takes of the row, repeats counted; at most 3
    times its size. A null source is one source, ordered last. Reruns and any partitioning agree: the shuffled order is
    that of a digest of the doc_id, rows of one id in order of size (then of ``row_col``, a unique number of each row, returned too if it
    is named). Without words every target and ``taken`` is 0; an
    empty table gives an empty result. Other columns play no part.

    Running offsets and ranks are two-level (within a bucket, then over the buckets' sums), so a source with a third of
    all rows is not one task.
    """
    sized = document_sizes(docs, id_col, text_col, source_col, row_col)
    sized = materialize(sized)
    sources = materialize(source_targets(sized))
    named = sized.join(sources.select("source", "src", "source_size", "target"), sized["source"].eqNullSafe(sources["source"])).drop("source")
    named = named.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % BUCKETS)

    # offset of each document in its source's shuffled stream
    sums = named.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "given").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["src", "bucket"])
    placed = placed.select("doc_id", "given", "size", "source_size", "target", "src", (F.col("base") + F.col("within")).alias("start"), F.monotonically_increasing_id().alias("row"))
    placed = materialize(placed)

    taken = block_uses(sources)
    pieces = placed.where("size > 0").select("row", "src", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    overlap = F.expr(f"least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})")
    used = pieces.join(taken, ["src", "block"]).groupBy("row").agg(F.sum(overlap * F.col("uses")).alias("taken"))
    named = [F.col("given").alias(row_col)] if row_col else []
    return placed.join(used, "row", "left").select("doc_id", *named, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def block_uses(sources: DataFrame) -> DataFrame:
    """(src, block, uses): how often the schedule takes each block; blocks that it never takes have no row."""
    spark = sources.sparkSession
    by_src = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    edges = sources.where("target > 0").select("*", F.sum("target").over(by_src).alias("upto"), F.sum("target").over(by_src.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    edges = edges.select(
        "src",
        F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}").alias("blocks"),
        F.floor((F.col("upto") - F.col("target")) / F.col("all") * SPAN).cast("long").alias("lo"),
        F.floor(F.col("upto") / F.col("all") * SPAN).cast("long").alias("hi"),
    ).where("hi > lo")
    size = SPAN // CELLS
    cells = edges.select("*", F.explode(F.expr(f"sequence(lo div {size}, (hi - 1) div {size})")).alias("cell"))

    total = sources.agg(F.coalesce(F.max("total"), F.lit(0.0))).first()[0]
    slots = int(-(-int(total) // BLOCK))
    point = F.expr(f"((id % {1 << 31}) * {GOLDEN}L) % {SPAN}L")
    drawn = spark.range(slots).select("id", point.alias("point")).withColumn("cell", F.expr(f"point div {size}"))
    drawn = drawn.join(cells, "cell").where("point >= lo and point < hi").select("id", "src", "blocks", F.expr(f"id div {RUN}").alias("run"))

    counts = drawn.groupBy("src", "run").agg(F.count(F.lit(1)).alias("slots"))
    ahead = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("src", "run", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("src", "run").orderBy("id")) - 1
    ranked = drawn.withColumn("within", rank).join(starts, ["src", "run"]).withColumn("rank", F.col("base") + F.col("within"))
    return ranked.where(f"rank < {LIMIT} * blocks").groupBy("src", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("uses"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM per),
v AS (SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             {LIMIT} * CAST(source_size AS DOUBLE) AS lim FROM w),
r AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(lim) OVER (ORDER BY lim / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limits_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM v),
l AS (SELECT *, (total - limits_before) / weight_left AS level FROM r),
f AS (SELECT arg_min(level, limits_before) AS final FROM l WHERE level * weight < lim),
src AS (SELECT source, src, source_size, total, coalesce(least(final * weight, lim), lim) AS target FROM l, f),
named AS (SELECT s.doc_id, s.size, s.key, CAST(('0x' || substr(s.key, 1, 8)) AS BIGINT) % {BUCKETS} AS bucket, src.* EXCLUDE (source) FROM sized s JOIN src ON s.source IS NOT DISTINCT FROM src.source),
placed AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
                  row_number() OVER () AS row FROM named),
edges AS (SELECT src, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks,
                 CAST(floor((sum(target) OVER o - target) / sum(target) OVER () * {SPAN}) AS BIGINT) AS lo,
                 CAST(floor(sum(target) OVER o / sum(target) OVER () * {SPAN}) AS BIGINT) AS hi
          FROM src WHERE target > 0 WINDOW o AS (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
slots AS (SELECT id, ((id % {1 << 31}) * {GOLDEN}) % {SPAN} AS point
          FROM (SELECT unnest(generate_series(0, (SELECT CAST(ceil(max(total) / {BLOCK}) AS BIGINT) - 1 FROM src))) AS id)),
ranked AS (SELECT e.src, e.blocks, row_number() OVER (PARTITION BY e.src ORDER BY id) - 1 AS rank
           FROM slots s JOIN edges e ON s.point >= e.lo AND s.point < e.hi),
uses AS (SELECT src, rank % blocks AS block, count(*) AS uses FROM ranked WHERE rank < {LIMIT} * blocks GROUP BY ALL),
pieces AS (SELECT row, src, start, size, unnest(generate_series(start // {BLOCK}, (start + size - 1) // {BLOCK})) AS block FROM placed WHERE size > 0),
used AS (SELECT row, sum((least(start + size, (p.block + 1) * {BLOCK}) - greatest(start, p.block * {BLOCK})) * uses) AS taken
         FROM pieces p JOIN uses u ON p.src = u.src AND p.block = u.block GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN used USING (row)
"""
