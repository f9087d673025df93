"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 32 bytes hits a fixed pattern, so equal passages give equal
chunks wherever they stand. Distinct chunks move once, to be told apart by their bytes; a document is then only the
ordered list of its chunks' verified identifiers, and documents are compared by these short lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, text_or_empty

_GEAR = mix64(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)


def chunk_ends(data: bytes, bits: int = 11, smallest: int = 256, largest: int = 65536) -> list[int]:
    """Byte offsets at which the chunks of ``data`` end (2^bits + smallest bytes on average); empty for no bytes."""
    n = len(data)
    if n == 0:
        return []
    if n <= smallest:
        return [n]
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):  # window of 2^5 bytes: h(i) = sum of gear(i - j) << j
        step = 1 << k
        shifted = rolled[:-step] << np.uint32(step)
        rolled = rolled.copy()
        rolled[step:] += shifted
    cuts = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1
    ends, last = [], 0
    for cut in cuts.tolist():
        if cut - last < smallest:
            continue
        while cut - last > largest:
            last += largest
            ends.append(last)
        if cut > last:
            ends.append(cut)
            last = cut
    while n - last > largest:
        last += largest
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunk_ends(t.encode("utf-8", "surrogatepass")))


def _chunks(text, ends):
    """The chunks of a text, as binary, from where they end."""
    starts = F.concat(F.array(F.lit(0)), ends)
    return F.zip_with(ends, F.slice(starts, 1, F.size(ends)), lambda end, start: F.substring(text.cast("binary"), start + 1, end - start))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, with null as the empty text; of equal texts the largest doc_id stays. Of rows that
    repeat both text and doc_id all count in group_size and all are marked kept. A null doc_id is returned as it is; it
    stays (with keep_id null) only if its whole group has no other id. An empty table gives an empty result. Other
    columns of ``docs`` play no part.

    ``chunk_hash``: Column -> bigint. Chunks whose hashes clash are told apart by an ordinal among the clashing texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    cut = texts.withColumn("ends", _ends("text"))
    chunked = cut.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), _chunks(F.col("text"), F.col("ends")).alias("chunks"))

    # Identifiers: the hash alone, unless different chunks share it (then hash and ordinal).
    distinct = cut.select(F.explode(_chunks(F.col("text"), F.col("ends"))).alias("chunk")).select(chunk_hash("chunk").alias("h"), "chunk").distinct()
    clashing = distinct.groupBy("h").count().where("count > 1").select("h")
    clashes = materialize(clashing)
    recipes = chunked.select("doc_id", "text_sha256", F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe"))
    if not clashes.isEmpty():
        recipes = _with_ordinals(chunked, distinct.join(clashes, "h"), chunk_hash)
    recipes = materialize(recipes.withColumn("recipe_hash", F.xxhash64("recipe")))

    # Only groups of several rows are joined back; a single row is its own group. Left rows of a hot group can be split.
    groups = materialize(recipes.groupBy("recipe_hash", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    out = recipes.join(groups, ["recipe_hash", "recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _with_ordinals(chunked: DataFrame, clashing: DataFrame, chunk_hash) -> DataFrame:
    """Recipes whose entries are hashes followed by the ordinal of the chunk among the texts that share its hash."""
    from pyspark.sql import Window

    named = materialize(clashing.withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long")))
    rows = materialize(chunked.withColumn("row", F.monotonically_increasing_id()))
    entries = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", chunk_hash("chunk")).join(named, ["h", "chunk"], "left")
    lists = entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("ordinal", F.lit(0).cast("long")).alias("ordinal")))).alias("e"))
    recipe = F.flatten(F.transform("e", lambda x: F.array(x["h"], x["ordinal"])))
    return rows.join(lists.select("row", recipe.alias("recipe")), "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", F.array().cast("array<bigint>")).alias("recipe"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
