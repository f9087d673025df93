"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Low-quality documents go, then all but one of equal texts, then all but one of each group of near copies; the rest is
mixed to the sources' target weights and encoded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hubweave.llm.common import materialize, table
from hubweave.llm.exact_dedup import exact_dedup
from hubweave.llm.mixing import mix
from hubweave.llm.ngram_join import ngram_groups
from hubweave.llm.quality import keep_good
from hubweave.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs):
    """``docs`` with a unique ``row``, written once: doc_id may be null or repeated, and every reading has to agree."""
    return materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def _without_others(rows, grouped, order):
    """``rows`` without those of ``grouped`` (row, group) that aren't the first of their group by ``order``."""
    named = rows.select("row", "doc_id").join(grouped, "row")
    first = named.groupBy("group").agg(F.min_by("row", order).alias("stays"))
    dropped = grouped.join(first, "group").where("row <> stays").select("row")
    return rows.join(dropped, "row", "left_anti").select(COLUMNS)


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go.

    Each row is judged by its own text: repeated rows and repeated or null ids go or stay together. Null and empty texts
    get the sample's mean label. Without labels everything stays; an empty table stays empty. Columns other than those
    of documents are left out.
    """
    return keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts, one row with the largest doc_id stays; null is the smallest.

    Null and empty texts are equal. Of repeated rows and equal ids, the row that was numbered first stays; rows that
    share an id but not the text are told apart. An empty table stays empty.
    """
    rows = _numbered(docs)
    copies = materialize(exact_dedup(rows, "row").where("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")))
    return _without_others(rows, copies, F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), "row"))


def near_dedup_stage(spark, docs, sf_dir):
    """Of documents linked by Jaccard similarity of 5-word shingles of 0.75 or more, one row with the smallest doc_id stays; null is the largest.

    Texts without words link with nothing and stay. Repeated rows are one set, of which the row numbered first stays;
    rows that share an id are told apart. An empty table stays empty.
    """
    rows = _numbered(docs)
    named = materialize(ngram_groups(rows, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))
    several = named.where("row <> group").select("group").distinct()
    return _without_others(rows, materialize(named.join(several, "group", "left_semi")), F.struct(F.col("doc_id").isNull(), "doc_id", "row"))


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it: words taken / size, rounded; documents never taken go.

    Texts without words (null ones too) are never taken. A null source is a source of its own. Repeated rows, and rows
    with equal or null ids, each have their own share. An empty table stays empty.
    """
    rows = _numbered(docs)
    copies = mix(rows, row_col="row").where("size > 0").select("row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    repeated = rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(COLUMNS)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens, token_ids, round_trip of every row, whatever its id; null and empty texts have no tokens."""
    return encode(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express the classifier or the encoder; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
