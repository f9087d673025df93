"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are counted in hashed places: words, word shapes, byte pairs and repeats of the word before. A bounded sample of
labelled documents gives inverse document frequencies and, by singular value decomposition, the latent axes; its
vectors and labels are broadcast. Every document is then compared with all of them, in blocks, by exact cosine
products, and its nearest neighbours vote with their similarities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, first_rows, mix64, string_parts, word_hashes, word_spans

SAMPLE_PER_LABEL = 1500  # bound of the fit: labelled rows taken per label
AXES = 48
ITERATIONS = 12
NEIGHBOURS = 15
THRESHOLD = 0.3
WORDS, SHAPES, PAIRS = 768, 256, 1023  # hashed places; one more for repeats
PLACES = WORDS + SHAPES + PAIRS + 1

_KIND = np.full(256, 3, np.int64)  # 0 lower, 1 upper, 2 digit, 3 other ASCII, 4 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4


def term_counts(column: pa.Array):
    """Yield (first row, counts) with one row of PLACES counts per text."""
    for row, offsets, data in string_parts(column, 1 << 19):
        n = len(offsets) - 1
        starts, ends, first = word_spans(offsets, data)
        of_word = np.repeat(np.arange(n), np.diff(first)) * PLACES
        words = word_hashes(data, starts, ends)
        lengths = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.int64), 9)
        if len(starts):
            shapes = (_KIND[data[starts]] * 5 + _KIND[data[ends - 1]]) * 10 + lengths
        else:
            shapes = np.zeros(0, np.int64)
        places = [of_word + (words % np.uint64(WORDS)).astype(np.int64), of_word + WORDS + shapes % SHAPES]
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
        places.append(of_word[again] + PLACES - 1)
        lower = _LOWER[data].astype(np.uint64)
        of_byte = np.repeat(np.arange(n), np.diff(offsets)) * PLACES
        inside = of_byte[1:] == of_byte[:-1]
        pairs = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)[(lower[:-1] * np.uint64(256) + lower[1:]).astype(np.int64)]
        places.append((of_byte[1:] + WORDS + SHAPES + pairs)[inside])
        yield row, np.bincount(np.concatenate(places), minlength=n * PLACES).reshape(n, PLACES)


def _labelled_terms(batches):
    for batch in batches:
        for row, counts in term_counts(batch["text"]):
            part = batch.slice(row, len(counts))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"], pa.array([c.astype(np.float32).tobytes() for c in counts], pa.binary())], ["doc_id", "quality", "counts"])


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, text of at most SAMPLE_PER_LABEL rows per label, first in order of a digest of the id."""
    per_doc = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    per_doc = per_doc.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    digested = per_doc.withColumn("digest", F.md5(F.col("doc_id").cast("string").cast("binary")))
    chosen = first_rows(digested, "quality", ["digest", "doc_id"], SAMPLE_PER_LABEL).drop("digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "text").limit(2 * SAMPLE_PER_LABEL)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: idf, axes, the sample's vectors and labels. Without labelled rows it votes 0.5 for everything."""
    rows = training_sample(docs, labels).select("doc_id", "quality", "text").mapInArrow(_labelled_terms, "doc_id long, quality int, counts binary").toPandas()
    if rows.empty:
        return {"idf": np.ones(PLACES, np.float32), "axes": np.zeros((PLACES, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0), "prior": 0.5}
    rows = rows.sort_values(["doc_id", "quality", "counts"])
    labels = rows["quality"].to_numpy(np.float64)
    counts = np.stack([np.frombuffer(x, np.float32) for x in rows.pop("counts")])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    axes = latent_axes(weigh(counts, idf))
    return {"idf": idf, "axes": axes, "vectors": latent(counts, idf, axes), "labels": labels, "prior": float(labels.mean())}


def latent_axes(terms: np.ndarray) -> np.ndarray:
    """The leading right singular directions of ``terms``, by iterating on a subspace that is a third wider."""
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(terms.shape[1], min(AXES + AXES // 3, *terms.shape))))[0]
    for _ in range(ITERATIONS):
        basis = np.linalg.qr(terms.T @ (terms @ basis.astype(np.float32)))[0]
    small = (terms @ basis.astype(np.float32)).astype(np.float64)
    _, turned = np.linalg.eigh(small.T @ small)
    return (basis @ turned[:, ::-1][:, :AXES]).astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms = np.log1p(counts.astype(np.float32)) * idf
    return terms / np.maximum(np.sqrt((terms * terms).sum(1, keepdims=True)), 1e-12)


def latent(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = weigh(counts, idf) @ axes
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Similarity-weighted mean label of the NEIGHBOURS nearest, labels weighing the inverse of their frequency in the
    sample; the sample's mean label where nothing is similar."""
    if not len(model["labels"]):
        return np.full(len(vectors), model["prior"])
    near = vectors @ model["vectors"].T
    k = min(NEIGHBOURS, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 4
    labels = model["labels"]
    balance = np.where(labels == 1, 1 / max(labels.sum(), 1), 1 / max((1 - labels).sum(), 1))
    weights *= balance[best]
    total = weights.sum(1)
    votes = (weights * labels[best]).sum(1)
    return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), model["prior"]), 0, 1)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Learns from rows of ``labels`` with quality 0 or 1 whose crc32(doc_id) mod 5 is not 0; a doc_id labelled twice
    counts with its smaller label. Only the text is scored. Null and empty texts get the sample's mean label, as do
    texts similar to no labelled one. A null doc_id is returned with held_out null. Other columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def scores(batches):
        for batch in batches:
            for row, found in batch_scores(batch["text"], model.value):
                part = batch.slice(row, len(found))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")


def batch_scores(column: pa.Array, model: dict):
    """Yield (first row, scores) of the texts of a column."""
    for row, counts in term_counts(column):
        yield row, vote(latent(counts, model["idf"], model["axes"]), model)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score_documents() would predict 1; no row moves."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def kept(batches):
        for batch in batches:
            scores = [found for _, found in batch_scores(batch["text"], model.value)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
