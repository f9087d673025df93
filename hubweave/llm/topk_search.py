"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Components are integers, floor(256 x). The index holds blocks of vectors; in a block the postings (vector, component) of
each dimension are cut into segments by quantised impact, the octave of their magnitude below the block's largest. For
a block of queries the segments are processed in descending impact, each adding to the scores of its own vectors only.
After each impact, what the segments left over can still add to a score is bounded by Cauchy-Schwarz; vectors whose
bound stays below the k-th best proven score of every query take no further part, and once few enough possible members
are left, these are rescored exactly. A segment is skipped only on that proof.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
PER_SLOT = 8  # blocks of rows that meet the queries in one task
IMPACTS = 8  # segments of a dimension by magnitude: [top/2, top], [top/4, top/2) ... and the rest
EXACT = 2.0**62  # scores below it are sums of 64-bit products


def _floored(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) / SCALE, which a double holds exactly; components of 2^53 or more are whole already and stay."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) < 2.0**53, np.floor(x * SCALE) / SCALE, x)


def _whole(x: float) -> int:
    """SCALE times a floored component, beyond what a double can hold too."""
    return int(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE


def _packed(rows: int):
    """Packs (vec_id, values) into blocks (dims, ids, block) of ``rows`` rows of one dimension."""

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids, lists = batch["vec_id"].to_numpy(), batch["values"]
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                a, b = held.setdefault(dims, ([], []))
                a.append(ids[own])
                b.append(_floored(np.stack([flat[ends[i] - dims : ends[i]] for i in own.tolist()])))
                if sum(map(len, a)) >= rows:
                    yield from _blocks(*held.pop(dims), dims, rows)
        for dims, (a, b) in held.items():
            yield from _blocks(a, b, dims, rows)

    return pack


def _blocks(ids, values, dims, rows):
    ids, values = np.concatenate(ids), np.concatenate(values)
    for i in range(0, len(ids), rows):
        yield pa.RecordBatch.from_pylist([{"dims": dims, "ids": ids[i : i + rows].tobytes(), "block": values[i : i + rows].tobytes()}], pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("block", pa.binary())]))


def _index(batches):
    """Adds a block's postings: rows in order of (impact, dimension, row), and where each of these segments ends."""
    for batch in batches:
        for row in batch.to_pylist():
            values = np.abs(np.frombuffer(row["block"], np.float64).reshape(len(row["ids"]) // 8, row["dims"]))
            top = max(1.0, values.max(initial=0.0))
            with np.errstate(divide="ignore"):
                impact = np.clip(np.floor(np.log2(top) - np.log2(values)), 0, IMPACTS - 1).astype(np.int64)
            there = values.T > 0
            dim, at = np.nonzero(there)
            segment = impact.T[there] * row["dims"] + dim
            order = np.argsort(segment, kind="stable")
            ends = np.searchsorted(segment[order], np.arange(IMPACTS * row["dims"]), "right")
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row["dims"], pa.int32()), (row["ids"], pa.binary()), (row["block"], pa.binary()), (at[order].astype(np.uint16).tobytes(), pa.binary()), (ends.astype(np.int32).tobytes(), pa.binary()))], ["dims", "ids", "block", "postings", "ends"])


def _exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, SCALE times each component: with 64 bits, or where that is too little with Python's integers."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * SCALE * (np.abs(v).max(initial=0) * SCALE) * max(1, q.shape[1])
    if not len(q) or most < EXACT:
        return np.einsum("ij,ij->i", (q * SCALE).astype(np.int64), (v * SCALE).astype(np.int64))
    exact = (sum(_whole(a) * _whole(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True))
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, postings: np.ndarray, ends: np.ndarray, k: int):
    """(query row, vec_id, score) of each query's k best in one block, by (score desc, vec_id); its own id's rows left out."""
    dims = q.shape[1]
    own = ids[:, None] == q_ids[None, :]
    member, k = ~own, min(k, len(ids))
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        left = (v * v).sum(1)  # squared norm of what a vector's unseen segments hold
        bounded = np.isfinite(q_norm).all() and np.isfinite(v_norm).all()
    score = np.zeros((len(ids), len(q)))
    active = np.ones(len(ids), bool)
    begin = 0
    for impact in range(IMPACTS if bounded else 0):
        for dim in range(dims):
            end = int(ends[impact * dims + dim])
            rows = postings[begin:end]
            rows, begin = rows[active[rows]], end
            score[rows] += v[rows, dim, None] * q[None, :, dim]
            left[rows] -= v[rows, dim] ** 2
        slack = (np.sqrt(np.maximum(left, 0)) + 1e-9 * v_norm)[:, None] * q_norm[None, :] + 1e-11
        proven = np.where(own | ~active[:, None], -np.inf, score - slack)
        kth = np.partition(proven, len(ids) - k, axis=0)[len(ids) - k]
        member &= score + slack >= kth[None, :]
        active = member.any(1)
        if member.sum() <= 4 * k * len(q):
            break
    cols, rows = np.nonzero(member.T)
    exact = _exact_scores(q[cols], v[rows])
    order = np.lexsort((ids[rows], ~exact, cols))
    cols, rows, exact = cols[order], rows[order], exact[order]
    kept = np.arange(len(cols)) - np.searchsorted(cols, cols) < k
    return cols[kept], ids[rows[kept]], exact[kept]


def _search(k: int):
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dims = row["dims"]
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, v = (np.frombuffer(row[x], np.float64).reshape(n, dims) for x, n in (("queries", len(q_ids)), ("block", len(ids))))
                at, found, scores = _best(q_ids, q, ids, v, np.frombuffer(row["postings"], np.uint16), np.frombuffer(row["ends"], np.int32), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["query_block"])), pa.array(at), pa.array(q_ids[at]), pa.array(found), pa.array(scores)], ["query_block", "at", "query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its k rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; with fewer candidates, all of them.
    Candidates are all rows but those of the query's own id; of rows that repeat an id each is a query and a candidate
    of its own. Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
    only vectors of equal length are compared; an empty vector scores 0 against other empty ones. Components and scores
    are exact at any magnitude; a score that 64 bits can't hold is their nearest bound. An empty table
    gives an empty result. Other columns play no part.

    Both the rows and the queries are packed into blocks of bounded size, and each block of rows meets each block of
    queries; per pair of blocks only k rows a query leave. The queries are copied once for every PER_SLOT blocks of rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & finite).select("vec_id", F.col("x").alias("values"))
    shape = "dims int, ids binary, block binary"
    index = materialize(whole.mapInArrow(_packed(BLOCK_ROWS), shape).mapInArrow(_index, f"{shape}, postings binary, ends binary"))
    slots = -(-index.count() // PER_SLOT) or 1
    queries = whole.where(F.col("vec_id") % every == 0)
    parts = -(-queries.count() // QUERY_ROWS) or 1
    asked = queries.repartition(parts, "vec_id").mapInArrow(_packed(QUERY_ROWS), shape).toDF("dims", "q_ids", "queries")
    asked = materialize(asked.withColumn("query_block", F.monotonically_increasing_id()))
    placed = index.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    copied = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = placed.join(copied.hint("merge"), ["slot", "dims"]).mapInArrow(_search(k), "query_block long, at long, query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_block", "at").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(by_query).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
