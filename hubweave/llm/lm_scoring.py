"""Language-model scoring by cross-entropy difference.

Two bigram models over all words of all documents share one smoothing: the background model counts every document, the
target model the documents labelled good. Each token's loss under either model is subtracted, and a document's score is
the mean difference: below 0, it reads more like the target.

    p(w | h) = (n(h, w) + STRENGTH p(w)) / (n(h) + STRENGTH),  p(w) = (n(w) + 1) / (N + V + 1)

Words and bigrams are known by 64-bit hashes and counted without a limit. Tokens move once, to the task of their word,
where its count and those of its bigrams are complete; the loss is a sum of logarithms, so each task adds up its share
of every document. Words so frequent that one task would feel them are counted before, and so are the frequent bigrams
of two such words: those tokens don't move. At most MOST words and MOST bigrams can be that frequent, whatever the size of
the table. After a rare word, such a word's token moves by that word; after another frequent word, it is dealt by that
word to as many tasks as its own count asks for.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, string_parts, word_hashes, word_spans

HOT = 4  # words with more than 1 in HOT of a task's tokens are counted before, if they are more than 1 in MOST of all
MOST = 1 << 18
PARTS = 32
PER_TASK = 4_000_000  # tokens
AT_ONCE = 2_000_000  # tokens that are dealt out together
SLICES = 8  # of a task's words, one after the other
STRENGTH = 20.0
OTHER, BEGIN, AFTER = 0, 1, 2  # the word and the one before it; the first word of a text; the word and a frequent one after it
KIND, TARGET, FOLLOWED = 3, 4, 8


def _packed(batches):
    """Texts compressed one by one, with their sizes in bytes: what the join with the labels moves and the written table holds."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = [x.as_buffer() if x.is_valid else None for x in batch["text"]]
        packed = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([None if x is None else x.size for x in texts], pa.int64()), packed], ["doc_id", "size", "packed"])


def _unpacked(batches):
    """The rows of _packed() with their texts again, a few megabytes at a time."""
    codec = pa.Codec("zstd", compression_level=1)

    def given(batch, first: int, texts: list):
        part = batch.slice(first, len(texts))
        return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.binary()).view(pa.string()), part["target"]], ["doc_id", "text", "target"])

    for batch in batches:
        texts: list = []
        first = held = 0
        for size, load in zip(batch["size"].to_pylist(), batch["packed"], strict=True):
            texts.append(codec.decompress(load.as_buffer(), size, asbytes=True) if load.is_valid else None)
            held += size or 0
            if held > 4 << 20:
                yield given(batch, first, texts)
                first, held, texts = first + len(texts), 0, []
        if texts:
            yield given(batch, first, texts)


def _read(batch):
    """(first row, words, whether a word begins its text, its row in the part, each row's first word) of a batch's parts."""
    for row, offsets, data in string_parts(batch["text"]):
        starts, ends, first = word_spans(offsets, data)
        words = word_hashes(data, starts, ends)
        begins = np.zeros(len(words), bool)
        begins[first[:-1][first[:-1] < first[1:]]] = True
        yield row, words, begins, np.repeat(np.arange(len(first) - 1), np.diff(first)), first


def _flags(batch, row: int, count: int) -> np.ndarray:
    return batch["target"].slice(row, count).to_numpy(zero_copy_only=False)


def _summed(held):
    keys, at = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
    n, m = (np.bincount(at, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(m)], ["key", "n", "m"])


def _counts(keys_of):
    """(key, n, m) of a partition: occurrences in all texts and in the target's, given out whenever many have come together."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for row, words, begins, rows, first in _read(batch):
                keys, at = keys_of(words, begins)
                distinct, inverse = np.unique(keys, return_inverse=True)
                good = _flags(batch, row, len(first) - 1)[rows[at]]
                held.append((distinct, np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse, good, len(distinct))))
                size += len(distinct)
                if size > 2_000_000:
                    yield _summed(held)
                    held, size = [], 0
        if held:
            yield _summed(held)

    return count


def _every_word(words, begins):
    return words, np.arange(len(words))


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted keys, -1 for one that isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _before(words: np.ndarray) -> np.ndarray:
    return np.append(words[:1], words[:-1])


def _hot_pairs(hot):
    def keys_of(words, begins):
        known = _find(hot.value[0], words) >= 0
        at = np.flatnonzero(known & np.append(False, known[:-1]) & ~begins) if len(words) else np.zeros(0, np.int64)
        return _pair(words[at - 1], words[at]), at

    return keys_of


def _sorted_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and, for background and target, their counts."""
    kept = counts.toPandas()
    keys = kept["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], kept[["n", "m"]].to_numpy(np.float64)[order].T


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _moves(hot, pairs, sums: tuple, labels: list[int], share: int):
    """(part, load): tokens by the word that counts them, and for each run of rows their ids, sizes and the losses known here."""

    parts = len(labels)

    def deal(rows: list, tokens: list, base: int):
        ids = pa.chunked_array([r[0] for r in rows]).combine_chunks()
        yield labels[(base + (base >> 20)) % parts], pickle.dumps((base, None, ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.to_pylist(), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows], axis=1)), 5)
        word, other, at, what = (np.concatenate([t[i] for t in tokens]) for i in range(4))
        known = _find(hot.value[0], word)
        # as many salts as a frequent word's tokens fill shares of a task; other words have one
        salts = np.where(known >= 0, 1 + hot.value[1][0][known] * share // max(1, sums[0]), 1).astype(np.uint64) if len(hot.value[0]) else np.uint64(1)
        part = mix64(word + mix64(other) % salts) % np.uint64(parts)
        order = np.lexsort((word, part))
        word, other, at, what, part = word[order], other[order], at[order], what[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            cut = slice(cuts[p], cuts[p + 1])
            if cuts[p] < cuts[p + 1]:
                distinct, runs = np.unique(word[cut], return_counts=True)
                others, places = np.unique(other[cut], return_inverse=True)
                yield labels[p], pickle.dumps((base, distinct, _narrow(runs), others, _narrow(places), _narrow(at[cut]), what[cut]), 5)

    def moves(batches):
        task, turn = TaskContext.get().partitionId(), 0
        rows: list = []
        tokens: list = []
        size = done = 0
        for batch in batches:
            for row, words, begins, owner, first in _read(batch):
                count = len(first) - 1
                losses = np.zeros((2, count))
                if len(words):
                    good = _flags(batch, row, count)[owner]
                    before = _before(words)
                    now = _find(hot.value[0], words)
                    then = np.where(begins, -1, np.append(-1, now[:-1]))
                    both = np.flatnonzero((now >= 0) & (then >= 0))
                    seen = _find(pairs.value[0], _pair(before[both], words[both]))
                    both, seen = both[seen >= 0], seen[seen >= 0]
                    opening = np.flatnonzero((now >= 0) & begins)
                    after = np.flatnonzero(then >= 0)
                    for k in range(2):
                        n = hot.value[1][k]
                        p = (n + 1) / sums[k]
                        losses[k] += np.bincount(owner[after], np.log2(n + STRENGTH)[then[after]], count)
                        losses[k] -= np.bincount(owner[both], np.log2(pairs.value[1][k][seen] + STRENGTH * p[now[both]]), count)
                        losses[k] -= np.bincount(owner[opening], np.log2(p[now[opening]]), count)
                    # a frequent word says here what it adds as a history
                    followed = np.append(~begins[1:], False) & (now < 0)
                    settled = np.zeros(len(words), bool)
                    settled[both] = settled[opening] = True
                    late = np.flatnonzero((now >= 0) & (then < 0) & ~begins)
                    settled[late] = True
                    own = np.flatnonzero(~settled)
                    what = (TARGET * good + FOLLOWED * followed + BEGIN * begins).astype(np.uint8)
                    tokens.append((before[late], words[late], done + owner[late], what[late] + np.uint8(AFTER)))
                    tokens.append((words[own], np.where(begins[own], np.uint64(0), before[own]), done + owner[own], what[own]))
                    size += len(own) + len(late)
                rows.append((batch["doc_id"].slice(row, count), np.diff(first), losses))
                done += count
                if size > AT_ONCE:
                    yield from _loads(deal(rows, tokens, (task << 20) + turn), "part")
                    rows, tokens, size, done, turn = [], [], 0, 0, turn + 1
        if rows:
            tokens.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)))
            yield from _loads(deal(rows, tokens, (task << 20) + turn), "part")

    return moves


def _loads(found, name: str):
    for key, load in found:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([load], pa.binary())], [name, "load"])


def _token_losses(word, other, what, hot, sums: tuple) -> list[np.ndarray]:
    """Of each token of whole words, its part of the loss under background and target.

    A word's own tokens (OTHER, BEGIN) tell its count, but for a frequent word's, which were counted before. A word gives
    what it adds as a history if one follows.
    """
    kind, target = what & KIND, (what & TARGET) > 0
    distinct, at = np.unique(word, return_inverse=True)
    bigrams, pair = np.unique(mix64(_pair(other, word) + kind.astype(np.uint64)), return_inverse=True)
    own = kind != AFTER
    known, later = _find(hot[0], distinct), _find(hot[0], other)
    out = []
    for k in range(2):
        weight = target.astype(float) if k else np.ones(len(word))
        n = np.bincount(at, weight * own, len(distinct))
        if len(hot[0]):
            n = np.where(known >= 0, hot[1][k][known], n)[at]
            n = np.where(own, n, hot[1][k][later])
        else:
            n = n[at]
        p = (n + 1) / sums[k]
        both = np.bincount(pair, weight, len(bigrams))[pair]
        loss = -np.log2(np.where(kind == BEGIN, p, both + STRENGTH * p))
        out.append(loss + np.where((what & FOLLOWED) > 0, np.log2(n + STRENGTH), 0))
    return out


def _part_losses(hot, sums: tuple):
    """(base, load) of a partition: for each run of rows, what its tokens add to each row's losses."""

    def add(batches):
        loads, rows = [], []
        for batch in batches:
            for load in batch["load"]:
                found = pickle.loads(load.as_buffer())
                (rows if found[1] is None else loads).append(found)
        yield from _loads(((r[0], pickle.dumps(r, 5)) for r in rows), "base")
        added: dict[int, np.ndarray] = {}
        for base, *_, owner, _ in loads:
            have, most = added.get(base), int(owner.max()) + 1
            if have is None or have.shape[1] < most:
                added[base] = np.zeros((2, most))
        edges = np.arange(1, SLICES, dtype=np.uint64) << np.uint64(64 - SLICES.bit_length() + 1)
        places = []  # where the words and the tokens of each slice begin in each load
        for load in loads:
            words = np.concatenate([[0], np.searchsorted(load[1], edges), [len(load[1])]])
            places.append((words, np.append(0, np.cumsum(load[2], dtype=np.int64))[words]))
        for k in range(SLICES if loads else 0):
            cuts = [(slice(w[k], w[k + 1]), slice(t[k], t[k + 1])) for w, t in places]
            word = np.concatenate([np.repeat(x[1][w], x[2][w]) for x, (w, _) in zip(loads, cuts, strict=True)])
            other = np.concatenate([x[3][x[4][t]] for x, (_, t) in zip(loads, cuts, strict=True)])
            what = np.concatenate([x[6][t] for x, (_, t) in zip(loads, cuts, strict=True)])
            losses = _token_losses(word, other, what, hot.value, sums)
            at = 0
            for load, (_, t) in zip(loads, cuts, strict=True):
                sums_of, owner = added[load[0]], load[5][t]
                for m in range(2):
                    sums_of[m] += np.bincount(owner, losses[m][at : at + len(owner)], sums_of.shape[1])
                at += len(owner)
        yield from _loads(((base, pickle.dumps((base, "part", found), 5)) for base, found in added.items()), "base")

    return add


def _scores(batches):
    """The rows of each run, with all parts of their losses added."""
    rows: dict[int, tuple] = {}
    parts: dict[int, list] = {}
    for batch in batches:
        for load in batch["load"]:
            base, kind, *found = pickle.loads(load.as_buffer())
            if kind is None:
                rows[base] = found
            else:
                parts.setdefault(base, []).append(found[0])
    for base, (ids, n, losses) in rows.items():
        for added in sorted(parts.pop(base, []), key=lambda x: x.tobytes()):
            losses[:, : added.shape[1]] += added
        background, target = losses / np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])


def score_documents(docs: DataFrame, labels: DataFrame, hot: int = HOT, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, loss_target, loss_background, score (mean bits a token).

    The target is every row of ``docs`` whose doc_id some row of ``labels`` gives quality 1. Words are runs of
    characters other than space and \\t..\\r, A-Z lower-cased. Texts without words (null and empty ones too) have losses
    and score 0. Without a target, its model is the smoothing alone. A null doc_id can't be a target. Other columns play
    no part.

    The tokens are dealt to ``parts`` tasks, more for large tables. ``hot`` (0: none) says which words are counted
    before, ``most`` bounds their number and that of their bigrams; none of these changes the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    packed, unnamed = (rows.where(f"doc_id is {what}").mapInArrow(_packed, "doc_id long, size long, packed binary") for what in ("not null", "null"))
    named = packed.join(good.hint("merge"), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    flagged = materialize(named.unionByName(unnamed.withColumn("target", F.lit(False))))

    def over_texts(run):
        return lambda batches: run(_unpacked(batches))

    def count(keys_of) -> DataFrame:
        return flagged.mapInArrow(over_texts(_counts(keys_of)), "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    words = materialize(count(_every_word))
    total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    sums = (total[1] + total[0] + 1, total[2] + total[0] + 1)
    parts = max(parts, total[1] // PER_TASK)
    # labels that are dealt to different partitions
    places = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("place")).agg(F.min("id").alias("id"))
    dealt = [r["id"] for r in places.collect()]
    # fewer than `most` words can be more than 1 in `most` of all tokens, and fewer than `most` bigrams
    frequent = spark.sparkContext.broadcast(_sorted_counts(words.where(F.col("n") * min(hot * parts, most) > total[1])))
    pairs = spark.sparkContext.broadcast(_sorted_counts(count(_hot_pairs(frequent)).where(F.col("n") * most > total[1])))

    moved = flagged.mapInArrow(over_texts(_moves(frequent, pairs, sums, dealt, hot * parts)), "part long, load binary").repartition(parts, "part")
    added = moved.mapInArrow(_part_losses(frequent, sums), "base long, load binary").repartition(parts, "base")
    return added.mapInArrow(_scores, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
