"""N-gram Jaccard self-join by vertical partitioning.

N-grams stand in one global order, that of their 64-bit hashes, and the order is cut into fragments. The first fragment
of every set, its head, says which sets can have a partner at all. Of the sets left, each fragment counts the overlap
of a pair's n-grams that fall in it, apart from the others, and the partial counts are summed per pair.

Why no pair is missed. Let t = 3/4, |A| = n. A pair with Jaccard >= t shares at least t * max(|A|, |B|) n-grams. If A
shows its first n - ceil(t n) + l(n) n-grams in the order, with l(n) = 1 + 8 n div 100, then the two heads have at
least min(l(|A|), l(|B|)) n-grams in common, and so at least g = l(ceil(t n)) for either size. N-grams that only one
set shows can be forgotten; sets left with fewer than g drop out. Most documents do, those that only share a common
passage included.

Of the sets left, all n-grams are then asked, and again those of only one set are forgotten. Of the q n-grams that A
keeps, from rare to frequent, the first that it has in common with a partner has ceil(t n) - 1 common ones after it, so
it is among the first q - ceil(t n) + 1: these are A's keys. If a pair's first common n-gram has r and s kept n-grams
after it in the two sets, then the overlap is at most 1 + min(r, s): keys where that is too little for the two sizes
don't bring the pair together. N-grams that one set forgot are in no overlap, so only kept ones are counted.

N-grams move packed, many to a row: a task sorts those it has by the task that counts them.

Hashes: 64 bits of n-grams and of whole sets. A clash of two n-grams would have to fall in both sets of a pair on the
very edge of the threshold to matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, release, runs, shingle_sets
from .linking import linked_groups

NUMERATOR, DENOMINATOR = 75, 100
WIDTH = 5
FRAGMENT_BITS = 2
AT_ONCE = 500_000  # n-grams that a task deals out together
PER_TASK = 2_000_000  # n-grams that a task counts
SLICES = 8  # of a task's n-grams, sorted one after the other
WORD_BYTES = 6  # of text, for a guess at the number of n-grams

_LOAD = [("sets", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())]
_LOAD_SQL = "sets binary, sizes binary, counts binary, grams binary"


def _needed(n):
    return (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR


def _margin(n):
    return 1 + n * 8 // 100


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Dealer:
    """Gathers n-grams of sets and deals them out by the task that counts them."""

    def __init__(self, parts: int):
        self.parts, self.sets, self.sizes, self.held, self.size = parts, [], [], [], 0

    def add(self, name: int, n: int, grams: np.ndarray) -> bool:
        """Whether it is time to deal."""
        self.sets.append(name)
        self.sizes.append(n)
        self.held.append(grams)
        self.size += len(grams)
        return self.size >= AT_ONCE

    def deal(self):
        """(place, sets, sizes, counts, grams): grams in runs by set, as many as counts says."""
        if not self.held:
            return
        sets, sizes = np.array(self.sets, np.int64), np.array(self.sizes, np.int32)
        grams, owner = np.concatenate(self.held), np.repeat(np.arange(len(sets)), [len(x) for x in self.held])
        place = (mix64(grams) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        grams, owner, place = grams[order], owner[order], place[order]
        cuts = np.searchsorted(place, np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            at = slice(cuts[p], cuts[p + 1])
            own = owner[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(first, len(own))).astype(np.int32)
            yield p, sets[own[first]].tobytes(), sizes[own[first]].tobytes(), counts.tobytes(), grams[at].tobytes()
        self.sets, self.sizes, self.held, self.size = [], [], [], 0


def _members(parts: int):
    """Every row's doc_id, row_key, set_id and n, and the heads of the sets, each once in a task, dealt out by n-gram."""
    schema = pa.schema([("place", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), *_LOAD])

    def loads(dealer: _Dealer):
        found = [(p, None, None, None, None, *load) for p, *load in dealer.deal()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        dealer, seen = _Dealer(parts), set()
        for batch in batches:
            n, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, hashes in shingle_sets(batch["text"], WIDTH):
                n[row], ids[row] = len(hashes), _set_id(hashes)
                if len(hashes) and ids[row] not in seen:
                    seen.add(int(ids[row]))
                    if dealer.add(int(ids[row]), len(hashes), hashes[: len(hashes) - _needed(len(hashes)) + _margin(len(hashes))]):
                        yield from loads(dealer)
            places = (batch["row_key"].to_numpy().view(np.uint64) % np.uint64(parts)).astype(np.int32)
            empty = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(places), batch["doc_id"], batch["row_key"], pa.array(ids), pa.array(n), empty, empty, empty, empty], schema=schema)
        yield from loads(dealer)

    return run


def _shared(batches: list[pa.RecordBatch]):
    """(gram, number of its sets, set's place) of the n-grams that several sets have; sets; sizes. Empties ``batches``.

    SLICES of the n-grams are sorted one after the other, so that a task's memory is little more than its n-grams.
    """
    named, sizes, counts, grams = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for batch in batches for x in batch[c]]) for c, kind in (("sets", np.int64), ("sizes", np.int32), ("counts", np.int32), ("grams", np.uint64)))
    batches.clear()
    sets, first, place = np.unique(named, return_index=True, return_inverse=True)
    sizes, owner = sizes[first], np.repeat(place.astype(np.int32), counts)
    found = []
    for k in range(SLICES):
        at = np.flatnonzero(grams % np.uint64(SLICES) == k)
        if len(at):
            found.append(_shared_slice(grams[at], owner[at]))
    return *(np.concatenate([f[i] for f in found]) for i in range(3)), sets, sizes


def _shared_slice(grams: np.ndarray, owner: np.ndarray):
    order = np.argsort(grams)
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    length = np.diff(np.append(first, len(grams)))
    kept = np.repeat(several, length)
    number, values, owner = np.repeat(np.cumsum(several, dtype=np.int32) - 1, length)[kept], grams[kept], owner[kept]
    # a set that several tasks dealt out counts once
    order = np.lexsort((owner, number))
    number, values, owner = number[order], values[order], owner[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    number, values, owner = number[new], values[new], owner[new]
    return values, np.bincount(number, minlength=1)[number].astype(np.int32), owner


def _head_counts(batches):
    """The rows of members as they are; of each set, how many n-grams of its head in this task several sets have."""
    loads = []
    for batch in batches:
        rows = batch.filter(batch["grams"].is_null())
        if rows.num_rows:
            yield rows.select(["doc_id", "row_key", "set_id", "n"]).append_column("q", pa.nulls(rows.num_rows, pa.int64()))
        some = batch.filter(batch["grams"].is_valid())
        loads += [some] if some.num_rows else []
    if loads:
        _, _, owner, sets, sizes = _shared(loads)
        q = np.bincount(owner, minlength=len(sets))
        some = np.flatnonzero(q)
        empty = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, pa.array(sets[some]), pa.array(sizes[some].astype(np.int64)), pa.array(q[some])], ["doc_id", "row_key", "set_id", "n", "q"])


def _deal_all(parts: int):
    """All n-grams of texts, dealt out by n-gram."""
    schema = pa.schema([("place", pa.int32()), *_LOAD])

    def loads(dealer: _Dealer):
        found = list(dealer.deal())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        dealer = _Dealer(parts)
        for batch in batches:
            for _, hashes in shingle_sets(batch["text"], WIDTH):
                if len(hashes) and dealer.add(_set_id(hashes), len(hashes), hashes):
                    yield from loads(dealer)
        yield from loads(dealer)

    return run


def _kept_grams(batches):
    """(set_id, n, grams, often): the n-grams of a set in this task that several sets have, and how many have them."""
    loads = [batch for batch in batches if batch.num_rows]
    if not loads:
        return
    grams, often, owner, sets, sizes = _shared(loads)
    order = np.argsort(owner, kind="stable")
    grams, often, owner = grams[order], often[order], owner[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    for at in range(0, len(first), 5000):
        begin = first[at : at + 5000]
        end = np.append(first[at + 1 : at + 5000], first[at + 5000] if at + 5000 < len(first) else len(owner))
        own = owner[begin]
        packed = [[v[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True)] for v in (grams, often)]
        yield pa.RecordBatch.from_arrays([pa.array(sets[own]), pa.array(sizes[own].astype(np.int64)), *[pa.array(x, pa.binary()) for x in packed]], ["set_id", "n", "grams", "often"])


_KEYED = pa.schema([("set_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("after", pa.int64()), ("q", pa.int64()), ("fragment", pa.int32()), ("grams", pa.binary())])


def _prefixes(batches):
    """From the parts of each set, in order of set_id: its keys, and its kept n-grams by fragment."""
    edges = np.arange(1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS)
    for batch in runs(batches, "set_id"):
        ids, n = batch["set_id"].to_numpy(), batch["n"].to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        parts = [[np.frombuffer(x, kind) for x in batch[c].to_pylist()] for c, kind in (("grams", np.uint64), ("often", np.int32))]
        keys, segments = [], []
        for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
            grams, often = (np.concatenate(p[begin:end]) for p in parts)
            size, q = int(n[begin]), len(grams)
            if q < _needed(size):
                continue
            order = np.lexsort((grams, often))[: q - _needed(size) + 1]
            keys.append((ids[begin], size, grams[order].view(np.int64), q - 1 - np.arange(len(order)), q))
            grams = np.sort(grams)
            cuts = [0, *np.searchsorted(grams, edges).tolist(), q]
            segments += [(ids[begin], size, None, None, None, f, grams[cuts[f] : cuts[f + 1]].tobytes()) for f in range(1 << FRAGMENT_BITS)]
        if not keys:
            continue
        lengths = [len(k[2]) for k in keys]
        columns = [np.repeat([k[i] for k in keys], lengths) if i in (0, 1, 4) else np.concatenate([k[i] for k in keys]) for i in range(5)]
        empty = sum(lengths)
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.nulls(empty, pa.int32()), pa.nulls(empty, pa.binary())], schema=_KEYED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*segments, strict=True), _KEYED, strict=True)], schema=_KEYED)


def _partial_overlaps(batches):
    """(a, b, na, nb, partial) of rows that hold one fragment of two sets."""
    for batch in batches:
        pairs = zip(batch["ga"].to_pylist(), batch["gb"].to_pylist(), strict=True)
        partial = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in pairs]
        yield batch.select(["a", "b", "na", "nb"]).append_column("partial", pa.array(partial, pa.int64()))


def similar_sets(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose partial overlaps, counted per fragment and summed, reach the threshold."""
    left = segments.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("fragment").alias("f2"), F.col("grams").alias("gb"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").where("fragment = f2")
    partial = both.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_partial_overlaps, "a long, b long, na long, nb long, partial long")
    reached = f"{DENOMINATOR} * overlap >= {NUMERATOR} * (na + nb - overlap)"
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap")).where(reached).select("a", "b")


def _fits(x, y):
    """Whether sets of these sizes can link if they have no n-gram in common before the key, and ``after`` ones after it."""
    most = 1 + F.least(x["after"], y["after"])
    return DENOMINATOR * most >= NUMERATOR * (x["n"] + y["n"] - most)


def _tasks(spark, grams: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-grams // PER_TASK))


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of characters other than space and \\t..\\r, A-Z lower-cased. A text's set holds its distinct
    5-word shingles, the whole sequence if it has fewer words, nothing if it has none (or is null); empty sets are
    linked with nothing. Two rows link at Jaccard >= 0.75; component_id is the smallest doc_id reachable by links, the
    row's own included. Rows of equal sets are one node, so copies are never paired. Rows with a null doc_id take part
    in the links but not in the choice of the smallest id; repeated doc_ids are separate rows. Other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _tasks(spark, size // WORD_BYTES // 3)
    dealt = texts.mapInArrow(_members(parts), f"place int, doc_id long, row_key long, set_id long, n long, {_LOAD_SQL}").repartitionById(parts, "place")
    first = materialize(dealt.mapInArrow(_head_counts, "doc_id long, row_key long, set_id long, n long, q long"))

    members = first.where("q is null")
    sets = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("row_key"))
    heads = first.where("q is not null").groupBy("set_id", "n").agg(F.sum("q").alias("q"))
    needed = f"({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR}"
    left = materialize(heads.where(f"q >= 1 + ({needed}) * 8 div 100").join(sets, "set_id").select("row_key", "n"))

    # all n-grams of the sets left: at least 3/4 of them must be another set's too
    parts = _tasks(spark, left.agg(F.sum("n")).first()[0] or 0)
    asked = texts.join(left.select("row_key").hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("text")
    counted = asked.mapInArrow(_deal_all(parts), f"place int, {_LOAD_SQL}").repartitionById(parts, "place").mapInArrow(_kept_grams, "set_id long, n long, grams binary, often binary")
    kept = materialize(counted.repartition("set_id").sortWithinPartitions("set_id").mapInArrow(_prefixes, "set_id long, n long, key long, after long, q long, fragment int, grams binary"))
    segments = kept.where("key is null").select("set_id", "n", "fragment", "grams")
    keyed = kept.where("key is not null").select("key", F.col("set_id").alias("node"), F.struct("n", "after", "q").alias("info"))
    groups = linked_groups(keyed, lambda pairs: similar_sets(pairs, segments), _fits, lambda x: x["q"] / x["n"])

    named = groups.select(F.col("node").alias("set_id"), "group").join(sets, "set_id")
    smallest = named.groupBy("group").agg(F.min("smallest").alias("component_id"))
    linked = named.join(smallest, "group").select("set_id", "component_id")
    copied = sets.where("copies > 1").join(linked, "set_id", "left_anti").select("set_id", F.col("smallest").alias("component_id"))
    known = materialize(linked.unionByName(copied))
    release(kept, left)
    out = members.join(known, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
