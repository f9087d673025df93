"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint has a row of Hamming distances to fixed reference fingerprints, the pivots. By the triangle
inequality two fingerprints within 3 bits differ by at most 3 in every coordinate of that table; pairs with a larger
coordinate difference are discarded, survivors are verified bit by bit.

Which pairs are held against the table at all: of six bands of bits, two fingerprints within 3 bits agree on three at
least. Fingerprints meet under each set of three bands (20 keys of some 32 bits), so none of the pairs is missed and no
table is compared with itself. Groups of one key's many members are linked as linking.py describes, by DataFrame
operations; a third of all rows may be copies of one text, which are one fingerprint.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, release
from .linking import linked_groups

MOST_BITS = 3
WIDTH = 3
SEED = 42
BANDS = 6
PIVOTS = 16
AT_ONCE = 1 << 16  # shingles whose bits are counted together

_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if it is in more than half of its shingles' XXH64 values."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    count = max(1, len(words) - width + 1)
    spans = zip(starts[:count].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist(), strict=True)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while some := list(itertools.islice(spans, AT_ONCE)):
        values = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce((2 * ones > count).astype(np.uint64) << _BITS))


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(text.as_py()) for text in batch["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.int64())], ["doc_id", "bits"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, the same everywhere: half of their bits are set on average."""
    return [_signed(int(x)) for x in mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def distance_table(bits: Column, references: list[int]) -> list[Column]:
    """The Hamming distances of ``bits`` to the references, eight to a bigint."""
    near = [F.bit_count(bits.bitwiseXOR(F.lit(p))).cast("long") for p in references]
    return [sum((F.shiftleft(d, 8 * k) for k, d in enumerate(near[at : at + 8])), F.lit(0).cast("long")) for at in range(0, len(near), 8)]


def within(x: Column, y: Column, places: int, bits: int = MOST_BITS) -> Column:
    """Whether two rows of the distance table differ by at most ``bits`` in every coordinate."""
    close = F.lit(True)
    for at in range(places):
        part = lambda row, at=at: F.shiftright(row[f"d{at // 8}"], 8 * (at % 8)).bitwiseAND(F.lit(255))
        close = close & (F.abs(part(x) - part(y)) <= bits)
    return close


def band_keys(bits: Column, bands: int = BANDS, most: int = MOST_BITS) -> Column:
    """Keys under which all fingerprints within ``most`` bits meet: each choice of ``bands`` - ``most`` bands."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    masks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    chosen = [sum(c) for c in itertools.combinations(masks, bands - most)]
    return F.array(*[F.xxhash64(F.lit(k), bits.bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(chosen)])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs of characters other than space and \\t..\\r, A-Z lower-cased; shingles are three words in a row joined
    by a space, repeats included, the whole sequence if there are fewer. Texts without words, null ones too, have
    fingerprint zero and link like any other. Fingerprints link at 3 or fewer differing bits; component_id is the smallest
    doc_id reachable, the row's own included. Rows with a null doc_id take part in the links but not in the choice of the
    smallest id (null if a component has no other); repeated doc_ids are separate rows. An empty table gives an empty
    result. Other columns play no part.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = materialize(texts.mapInArrow(_fingerprints, "doc_id long, bits long"))
    nodes = materialize(members.groupBy("bits").agg(F.min("doc_id").alias("smallest")))

    met = nodes.select(F.explode(band_keys(F.col("bits"))).alias("key"), F.col("bits").alias("node"))
    several = met.groupBy("key").count().where("count > 1").select("key")
    table = F.struct(*[c.alias(f"d{k}") for k, c in enumerate(distance_table(F.col("node"), pivots()))])
    keyed = materialize(met.join(several.hint("merge"), "key", "left_semi").withColumn("info", table))
    close = lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    groups = linked_groups(keyed, close, lambda x, y: within(x, y, PIVOTS), lambda x: F.lit(0.0))

    named = groups.select(F.col("node").alias("bits"), "group").join(nodes, "bits")
    lowest = named.groupBy("group").agg(F.min("smallest").alias("component_id"))
    known = materialize(nodes.join(named.join(lowest, "group").select("bits", "component_id"), "bits", "left").select("bits", F.coalesce("component_id", "smallest").alias("component_id")))
    release(keyed, nodes)
    return members.join(known, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
