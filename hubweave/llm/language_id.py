"""Language identification by prediction by partial matching.

Each language has a context tree of bytes with up to ORDER bytes of context and escape probabilities of method C
(symbols seen: count / (n + d), escape: d / (n + d), then the next shorter context; at last 1/256). The statistics are
frozen after training, so the cost of every symbol in every context is fixed: the trees are compiled into tables of code
lengths, one per length of context, with a value per language for each symbol that some language has seen in a context.
The exact code length of a text under a language is a sum of looked-up values. Nothing that the sample holds is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, first_rows, string_parts

ORDER = 3
SAMPLE_PER_LANGUAGE = 400  # bound of the fit: training documents per language
DENSE_CELLS = 1 << 24  # a larger table of contexts and symbols is searched, not looked up
UNKNOWN = "und"


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _codes(offsets: np.ndarray, data: np.ndarray, symbol: np.ndarray):
    """For each byte: its symbol and those of the three bytes before it in the text (0 before the start)."""
    now = symbol[_LOWER[data]]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = []
    for k in (1, 2, 3):
        back = np.zeros_like(now)
        back[k:] = now[:-k] if k <= len(now) else 0
        back[place < k] = 0
        before.append(back)
    return now, before


def _grams(batches):
    """(lang, gram, n): how often each byte follows each three bytes, per language and partition."""
    counts: dict[str, dict[int, int]] = {}
    same = np.arange(256, dtype=np.int64)
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for row, offsets, data in string_parts(batch["text"]):
            now, (b1, b2, b3) = _codes(offsets, data, same)
            grams = ((b3 << 24) | (b2 << 16) | (b1 << 8)) | now
            for i in range(len(offsets) - 1):
                own = counts.setdefault(langs[row + i], {})
                for g, n in zip(*(x.tolist() for x in np.unique(grams[offsets[i] : offsets[i + 1]], return_counts=True)), strict=True):
                    own[g] = own.get(g, 0) + n
    for lang, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame) -> dict:
    """The compiled model from at most SAMPLE_PER_LANGUAGE documents of each language, first by a digest of the id."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", key.alias("key"))
    chosen = first_rows(ids, "lang", ["key", "doc_id"], SAMPLE_PER_LANGUAGE).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    texts = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sample = texts.join(F.broadcast(chosen), (texts["doc_id"] == chosen["chosen_id"]) & (texts["lang"] == chosen["chosen_lang"]))
    grams = sample.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(_grams, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return compile_trees(grams.toPandas())


def compile_trees(grams: pd.DataFrame) -> dict:
    """{languages, symbol, contexts, costs}: the code length of each symbol in each context node, per language."""
    langs = sorted(grams["lang"].unique())
    if not langs:
        return {"languages": []}
    g = grams["gram"].to_numpy(np.int64)
    parts = [(g >> s) & 255 for s in (24, 16, 8, 0)]
    used = np.unique(np.concatenate([[0], *parts]))
    symbol = np.zeros(256, np.int64)  # 0: start of text, and all bytes that training never saw
    symbol[used[used > 0]] = np.arange(1, (used > 0).sum() + 1)
    width = int(symbol.max()) + 1
    a, b, c, s = (symbol[p] for p in parts)
    n = grams["n"].to_numpy(np.float64)
    of_lang = grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    contexts = [np.zeros_like(c), c, b * width + c, (a * width + b) * width + c]

    orders: list[dict] = []
    for k in range(ORDER + 1):
        cells, cell = np.unique(contexts[k] * width + s, return_inverse=True)
        nodes, node = np.unique(cells // width, return_inverse=True)
        costs, escapes = np.empty((len(langs), len(cells)), np.float32), np.zeros((len(langs), len(nodes)), np.float32)
        shorter = _find(orders[k - 1]["cells"], (cells // width) % width ** (k - 1) * width + cells % width) if k else None
        for i in range(len(langs)):
            own = of_lang == i
            count = np.bincount(cell[own], n[own], len(cells))
            total, seen = np.bincount(node, count, len(nodes)), np.bincount(node, count > 0, len(nodes))
            known = seen > 0
            escapes[i, known] = np.log2((total[known] + seen[known]) / seen[known])
            with np.errstate(divide="ignore"):
                coded = np.log2((total[node] + seen[node]) / np.maximum(count, 1e-300))
            costs[i] = np.where(count > 0, coded, escapes[i, node] + (orders[k - 1]["costs"][i, shorter] if k else 8.0))
        orders.append({"cells": cells, "nodes": nodes, "costs": costs, "escapes": escapes})
    return {"languages": langs, "symbol": symbol, "width": width, "orders": orders}


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted keys, -1 for one that isn't there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Lookup:
    """Where contexts and symbols stand in the tables of a model: by a dense table where that is small, else by search."""

    def __init__(self, model: dict):
        self.width, self.tables = model["width"], []
        for k, order in enumerate(model["orders"]):
            dense = None
            if self.width ** min(k, 3) <= DENSE_CELLS and len(order["nodes"]) * self.width <= DENSE_CELLS:
                place = np.full(self.width**k, len(order["nodes"]), np.int32)
                place[order["nodes"]] = np.arange(len(order["nodes"]))
                rows = np.full((len(order["nodes"]) + 1) * self.width, -1, np.int32)
                rows[place[order["cells"] // self.width].astype(np.int64) * self.width + order["cells"] % self.width] = np.arange(len(order["cells"]))
                dense = place, rows
            self.tables.append((dense, order))

    def cell(self, k: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        dense, order = self.tables[k]
        if dense is None:
            return _find(order["cells"], context * self.width + symbol)
        return dense[1][dense[0][context].astype(np.int64) * self.width + symbol]

    def node(self, k: int, context: np.ndarray) -> np.ndarray:
        return _find(self.tables[k][1]["nodes"], context)


def code_lengths(column: pa.Array, model: dict, lookup: Lookup | None = None):
    """Yield (first row, bits) with a row of bits per text, one per language."""
    lookup, width = lookup or Lookup(model), model["width"]
    for row, offsets, data in string_parts(column, 1 << 19):
        bits = np.zeros((len(offsets) - 1, len(model["languages"])))
        if len(data):
            now, (b1, b2, b3) = _codes(offsets, data, model["symbol"])
            context = (b3 * width + b2) * width + b1
            at = lookup.cell(ORDER, context, now)
            full = np.flatnonzero(np.diff(offsets))
            new = np.flatnonzero(at < 0)
            for i in range(bits.shape[1]):
                costs = model["orders"][ORDER]["costs"][i]
                found = costs[at].astype(np.float64)
                found[new] = 0
                bits[full, i] = np.add.reduceat(found, offsets[full])
            # what no language has seen after three bytes: escape to ever shorter contexts
            owner, context, now = np.searchsorted(offsets, new, "right") - 1, context[new], now[new]
            for k in range(ORDER, -1, -1):
                if not len(now):
                    break
                order, node = model["orders"][k], lookup.node(k, context)
                at = lookup.cell(k - 1, context % width ** (k - 1), now) if k else np.full(len(now), -1)
                for i in range(bits.shape[1]):
                    cost = np.where(node >= 0, order["escapes"][i, node], 0).astype(np.float64)
                    cost += np.where(at >= 0, model["orders"][k - 1]["costs"][i][at], 0) if k else 8.0
                    bits[:, i] += np.bincount(owner, cost, len(bits))
                left = at < 0
                owner, context, now = owner[left], context[left] % (width ** (k - 1) if k else 1), now[left]
        yield row, bits


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2, at most SAMPLE_PER_LANGUAGE of each
    language. Only the text is read for a prediction. The language with the shortest code wins, of equal ones the
    first by name; the score is its posterior 2^-bits / sum of 2^-bits. Null texts and texts without a letter give
    ``und`` with score 0, as does everything when nothing was learned. A null doc_id is returned with held_out null.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def predict(batches):
        m = model.value
        lookup = Lookup(m) if m["languages"] else None
        for batch in batches:
            if not m["languages"]:
                yield _predictions(batch, [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
                continue
            for row, bits in code_lengths(batch["text"], m, lookup):
                part = batch.slice(row, len(bits))
                best = bits.argmin(1)
                score = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
                letter = np.array([_has_letter(t) for t in part["text"].to_pylist()], bool)
                names = [m["languages"][b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                yield _predictions(part, names, np.where(letter, score, 0.0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def _predictions(part, names, scores):
    return pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
