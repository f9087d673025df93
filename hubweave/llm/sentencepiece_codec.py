"""SentencePiece encoding and decoding by shared-prefix dynamic programming.

The distinct marked words of a batch are sorted, which lays them out as the depth-first order of their trie. Walking
them in that order, the forward state of every prefix (the best segmentation that ends there) is kept on a stack, and a
word only extends the part that it does not share with the word before.

Unigram models: the state is the Viterbi score. BPE models: merging in order of score gives every prefix exactly one
segmentation, and it is the one whose last two pieces, merged on their own, stay apart; the state is its last piece.
So both give what the library gives for the same model.
"""

from __future__ import annotations

import re
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import string_parts

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 400_000
TEXT_BYTES = 4 << 20  # of texts whose words are sorted together


def load_pieces(path: str = DEFAULT_MODEL, kind: str = "bpe") -> dict:
    """Plain tables of a model file: piece -> (id, score), byte ids, and the bytes of every id. Read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw, byte_ids, control = {}, [], {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            control.append(i)
            raw.append(b"")
        else:
            pieces[piece] = (i, sp.get_score(i))
            raw.append(piece.replace(MARK, " ").encode())
    return {"kind": kind, "pieces": pieces, "bytes": [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, "unknown": sp.unk_id(), "raw": raw}


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, model: dict):
        self.pieces, self.bpe = model["pieces"], model["kind"] == "bpe"
        self.byte_ids, self.unknown, self.raw = model["bytes"], model["unknown"], model["raw"]
        self.apart: dict[tuple[str, str], bool] = {}
        self.lowest = min((s for _, s in self.pieces.values()), default=0.0) - 10
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in self.pieces))
        self.split = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]" if breaks else "")).findall
        # what a string is to a segmentation: a piece that can end one (True), or only the beginning of one (False)
        self.begins: dict[str, bool] = {}
        for piece in self.pieces:
            for end in range(1, len(piece)):
                self.begins.setdefault(piece[:end], False)
            self.begins[piece] = not self.bpe or len(piece) == 1 or self.merged(piece) == [piece]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}  # of each word learned; the ids of word k are flat[ends[k] : ends[k + 1]]
        self.flat, self.ends, self.lossless = array("i"), array("q", [0]), bytearray()

    def merged(self, text: str) -> list[str]:
        """Merges of neighbours by highest score, leftmost first; for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        known = self.apart[left, right] = self.merged(left + right) == [left, right]
        return known

    def ids_of(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found:
            return (found[0],)
        return tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown,)

    def learn(self, words: set[str]) -> None:
        """Segment ``words`` in sorted order, each from where it leaves the word before.

        For every prefix: its last piece, its score, and where pieces that may go on with the next character begin.
        """
        begins, apart = self.begins, self.apart
        lasts, scores, opened, before = [""], [0.0], [[]], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del lasts[shared + 1 :], scores[shared + 1 :], opened[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                going, last, best = [], None, None
                for start in (*opened[-1], end - 1):
                    piece = word[start:end]
                    ends = begins.get(piece)
                    if ends is None:
                        continue
                    going.append(start)
                    if not ends:
                        continue
                    if not self.bpe:
                        score = scores[start] + self.pieces[piece][1]
                        if best is None or score > best:
                            best, last = score, piece
                    elif last is None:
                        left = lasts[start]
                        if start == 0 or (known if (known := apart.get((left, piece))) is not None else self.stay_apart(left, piece)):
                            last = piece
                unknown = scores[-1] + self.lowest
                if not self.bpe and (best is None or unknown > best):
                    best, last = unknown, None
                lasts.append(last or word[end - 1])
                scores.append(best or 0.0)
                opened.append(going)
            ids, end = [], len(word)
            while end:
                ids.append(self.ids_of(lasts[end]))
                end -= len(lasts[end])
            self.numbers[word] = len(self.ends) - 1
            known = list(chain.from_iterable(reversed(ids)))
            self.flat.extend(known)
            self.ends.append(len(self.flat))
            self.lossless.append(b"".join([self.raw[i] for i in known]) == word.replace(MARK, " ").encode("utf-8", "surrogatepass"))
            before = word

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids, whether they decode to each text): a text's words decode one by one."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.numbers) > CACHE_WORDS:
            self.forget()
        self.learn(set(chain.from_iterable(split)).difference(self.numbers))
        sizes = np.array([len(parts) for parts in split], np.int64)
        word = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        ends = np.array(self.ends)
        lengths = np.append(0, np.cumsum(ends[word + 1] - ends[word]))
        at = np.repeat(ends[word] - lengths[:-1], np.diff(lengths)) + np.arange(lengths[-1])
        lost = np.append(0, np.cumsum(1 - np.frombuffer(bytes(self.lossless), np.uint8)[word].astype(np.int64)))
        upto = np.append(0, np.cumsum(sizes))
        plain = np.array([MARK not in t if t else True for t in texts], bool)
        return np.diff(lengths[upto]), np.array(self.flat, np.int32)[at], (np.diff(lost[upto]) == 0) & plain

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[int, Codec] = {}


def _codec(tables) -> Codec:
    """The codec of this Python worker: later tasks of a query find the words that earlier ones learned."""
    if tables.id not in _CODECS:
        _CODECS.clear()
        _CODECS[tables.id] = Codec(tables.model.value)
    return _CODECS[tables.id]


class _Tables:
    def __init__(self, spark: SparkSession, model_path: str, kind: str):
        self.model, self.id = spark.sparkContext.broadcast(load_pieces(model_path, kind)), uuid.uuid4().int


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, token_ids, round_trip (the ids decode to the text again).

    Null and empty texts have no tokens (and round_trip true). Characters outside the vocabulary become the ids of
    their UTF-8 bytes, or the unknown id in a model without byte pieces (round_trip then says false). Texts are encoded
    whole. Other columns play no part.
    """
    tables = _Tables(docs.sparkSession, model_path, kind)

    def run(batches):
        codec = _codec(tables)
        for batch in batches:
            for row, offsets, _ in string_parts(batch["text"], TEXT_BYTES):
                part = batch.slice(row, len(offsets) - 1)
                lengths, flat, same = codec.encode(part["text"].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lengths), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and the text of each list of ids; a null list gives a null text. Invalid byte sequences give U+FFFD."""
    tables = _Tables(tokens.sparkSession, model_path, "bpe")

    def run(batches):
        codec = _codec(tables)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
