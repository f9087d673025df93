"""Spelling variants by dense prefix-suffix tiling.

Two words are near if they differ by one inserted, deleted or replaced code point: with L the longer length, the common
prefix and the common suffix together reach L - 1. The edit lies in one of three stretches of the L places, and outside
of that stretch both words agree. So words meet in tiles of one length class L, one stretch, and equal letters outside
of it; a word is in the tiles of L = its length and L = its length + 1. A tile's words are a padded matrix of code
points, aligned left and right, and its pairs are compared densely in blocks. Tiles of very many words are cut into
pairs of blocks, each a task's work of its own.

A tile reports for each of its words the number of near words and the best of them, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, runs, text_or_empty

LETTERS = r"[a-zÀ-ÿ]+"  # of lower-cased texts
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
STRETCHES = 3
BLOCK = 2000  # words of a block
PAIRS = 1 << 19  # compared at once


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 97) -> DataFrame:
    """(word, n): the runs of letters of all texts with their planted slips, A-Z lower-cased, counted.

    A run loses its code point h % length if ``modulus`` divides h, the CRC-32 of "<doc_id>:<run>"; without a doc_id it loses none.
    """
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), 0)).alias("run"))
    hashed = found.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"), "doc_id")
    slip = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    word = F.when(F.col("doc_id").isNotNull() & (F.col("h") % modulus == 0), slip).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _tile_keys(words: DataFrame) -> DataFrame:
    """(key, longest, stretch, word, n): each word once for each stretch of its two length classes."""
    rows = []
    for extra in (0, 1):
        for s in range(STRETCHES):
            longest = f"(length(word) + {extra})"
            begin, end = f"cast({longest} * {s} div {STRETCHES} as int)", f"cast({longest} * {s + 1} div {STRETCHES} as int)"
            tail = f"cast({longest} as int) - {end}"
            rows.append(f"struct({longest} as longest, {s} as stretch, substring(word, 1, {begin}) as head, right(word, {tail}) as tail)")
    tiled = words.select("word", "n", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x"))
    return tiled.select(F.xxhash64("x.longest", "x.stretch", "x.head", "x.tail").alias("key"), F.col("x.longest").alias("longest"), F.col("x.stretch").alias("stretch"), "word", "n")


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _matrices(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of length ``longest`` or one less, aligned left and right and padded with 0."""
    try:
        points = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) for w in words])
    left, right = (np.zeros((len(words), longest), points.dtype) for _ in range(2))
    column = np.arange(longest)
    left[column < lengths[:, None]] = points
    right[column >= (longest - lengths)[:, None]] = points
    return left, right[:, ::-1]


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first columns agree, row by row."""
    differ = x != y
    at = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(at)), at], at, x.shape[1])


def _near_pairs(words: list[str], group: np.ndarray, block: np.ndarray, longest: int, stretch: np.ndarray):
    """Index pairs of near words in a tile; ``group`` numbers the tiles, whose words stand together."""
    left, right = _matrices(words, longest)
    long = np.array([len(w) == longest for w in words])
    last = np.searchsorted(group, group, "right")
    later = last - np.arange(len(group)) - 1
    reach = np.append(0, np.cumsum(later))
    at = 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(reach, reach[at] + max(1, PAIRS * 16 // longest), "right")) - 1)
        counts = later[at:end]
        if counts.sum():
            a = np.repeat(np.arange(at, end), counts)
            b = np.arange(len(a)) - np.repeat(reach[at:end] - reach[at], counts) + a + 1
            # of two different blocks only pairs across; the pair of a block with itself has block -1
            some = (long[a] | long[b]) & ((block[a] < 0) | (block[a] != block[b]))
            a, b = a[some], b[some]
            cp = _common(left[a], left[b])
            begin = longest * stretch[a] // STRETCHES
            end_of = longest * (stretch[a] + 1) // STRETCHES
            edit = np.minimum(cp, longest - 1)
            some = (edit >= begin) & (edit < end_of)
            a, b, cp = a[some], b[some], cp[some]
            some = cp + _common(right[a], right[b]) >= longest - 1
            yield a[some], b[some]
        at = end


def _best(batches):
    """(word, n_near, best_n, best) for the words of a batch's tiles that have near words."""
    for batch in runs(batches, "tile"):
        longest, tile, stretch = (batch[c].to_numpy() for c in ("longest", "tile", "stretch"))
        n, block = batch["n"].to_numpy(), batch["block"].to_numpy()
        words = np.array(batch["word"].to_pylist(), object)
        for size in np.unique(longest).tolist():
            rows = np.flatnonzero(longest == size)
            rows = rows[np.lexsort((words[rows], stretch[rows], tile[rows]))]
            group = np.cumsum(np.append(0, (np.diff(tile[rows]) != 0) | (np.diff(stretch[rows]) != 0)))
            pairs = list(_near_pairs(words[rows].tolist(), group, block[rows], size, stretch[rows]))
            if not sum(len(a) for a, _ in pairs):
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            word, other = rows[np.concatenate([a, b])], rows[np.concatenate([b, a])]
            order = np.lexsort((words[other], -n[other], word))
            word, other = word[order], other[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            near = np.diff(np.append(first, len(word)))
            yield pa.RecordBatch.from_arrays([pa.array(words[word[first]].tolist(), pa.string()), pa.array(near, pa.int64()), pa.array(n[other[first]], pa.int64()), pa.array(words[other[first]].tolist(), pa.string())], schema=_NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n) that have near ones; best has the largest n, the smallest word of these."""
    met = _tile_keys(words)
    sizes = met.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = met.join(sizes.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    tiles = paired.select(tile.alias("tile"), "longest", "stretch", "word", "n", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("block"))
    partial = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_best, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("by"), F.col("best").alias("word")))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.by")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where following the forms ends, by pointer jumping.

    n at least doubles with every link, so the rounds grow with the logarithm of the logarithm of the largest n.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(at)
        at = step
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have at least 5 code points and occur 3 times or more in all texts together (a slip planted by the CRC-32 of
    id and run counts as what it makes). A word's form is its near word of largest n (of these the smallest by code
    point), if that n is at least twice the word's own, else null; root follows the forms to the last. Null and empty
    texts have no words, rows without a doc_id no slips; repeated rows count each. An empty table gives an empty
    result. Other columns play no part.
    """
    words = materialize(word_counts(docs, id_col, text_col).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)))
    near = near_words(words)
    has = F.col("best_n") >= RATIO * F.col("n")
    named = materialize(words.join(near, "word", "left").select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS places
  FROM range(256) t(i)
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM found GROUP BY 1, 2
), bytes AS (
  SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM counted
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
           lambda c, b: xor(places[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY 1
), named AS (
  SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS far FROM named
  UNION ALL
  SELECT walk.word, form, far + 1 FROM walk JOIN named ON named.word = walk.root WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM named JOIN (SELECT word, max_by(root, far) AS root FROM walk GROUP BY 1) USING (word)
"""
