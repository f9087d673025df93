"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

The sets of filters already applied form a lattice; a document is still there in a state if it fails none of the state's
filters. An edge of the lattice applies one more filter. Orders reaching a state and orders leaving it are counted
forward and backward along the edges, so an edge with its removals stands for forward x backward orders: the weighted
sum of a filter's edges is its Shapley value (times the number of orders), and a single order's steps are read from the
same edges. Documents count once, as (part, set of filters failed); nothing is evaluated per order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

MOST_FILTERS = 7  # 5,040 orders


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and \\t..\\r."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +"), "")


def _few_words(text, words):
    return F.size(words) < 50


def _repetitive(text, words):
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def _capitals(text, words):
    return 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 5 * F.length(text)


def _symbols(text, words):
    return text.rlike("[#$%&*|]")


#: letter -> condition on (text, words) under which a document fails
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": _few_words, "B": _repetitive, "C": _capitals, "D": _symbols}
COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, filters=FILTERS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail, bit k for the k-th letter.

    The last letter, ``copies``, is failed by a text identical to that of a smaller doc_id. Of equal texts (by SHA-256)
    only sums by part and the smallest doc_id are brought together, never their rows.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("doc_id is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = texts.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    by_id = rows.join(marks, "doc_id", "left").groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))

    # rows of the smallest id, and those without an id, are no copies of a smaller one
    equal = by_id.groupBy("digest", "part", "mask").agg(
        *sums,
        F.min("doc_id").alias("smallest"),
        F.min_by(F.struct("n", "good", "toxic"), "doc_id").alias("first"),
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_unnamed") for c in ("n", "good", "toxic")],
    )
    leads = F.col("smallest") == F.min("smallest").over(Window.partitionBy("digest"))
    split = equal.withColumn("leads", F.coalesce(leads, F.lit(False)))
    stay = {c: F.col(f"{c}_unnamed") + F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    originals = F.struct(F.col("mask"), *[v.alias(c) for c, v in stay.items()])
    later = F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in stay.items()])
    both = split.select("part", F.explode(F.array(originals, later)).alias("x")).select("part", "x.*").where("n > 0")
    return both.groupBy("part", "mask").agg(*sums)


def lattice(letters: str) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders): filter k applied in a state (bits of those applied), and in how many orders that happens.

    ``orders`` is the number of paths from the bottom to the state times that from the edge's end to the top.
    """
    n, top = len(letters), (1 << len(letters)) - 1
    forward, backward = [1] + [0] * top, [0] * top + [1]
    edges = [(state, k) for state in range(top + 1) for k in range(n) if not state >> k & 1]
    for state, k in edges:
        forward[state | 1 << k] += forward[state]
    for state, k in reversed(edges):
        backward[state] += backward[state | 1 << k]
    return [(state, k, forward[state] * backward[state | 1 << k]) for state, k in edges]


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, copies: str = COPIES, **columns) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``part`` is the source, a null one the empty string (and so one part with it). A null text is empty: it fails the
    filter on few words only, and that on copies. A row without doc_id is no copy of another row and no other is its
    copy; it has no label. Rows that repeat a doc_id count each, the smallest id's are all originals. A document with
    several label rows is good (toxic) if one says so; null labels say nothing. Parts without documents, and so an
    empty table, have no rows. Columns other than the named ones play no part.

    ``filters``: letter -> condition on (text, words); at most 7 letters with that of copies.
    """
    letters = "".join(filters) + copies
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MOST_FILTERS} different letters")
    spark = docs.sparkSession
    edges = lattice(letters)
    number = {(state, k): e for e, (state, k, _) in enumerate(edges)}

    # what a document that fails ``mask`` does on each edge: a table of 2^n x edges rows
    does = [(mask, e, not mask & (state | 1 << k), bool(mask >> k & 1 and not mask & state), bool(mask >> k & 1 and mask & state), mask == 1 << k) for mask in range(1 << len(letters)) for e, (state, k, _) in enumerate(edges)]
    moves = spark.createDataFrame(does, "mask int, edge int, keeps boolean, removes boolean, gone boolean, only boolean")
    counts = failures(docs, labels, filters, copies, **columns)
    total = lambda flag, c, name: F.sum(F.when(F.col(flag), F.col(c)).otherwise(0)).alias(name)
    on_edge = counts.join(F.broadcast(moves), "mask").groupBy("part", "edge").agg(total("keeps", "n", "kept"), total("removes", "n", "removed"), total("gone", "n", "redundant"), total("only", "n", "unique_fails"), total("removes", "good", "good_lost"), total("removes", "toxic", "toxic_lost"))

    weights = spark.createDataFrame([(e, k, orders) for e, (_, k, orders) in enumerate(edges)], "edge int, k int, orders long")
    weighed = on_edge.join(F.broadcast(weights), "edge")
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "k"))
    steps = []
    for order in itertools.permutations(range(len(letters))):
        state = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(letters[x] for x in order), step, number[state, k]))
            state |= 1 << k
    path = spark.createDataFrame(steps, "filter_order string, step int, edge int")
    done = weighed.withColumn("shapley", shapley).join(F.broadcast(path), "edge")
    return done.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY 1
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
  FROM documents
), docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN copy THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN labelled USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY 1, 2
), letters AS (
  SELECT chr(65 + k::INT) AS letter, (1 << k)::BIGINT AS bit FROM range(5) t(k)
), orders AS (
  SELECT [a, b, c, d, e] AS bits
  FROM (SELECT bit AS a FROM letters), (SELECT bit AS b FROM letters), (SELECT bit AS c FROM letters),
       (SELECT bit AS d FROM letters), (SELECT bit AS e FROM letters)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), steps AS (
  SELECT array_to_string(list_transform(bits, lambda b: chr(65 + log2(b)::INT)), '') AS filter_order, step::INT AS step,
         bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) s(step)
), audit AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audit
"""
