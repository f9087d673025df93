"""Exact connected groups from shared keys, without listing every pair of a key's members.

``keyed`` (key, node, info) says which nodes may be linked: two nodes can be linked only if they share a key. First each
key's members are compared with one of them only. Members that this already connects need no comparison with each
other; what is left in the end are pairs of a key's members in different groups, and all of these are compared.
DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

ROUNDS = 3
CELL = 1000  # members of a key that one row of the last comparison meets


def components(links: DataFrame) -> DataFrame:
    """(node, group) for the nodes of ``links`` (a, b): group is the smallest node reachable.

    Smallest labels spread over the links, with pointer jumping, until none changes: rounds grow with the logarithm of
    the longest chain. An empty table gives an empty result; repeated links and loops don't matter.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = materialize(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("group")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "group"), "other").groupBy("node").agg(F.min("group").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("group", "near").alias("group"), F.col("group").alias("old"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("further"))
        step = materialize(spread.join(jump, "group").select("node", F.least("group", "further").alias("group"), "old"))
        release(labels)
        labels = step
        if step.where(F.col("group") != F.col("old")).isEmpty():
            release(edges)
            return step


def linked_groups(keyed: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column], central: Callable[[Column], Column], rounds: int = ROUNDS) -> DataFrame:
    """(node, group) of all nodes that have a link. ``verify`` keeps the true links of pairs (a, b), a < b.

    ``keyed`` is a materialised table with key, node and a struct ``info``. ``fits`` of two infos is
    false only where the two nodes need not be compared under that key. ``central`` of an info is high for nodes that
    are likely to have many links.

    Each of the first rounds compares, for every key, one member of its largest group with the members of its other
    groups: first the most central one, then any, but the same one wherever it is a member, so a pair comes from many
    keys but once. (Copies with changes of their own may be linked to what they were made from and not to each other.)
    Once the pairs of different groups are as few as rows, or a round links less than 1 in 100 of them, all of them are
    compared, so no link between groups is missed.
    """
    links: list[DataFrame] = []
    groups = None
    known = keyed.withColumn("group", F.col("node"))
    for turn in range(rounds + 1):
        order = F.struct(central(F.col("info")).alias("by") if turn == 0 else F.lit(0.0).alias("by"), F.xxhash64("node", F.lit(turn)).alias("hash"))
        one = F.struct("node", "info")
        if groups is None:  # each node is a group
            parts = known.select("key", "group", F.lit(1).cast("long").alias("size"), one.alias("one"), order.alias("order"))
        else:
            parts = known.groupBy("key", "group").agg(F.count(F.lit(1)).alias("size"), F.max_by(one, order).alias("one"), F.max(order).alias("order"))
        per_key = parts.groupBy("key").agg(
            F.max_by(F.struct("group", "one"), F.struct("size", "order")).alias("top"),
            F.sum("size").alias("all"),
            F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"),
            F.count(F.lit(1)).alias("n"),
        )
        mixed = materialize(per_key.where("n > 1").select("key", F.col("top.group").alias("hub_group"), F.col("top.one").alias("hub"), "all", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("pairs")))
        load = mixed.agg(F.sum("all").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not load["rows"]:
            release(mixed)
            break
        beside = known.join(mixed.select("key", "hub_group", "hub", "all").hint("merge"), "key").where("group != hub_group")
        last = turn == rounds or load["pairs"] <= 2 * load["rows"] or (turn > 0 and not progress)
        if last:
            pairs = _all_pairs(known.join(mixed.select("key", "all").hint("merge"), "key"), beside, fits)
        else:
            pairs = beside.where(fits(F.col("info"), F.col("hub.info"))).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        pairs = materialize(pairs)
        more = materialize(verify(pairs))
        release(pairs, mixed)
        found = more.count()
        progress = 100 * found > load["rows"]
        links.append(more)
        if groups is not None:
            release(groups)
        all_links = links[0]
        for other in links[1:]:
            all_links = all_links.unionByName(other)
        groups = components(all_links)
        if last:
            break
        known = keyed.join(groups.select("node", "group").hint("merge"), "node", "left").select("key", "node", "info", F.coalesce("group", "node").alias("group"))
    release(*links)
    return keyed.sparkSession.createDataFrame([], "node long, group long") if groups is None else groups.select("node", "group")


def _all_pairs(known: DataFrame, beside: DataFrame, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b) that fit, of nodes of different groups that share a key.

    One of such a pair is beside its key's largest group. The members of a large key are cut into slices, so that no
    task has to compare all of them.
    """
    slices = F.ceil(F.col("all") / CELL).cast("int")
    left = beside.select(F.col("key").alias("k1"), F.col("node").alias("x"), F.col("group").alias("g1"), F.col("info").alias("i1"), F.col("hub_group"), F.pmod(F.xxhash64("node"), slices).cast("int").alias("s1"))
    right = known.select("key", F.col("node").alias("y"), F.col("group").alias("g2"), F.col("info").alias("i2"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("s2"))
    once = (F.col("g2") == F.col("hub_group")) | (F.col("x") < F.col("y"))
    met = left.join(right, (left["k1"] == right["key"]) & (left["s1"] == right["s2"]) & (F.col("g1") != F.col("g2")) & once & fits(F.col("i1"), F.col("i2")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
