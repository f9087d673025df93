"""Regional contribution and discovery: which nodes make two groups' networks differ.

The contribution of a set S is J(without S) - J(all). Sums of pairs without S follow from totals, node sums and pair
values, N - sum n_i + sum n_ij over S, so a candidate costs its own few lookups and not a pass over the network.
``pairs``: (matrix_key, approach, i, j, lo, hi), lo and hi the smaller and larger weight of the two groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.operators import penalised
from hubweave.sources.scratch import settled

TINY = 1e-12


def network_pairs(networks: DataFrame, g1: str, g2: str) -> DataFrame:
    """``pairs`` of two groups from networks (matrix_key, approach, grp, i, j, w)."""
    a = networks.where(F.col("grp") == g1).select("matrix_key", "approach", "i", "j", F.col("w").alias("w1"))
    b = networks.where(F.col("grp") == g2).select("matrix_key", "i", "j", F.col("w").alias("w2"))
    return a.join(b, ["matrix_key", "i", "j"]).select("matrix_key", "approach", "i", "j", F.least("w1", "w2").alias("lo"), F.greatest("w1", "w2").alias("hi"), "w1", "w2")


def candidates(spark, nodes: list[str], largest: int) -> DataFrame:
    """(combo_id, size, nodes): all sets of 1 to ``largest`` nodes (n - 2 at most), by repeated joins on later nodes."""
    base = spark.createDataFrame([(k, n) for k, n in enumerate(nodes)], "at int, node string")
    level = base.select(F.array("node").alias("nodes"), F.col("at").alias("last"))
    found = level
    for _ in range(min(largest, len(nodes) - 2) - 1):
        level = level.join(base, F.col("at") > F.col("last")).select(F.concat("nodes", F.array("node")).alias("nodes"), F.col("at").alias("last"))
        found = found.unionByName(level)
    return found.select(F.array_join("nodes", ",").alias("combo_id"), F.size("nodes").alias("size"), "nodes")


def candidate_sets(nodes: DataFrame, largest: int) -> DataFrame:
    """(combo_id, size, nodes): all sets of 1 to ``largest`` of the ``nodes`` (node) of a table, n - 2 at most.

    Sets grow by joins with the nodes after their last one; a set of fewer than 3 nodes left over has no contribution.
    """
    base = settled(nodes.select("node").distinct())
    n = base.agg(F.count(F.lit(1)).alias("n"))
    level = base.select(F.array("node").alias("nodes"), F.col("node").alias("last"))
    found = level
    for _ in range(largest - 1):
        level = level.join(base, F.col("node") > F.col("last")).select(F.array_append("nodes", F.col("node")).alias("nodes"), F.col("node").alias("last"))
        found = found.unionByName(level)
    kept = found.join(F.broadcast(n), F.size("nodes") <= F.greatest(F.lit(1), F.col("n") - 2))
    return kept.select(F.array_join("nodes", ",").alias("combo_id"), F.size("nodes").alias("size"), "nodes")


def set_sums(pairs: DataFrame, sets: DataFrame, *key: str) -> DataFrame:
    """(key, matrix_key, approach, combo_id, size, n_nodes, j_all, j_without) of each set and matrix.

    ``sets`` (combo_id, size, nodes); an empty remainder gives 0.
    """
    k = [*key, "matrix_key", "approach"]
    members = sets.select("combo_id", "size", F.explode("nodes").alias("node"))
    ends = pairs.select(*k, F.explode(F.array("i", "j")).alias("node"), "lo", "hi")
    node = ends.groupBy(*k, "node").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    total = pairs.groupBy(*k).agg(F.sum("lo").alias("n"), F.sum("hi").alias("d"))
    size = node.groupBy(*k).agg(F.count(F.lit(1)).alias("n_nodes"))
    single = members.join(node, "node").groupBy(*k, "combo_id", "size").agg(F.sum("lo").alias("sn"), F.sum("hi").alias("sd"))
    inner = members.select("combo_id", F.col("node").alias("i")).join(members.select("combo_id", F.col("node").alias("j")), "combo_id").where("i < j").join(pairs.select(*k, "i", "j", "lo", "hi"), ["i", "j"]).groupBy(*k, "combo_id").agg(F.sum("lo").alias("pn"), F.sum("hi").alias("pd"))
    s = single.join(inner, [*k, "combo_id"], "left").join(F.broadcast(total), k).join(F.broadcast(size), k)
    zero = F.lit(0.0)
    n, d = F.col("n") - F.col("sn") + F.coalesce("pn", zero), F.col("d") - F.col("sd") + F.coalesce("pd", zero)
    all_ = F.coalesce(F.try_divide("n", "d"), zero)
    return s.select(*k, "combo_id", "size", "n_nodes", all_.alias("j_all"), F.when(F.abs(d) < TINY, zero).otherwise(n / d).alias("j_without"))


def contributions(pairs: DataFrame, sets: DataFrame, averaging: str = "balanced", *key: str) -> DataFrame:
    """(key, combo_id, size, j_all, j_without, contribution). Matrices count where 3 nodes or more remain.

    ``balanced``: mean of the approaches' means; ``flat``: mean over all matrices.
    """
    s = set_sums(pairs, sets, *key).where(F.col("n_nodes") - F.col("size") >= 3)
    if averaging == "balanced":
        s = s.groupBy(*key, "combo_id", "size", "approach").agg(F.avg("j_all").alias("j_all"), F.avg("j_without").alias("j_without"))
    s = s.groupBy(*key, "combo_id", "size").agg(F.avg("j_all").alias("j_all"), F.avg("j_without").alias("j_without"))
    return s.withColumn("contribution", F.col("j_without") - F.col("j_all"))


def leave_one_out(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """Contribution and percent change of single nodes or whole areas; ``regions`` as sets."""
    c = contributions(pairs, regions)
    return c.withColumn("pct_change", F.try_divide(100 * F.col("contribution"), "j_all"))


def seats(nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(perm, side, node, seat): in each permutation and on each side the nodes sit where others were.

    ``nodes`` (node). The node at place k by md5(seed|perm|side|node) takes the seat of the k-th node by name.
    """
    drawn = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("perm")).select("perm", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"), "node")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("side").cast("string"), "node").cast("binary"))
    by = Window.partitionBy("perm", "side")
    placed = drawn.withColumn("at", F.row_number().over(by.orderBy(digest, "node")))
    named = drawn.select("perm", "side", F.col("node").alias("seat"), F.row_number().over(by.orderBy("node")).alias("at"))
    return placed.join(named, ["perm", "side", "at"]).select("perm", "side", "node", "seat")


def relabelled(pairs: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``pairs`` of every permutation: (perm, matrix_key, approach, i, j, lo, hi), both groups' nodes reseated apart.

    Weights of all matrices of a pair of nodes travel as one array; a permutation's pair of seats fetches those of the
    two nodes that sit there on either side, so the rows joined are pairs of seats, not pairs times matrices.
    """
    ordered = pairs.select(F.struct("matrix_key", "approach").alias("m"), "i", "j", "w1", "w2")
    by_pair = settled(ordered.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("m", "w1", "w2"))).alias("all")))
    nodes = pairs.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    where = settled(seats(nodes, count, seed))
    sides = []
    for side in (1, 2):
        at = where.where(F.col("side") == side)
        left = at.select("perm", F.col("seat").alias("i"), F.col("node").alias("x"))
        right = at.select("perm", F.col("seat").alias("j"), F.col("node").alias("y"))
        both = left.join(right, "perm").where("i < j").select("perm", "i", "j", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        own = f"w{side}"
        weights = F.transform("all", lambda a: F.struct(a["m"].alias("m"), a[own].alias("w"))).alias(f"s{side}")  # noqa: B023 (called at once)
        sides.append(both.join(by_pair.select(F.col("i").alias("x"), F.col("j").alias("y"), weights), ["x", "y"]).drop("x", "y"))
    met = sides[0].join(sides[1], ["perm", "i", "j"])
    cell = F.explode(F.zip_with("s1", "s2", lambda a, b: F.struct(a["m"].alias("m"), F.least(a["w"], b["w"]).alias("lo"), F.greatest(a["w"], b["w"]).alias("hi")))).alias("c")
    return met.select("perm", "i", "j", cell).select("perm", "c.m.matrix_key", "c.m.approach", "i", "j", "c.lo", "c.hi")


def permutation_p(pairs: DataFrame, sets: DataFrame, count: int = 100, averaging: str = "flat", seed: int = 42) -> DataFrame:
    """(combo_id, size, observed, p, ci_low, ci_high): p = (1 + #{|null| >= |observed|}) / (count + 1); the bounds are
    the order statistics at 2.5 and 97.5 percent of the null.

    In each permutation both groups' nodes are shuffled independently, alike for all matrices and candidates (every
    matrix holds every pair of nodes). The null contributions are those of the relabelled pairs, keyed by permutation.
    """
    seen = contributions(pairs, sets, averaging).select("combo_id", "size", F.col("contribution").alias("observed"))
    null = contributions(settled(relabelled(pairs, count, seed)), sets, averaging, "perm").select("combo_id", F.col("contribution").alias("null"))
    far = F.count_if(F.abs("null") >= F.abs("observed") - TINY)
    low, high = int(0.025 * count), min(count - 1, int(0.975 * count))
    order = F.array_sort(F.collect_list("null"))
    tested = seen.join(null, "combo_id").groupBy("combo_id", "size", "observed").agg(far.alias("far"), order.alias("null"))
    return tested.select("combo_id", "size", "observed", ((F.col("far") + 1) / F.lit(count + 1.0)).alias("p"), F.get("null", F.lit(low)).alias("ci_low"), F.get("null", F.lit(high)).alias("ci_high"))


def synergy(found: DataFrame) -> DataFrame:
    """Adds expected_additive, synergy, synergy_ratio, rank_score and direction to contributions(...) of all sets.

    Synergy is the contribution beyond the sum of the single nodes'; the ratio is to the size of that sum. Singles
    rank by |contribution|, others by |ratio|, or a hundredth of |contribution| where there is no ratio.
    """
    singles = found.where("size = 1").select(F.col("combo_id").alias("node"), F.col("contribution").alias("one"))
    parts = found.select("combo_id", F.explode(F.split("combo_id", ",")).alias("node")).join(F.broadcast(singles), "node").groupBy("combo_id").agg(F.sum("one").alias("expected_additive"))
    s = found.join(parts, "combo_id").withColumn("synergy", F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.col("contribution") - F.col("expected_additive")))
    s = s.withColumn("synergy_ratio", F.when((F.col("size") > 1) & (F.abs("expected_additive") > 1e-10), F.col("synergy") / F.abs("expected_additive")))
    score = F.when(F.col("size") == 1, F.abs("contribution")).otherwise(F.coalesce(F.abs("synergy_ratio"), 0.01 * F.abs("contribution")))
    return s.withColumn("rank_score", score).withColumn("direction", F.when(F.col("contribution") > 0, "dissimilarity").otherwise("similarity"))


def filter_candidates(found: DataFrame, rule: str = "all") -> DataFrame:
    """``all``; ``sd_x``: |z| of the contribution over x within its direction; ``pct_x``: the best x percent by score."""
    if rule == "all":
        return found
    kind, x = rule.split("_")
    w = Window.partitionBy("direction")
    if kind == "sd":
        z = F.try_divide(F.col("contribution") - F.avg("contribution").over(w), F.stddev_samp("contribution").over(w))
        return found.withColumn("_z", z).where(F.abs("_z") > float(x)).drop("_z")
    place, all_ = F.row_number().over(w.orderBy(F.col("rank_score").desc(), "combo_id")), F.count(F.lit(1)).over(w)
    keep = F.greatest(F.lit(1), F.ceil(all_ * float(x) / 100))
    return found.withColumn("_p", place).withColumn("_k", keep).where("_p <= _k").drop("_p", "_k")


def brute_force(pairs: DataFrame, sets: DataFrame, rule: str = "pct_10", count: int = 100, seed: int = 42) -> DataFrame:
    """Contributions of all sets, synergy, the candidates of ``rule``, their flat permutation p-values, and the pooled
    false discovery rate."""
    from hubweave.operators.permute import adjust

    kept = settled(filter_candidates(synergy(settled(contributions(pairs, sets))), rule))
    p = permutation_p(pairs, settled(sets.join(kept.select("combo_id"), "combo_id")), count, "flat", seed).select("combo_id", "p")
    return adjust(kept.join(p, "combo_id"), "p", "fdr").withColumn("significant", F.col("p_adjusted") < 0.05)


DIRECTIONS = ("dissimilarity", "similarity")


def greedy(pairs: DataFrame, most: int = 10) -> DataFrame:
    """(direction, step, node, contribution): sets grown by the node that moves the balanced contribution most.

    Both directions grow together, until no node helps, ``most`` nodes are chosen or 2 nodes are left; of ties the first
    by name. The state is a row per direction, matrix and node that is left, with the node's sums over pairs with other
    nodes left, and the matrix's sums over all of these; a chosen node's pairs are taken off both. A step is one
    aggregation over the nodes, whatever the size of the set.
    """
    k = ["matrix_key", "approach"]
    ends = settled(pairs.select(*k, F.col("i").alias("node"), F.col("j").alias("other"), "lo", "hi").unionByName(pairs.select(*k, F.col("j").alias("node"), F.col("i").alias("other"), "lo", "hi")))
    ratio = lambda n, d: F.when(F.abs(d) < TINY, F.lit(0.0)).otherwise(n / d)
    own = ends.groupBy(*k, "node").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    by = Window.partitionBy(*k)
    own = own.withColumns({"all_lo": F.sum("lo").over(by) / 2, "all_hi": F.sum("hi").over(by) / 2, "n": F.count(F.lit(1)).over(by)})
    state = own.withColumn("j_all", ratio(F.col("all_lo"), F.col("all_hi"))).withColumn("reached", F.lit(0.0)).withColumn("direction", F.explode(F.array(*[F.lit(x) for x in DIRECTIONS])))
    sign = F.when(F.col("direction") == DIRECTIONS[0], F.lit(1.0)).otherwise(F.lit(-1.0))
    steps = []
    for step in range(1, most + 1):
        state = settled(state)
        gone = ratio(F.col("all_lo") - F.col("lo"), F.col("all_hi") - F.col("hi")) - F.col("j_all")
        per = state.where(F.col("n") - step >= 2).groupBy("direction", "node", "approach").agg(F.avg(gone).alias("c"), F.first("reached").alias("reached"))
        moved = per.groupBy("direction", "node").agg(F.avg("c").alias("contribution"), F.first("reached").alias("reached"))
        best = moved.groupBy("direction").agg(F.min(F.struct((-sign * F.round("contribution", 12)).alias("by"), "node", "contribution", "reached")).alias("b"))
        best = settled(best.select("direction", "b.node", "b.contribution", "b.reached").where(sign * (F.col("contribution") - F.col("reached")) > TINY))
        if best.isEmpty():
            break
        steps.append(best.select("direction", F.lit(step).alias("step"), "node", "contribution"))
        chosen = best.select("direction", F.col("node").alias("gone"), F.col("contribution").alias("now"))
        taken = state.join(chosen.withColumn("node", F.col("gone")), ["direction", "node"]).select("direction", *k, F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"), "gone", "now")
        left = state.join(taken, ["direction", *k]).where("node <> gone")
        with_gone = ends.select(*k, "node", F.col("other").alias("gone"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
        state = left.join(with_gone, [*k, "node", "gone"]).select(
            "direction", *k, "node", (F.col("lo") - F.col("p_lo")).alias("lo"), (F.col("hi") - F.col("p_hi")).alias("hi"),
            (F.col("all_lo") - F.col("own_lo")).alias("all_lo"), (F.col("all_hi") - F.col("own_hi")).alias("all_hi"), "n", "j_all", F.col("now").alias("reached"),
        )
    empty = pairs.sparkSession.createDataFrame([], "direction string, step int, node string, contribution double")
    for found in steps:
        empty = empty.unionByName(found)
    return empty


def to_elbow(steps: DataFrame) -> DataFrame:
    """The steps of each direction up to the elbow: the place farthest from the chord of the normalised absolute values
    (the first of equal ones, to 12 decimals); all of fewer than 3."""
    by = Window.partitionBy("direction")
    size, low, high = F.abs("contribution"), F.min(F.abs("contribution")).over(by), F.max(F.abs("contribution")).over(by)
    s = steps.withColumns({"y": F.coalesce(F.try_divide(size - low, high - low), F.lit(0.0)), "n": F.count(F.lit(1)).over(by)})
    s = s.withColumn("x", F.coalesce(F.try_divide(F.col("step") - 1.0, F.col("n") - 1.0), F.lit(0.0)))
    first, last = F.first("y").over(by.orderBy("step")), F.last("y").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumns({"first": first, "last": last}).withColumn("far", F.round(F.abs((F.col("last") - F.col("first")) * F.col("x") - F.col("y") + F.col("first")), 12))
    s = s.withColumn("farthest", F.max("far").over(by))
    cut = F.min(F.when(F.col("far") == F.col("farthest"), F.col("step"))).over(by)
    s = s.withColumn("cut", F.when(F.col("n") < 3, F.col("n")).otherwise(cut))
    return s.where("step <= cut").select("direction", "step", "node", "contribution")


def greedy_discovery(pairs: DataFrame, most: int = 10, count: int = 100, seed: int = 42) -> DataFrame:
    """(direction, nodes, size, contribution, p): the greedy set of each direction, cut at its elbow and tested as one
    set; p times the number of directions."""
    kept = settled(to_elbow(settled(greedy(pairs, most))))
    sets = kept.groupBy("direction").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select(F.col("direction").alias("combo_id"), F.size("nodes").alias("size"), "nodes")
    found = permutation_p(pairs, settled(sets), count, "balanced", seed)
    return sets.join(found.drop("size"), "combo_id").select(F.col("combo_id").alias("direction"), F.array_join("nodes", ",").alias("nodes"), "size", F.col("observed").alias("contribution"), F.least(F.lit(1.0), F.col("p") * len(DIRECTIONS)).alias("p"))


def connectivity_difference(pairs: DataFrame) -> DataFrame:
    """(i, j, difference): mean over the matrices of |w1 - w2|."""
    return pairs.groupBy("i", "j").agg(F.avg(F.abs(F.col("w1") - F.col("w2"))).alias("difference"))


def ward_clusters(d: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 (by first member) of Ward's clustering (D2) of a distance matrix."""
    groups = {i: [i] for i in range(len(d))}
    dist = d.astype(float).copy() ** 2
    np.fill_diagonal(dist, np.inf)
    size = np.ones(len(d))
    while len(groups) > k:
        live = sorted(groups)
        sub = dist[np.ix_(live, live)]
        a, b = np.unravel_index(np.argmin(sub), sub.shape)
        i, j = live[min(a, b)], live[max(a, b)]
        for x in live:
            if x not in (i, j):
                new = ((size[i] + size[x]) * dist[i, x] + (size[j] + size[x]) * dist[j, x] - size[x] * dist[i, j]) / (size[i] + size[j] + size[x])
                dist[i, x] = dist[x, i] = new
        groups[i] += groups.pop(j)
        size[i] += size[j]
        dist[j, :] = dist[:, j] = np.inf
    labels = np.zeros(len(d), int)
    for label, first in enumerate(sorted(groups, key=lambda g: min(groups[g]))):
        labels[groups[first]] = label
    return labels


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette width; nodes alone in their cluster count 0."""
    out = []
    for i in range(len(d)):
        own = (labels == labels[i]) & (np.arange(len(d)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == x].mean() for x in set(labels) if x != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def best_clusters(d: np.ndarray, most: int, least: int = 2) -> tuple[int, np.ndarray]:
    """(k, labels) of the largest mean silhouette for k in [least, most], clamped to n - 1."""
    tried = [(k, ward_clusters(d, k)) for k in range(least, max(least, min(most, len(d) - 1)) + 1)]
    return max(tried, key=lambda x: (silhouette(d, x[1]), -x[0]))


def cluster_discovery(pairs: DataFrame, nodes: list[str], most: int = 5, least: int = 3, count: int = 100) -> DataFrame:
    """(combo_id, size, observed, p, ...) of the clusters of nodes by Euclidean distance of their difference rows."""
    m, at = np.zeros((len(nodes), len(nodes))), {n: i for i, n in enumerate(nodes)}
    for r in connectivity_difference(pairs).collect():  # one row per pair of nodes
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["difference"]
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    _, labels = best_clusters(d, most, least)
    rows = [(",".join(own), len(own), own) for c in sorted(set(labels)) if (own := [n for n, x in zip(nodes, labels, strict=True) if x == c])]
    return permutation_p(pairs, pairs.sparkSession.createDataFrame(rows, "combo_id string, size int, nodes array<string>"), count, "balanced")


def complement_sets(sets: DataFrame, nodes: list[str]) -> DataFrame:
    """The sets and, as further candidates, all other nodes of each."""
    rest = F.array_except(F.array(*[F.lit(n) for n in nodes]), "nodes")
    other = sets.select(rest.alias("nodes")).where(F.size("nodes") > 0)
    return sets.select("nodes").union(other).distinct().select(F.array_join("nodes", ",").alias("combo_id"), F.size("nodes").alias("size"), "nodes")


def node_summary(found: DataFrame, significant_only: bool = False, synergistic_only: bool = False) -> DataFrame:
    """(node, sim_count, dissim_count, sim_contribution, dissim_contribution, net_count, total_count, direction_ratio)."""
    rows = found.where("significant") if significant_only else found
    if synergistic_only:
        rows = rows.where("(direction = 'dissimilarity' and synergy > 0) or (direction = 'similarity' and synergy < 0)")
    rows = rows.select(F.explode(F.split("combo_id", ",")).alias("node"), "direction", F.abs("contribution").alias("size"))
    dis = F.col("direction") == "dissimilarity"
    s = rows.groupBy("node").agg(F.count_if(~dis).alias("sim_count"), F.count_if(dis).alias("dissim_count"), F.sum(F.when(~dis, F.col("size")).otherwise(0.0)).alias("sim_contribution"), F.sum(F.when(dis, F.col("size")).otherwise(0.0)).alias("dissim_contribution"))
    s = s.withColumn("net_count", F.col("dissim_count") - F.col("sim_count")).withColumn("total_count", F.col("dissim_count") + F.col("sim_count"))
    return s.withColumn("direction_ratio", F.col("net_count") / F.col("total_count"))


def lasso_fit(rows: DataFrame, nodes: list[str], alpha: float = 1.0, folds: int = 10, seed: int = 42) -> tuple[DataFrame, penalised.Path]:
    """The prepared subjects of ``rows`` (side 1 or 2, values) and the penalised models of the side along the path.

    At most as many folds as the smaller side has subjects, at least 3. ValueError for fewer than 10 rows, 3 a side or 2
    nodes with values.
    """
    sizes = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
    if sum(sizes.values()) < 10 or min(sizes.get(1, 0), sizes.get(2, 0)) < 3:
        raise ValueError("too few rows")
    folds = max(3, min(folds, *sizes.values()))
    data, held = penalised.prepared(rows, nodes, folds, seed)
    if len(held) < 2:
        raise ValueError("too few nodes with values")
    return data, penalised.path(data, held, alpha, folds)


def lasso(rows: DataFrame, nodes: list[str], alpha: float = 1.0, folds: int = 10, seed: int = 42, choice: str = "min", fitted: penalised.Path | None = None) -> DataFrame:
    """(node, coefficient, abs_coefficient, selected, direction, mean1, mean2, difference) of a penalised logistic
    regression of the side (1 or 2) on standardised nodes. ``choice``: the penalty of the least cross-validated deviance
    (min) or the largest within one standard error of it (1se). The difference is mean2 - mean1."""
    fitted = fitted or lasso_fit(rows, nodes, alpha, folds, seed)[1]
    best = fitted.coefficients[0, fitted.step(choice), 1:]
    table = rows.sparkSession.createDataFrame([(n, float(c), abs(float(c)), bool(c != 0)) for n, c in zip(fitted.nodes, best, strict=True)], "node string, coefficient double, abs_coefficient double, selected boolean")
    names = F.array(*[F.lit(n) for n in nodes])
    long = rows.select("side", F.posexplode("values").alias("at", "value")).select("side", F.get(names, F.col("at")).alias("node"), "value")
    value = F.coalesce("value", F.col("mean"))  # a missing value counts as the node's mean over both sides
    filled = long.join(long.groupBy("node").agg(F.avg("value").alias("mean")), "node")
    means = filled.groupBy("node").agg(F.avg(F.when(F.col("side") == 1, value)).alias("mean1"), F.avg(F.when(F.col("side") == 2, value)).alias("mean2"))
    direction = F.when(F.col("coefficient") > 0, "higher in 2").when(F.col("coefficient") < 0, "higher in 1").otherwise("not selected")
    return table.withColumn("direction", direction).join(means, "node").withColumn("difference", F.col("mean2") - F.col("mean1"))


def lasso_agreement(selected: DataFrame, summary: DataFrame) -> DataFrame:
    """Full join on the node: (node, coefficient, selected, total_count, agreement)."""
    j = selected.select("node", "coefficient", "selected").join(summary.select("node", "total_count"), "node", "full")
    a, b = F.coalesce("selected", F.lit(False)), F.coalesce("total_count", F.lit(0)) > 0
    return j.withColumn("agreement", F.when(a & b, "both").when(a, "lasso only").when(b, "search only").otherwise("neither"))


def sets_from(spark, named: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), v) for k, v in named.items()], "combo_id string, size int, nodes array<string>")
