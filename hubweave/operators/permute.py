"""Statistical tests. Permutations are ranks of a digest, so they agree wherever and however often they are drawn."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import t_two_sided
from hubweave.operators import graph_metrics, impute, spread
from hubweave.sources.scratch import settled


def required_permutations(n_tests: int, alpha: float = 0.05, safety: float = 2, least: int = 1000, most: int | None = None) -> dict:
    """{permutations, corrected_alpha, min_p}: enough that the smallest p-value can pass Bonferroni."""
    n = max(least, math.ceil(n_tests / alpha * safety))
    n = min(n, most) if most is not None else n
    return {"permutations": n, "corrected_alpha": alpha / n_tests, "min_p": 1 / (n + 1)}


def count_combinations(n: int, largest: int, smallest: int = 1) -> int:
    return sum(math.comb(n, k) for k in range(smallest, min(largest, n) + 1))


def shuffle_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


RANKED_APART = 64  # ranges of the digest within which a permutation's subjects are sorted


def permutations(subjects: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(perm, subject, side): 0 is the observed side, 1..count reshuffle sides (1 or 2) keeping their sizes.

    ``subjects`` (subject, side). The order of a permutation is that of md5(seed|perm|subject). A subject's place is its
    rank within the range of its digest's first two digits, plus the subjects of the ranges before: no task sorts a
    whole permutation.
    """
    digest = shuffle_key(F.lit(seed), F.col("perm"), F.col("subject"))
    drawn = subjects.select("subject", "side", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("perm")).withColumn("digest", digest)
    drawn = drawn.withColumn("range", F.floor(F.conv(F.substring("digest", 1, 2), 16, 10).cast("int") * RANKED_APART / 256))
    sizes = drawn.groupBy("perm", "range").agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("side") == 1).alias("first"))
    by = Window.partitionBy("perm")
    starts = sizes.select("perm", "range", (F.sum("own").over(by.orderBy("range")) - F.col("own")).alias("before"), F.sum("first").over(by).alias("n1"))
    place = F.row_number().over(Window.partitionBy("perm", "range").orderBy("digest", "subject"))
    drawn = drawn.withColumn("place", place).join(starts, ["perm", "range"]).select("perm", "subject", F.when(F.col("before") + F.col("place") <= F.col("n1"), 1).otherwise(2).alias("side"))
    return subjects.select(F.lit(0).alias("perm"), "subject", F.col("side").cast("int").alias("side")).unionByName(drawn)


def two_sample_test(values: DataFrame, count: int = 100, seed: int = 42, alternative: str = "two.sided") -> DataFrame:
    """(node, mean1, mean2, difference, p, cohens_d, null_low, null_high) per node of ``values`` (subject, side, node, value).

    p is the share of permutations at least as far out, without smoothing; the bounds are the 2.5 and 97.5 percent
    points of the permuted differences. A node without values on one side has nulls.
    """
    perms = permutations(values.select("subject", "side").distinct(), count, seed)
    sums = perms.join(values.select("subject", "node", "value"), "subject").groupBy("perm", "node").agg(*[f(F.when(F.col("side") == k, F.col("value"))).alias(f"{n}{k}") for k in (1, 2) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    diff = F.col("m1") - F.col("m2")
    seen = sums.where("perm = 0").select("node", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), diff.alias("difference"), F.try_divide(diff, F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))).alias("cohens_d"))
    null = sums.where("perm > 0").select("node", diff.alias("null")).join(seen.select("node", "difference"), "node")
    drawn, observed = F.round("null", 12), F.round("difference", 12)  # differences that are equal but for the order of their sums count
    far = {"two.sided": F.abs(drawn) >= F.abs(observed), "greater": drawn >= observed, "less": drawn <= observed}[alternative]
    p = null.groupBy("node").agg(F.avg(far.cast("double")).alias("p"), F.percentile("null", F.lit(0.025)).alias("null_low"), F.percentile("null", F.lit(0.975)).alias("null_high"))
    return seen.join(p, "node", "left")


def adjust(table: DataFrame, p: str = "p", method: str = "fdr", *by: str) -> DataFrame:
    """Adds p_adjusted: Benjamini-Hochberg, Bonferroni or none; null p-values stay and don't count."""
    known = F.count(p).over(Window.partitionBy(*by))
    if method == "none":
        return table.withColumn("p_adjusted", F.col(p))
    if method == "bonferroni":
        return table.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * known))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
    scaled = table.withColumn("_s", F.when(F.col(p).isNotNull(), F.col(p) * known / place))
    low = F.min("_s").over(Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return scaled.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low))).drop("_s")


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")


def effect_sizes(values: DataFrame) -> DataFrame:
    """(g1, g2, cohens_d) of ``values`` (grp, value): pooled, antisymmetric, every ordered pair of groups."""
    s = values.groupBy("grp").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
    a, b = s.toDF("g1", "m1", "v1", "n1"), s.toDF("g2", "m2", "v2", "n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return a.join(F.broadcast(b), F.col("g1") != F.col("g2")).select("g1", "g2", F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("cohens_d"))


def welch_t(stacks: DataFrame) -> DataFrame:
    """(i, j, t, df) of ``stacks`` (side, i, j, w), several matrices on each side."""
    s = stacks.groupBy("i", "j").agg(*[f(F.when(F.col("side") == k, F.col("w"))).alias(f"{n}{k}") for k in (1, 2) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return s.select("i", "j", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)).alias("t"), F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)).alias("df"))


def permuted_welch(stacks: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(perm, i, j, t) of ``stacks`` (matrix, side, i, j, w) with the matrices' sides reshuffled; t 0 where undefined."""
    perms = permutations(stacks.select(F.col("matrix").alias("subject"), "side").distinct(), count, seed)
    per = perms.join(stacks.select(F.col("matrix").alias("subject"), "i", "j", "w"), "subject").groupBy("perm", "i", "j").agg(*[f(F.when(F.col("side") == k, F.col("w"))).alias(f"{n}{k}") for k in (1, 2) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")))
    return per.select("perm", "i", "j", F.coalesce(t, F.lit(0.0)).alias("t"))


def strong_components(stacks: DataFrame, threshold: float = 3.0, count: int = 100, seed: int = 42) -> DataFrame:
    """(perm, node, component) of the edges with |t| > threshold, t to 9 decimals; all permutations spread together."""
    edges = permuted_welch(stacks, count, seed).where(F.abs(F.round("t", 9)) > threshold)
    return spread.components(edges.select("perm", F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w")), ("perm",))


def largest_components(found: DataFrame, count: int) -> DataFrame:
    """(perm, largest): nodes of the largest component of each permutation, 0 (observed) to ``count``; single nodes count as 1."""
    size = found.groupBy("perm", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("perm").agg(F.max("n").alias("largest"))
    return found.sparkSession.range(count + 1).select(F.col("id").cast("int").alias("perm")).join(size, "perm", "left").select("perm", F.coalesce("largest", F.lit(1).cast("long")).alias("largest"))


def network_based_statistic(stacks: DataFrame, threshold: float = 3.0, count: int = 100, seed: int = 42) -> DataFrame:
    """(perm, largest): nodes of the largest component of edges with |t| > threshold; perm 0 is observed."""
    return largest_components(settled(strong_components(stacks, threshold, count, seed)), count)


def component_tests(stacks: DataFrame, threshold: float = 3.0, count: int = 100, seed: int = 42) -> DataFrame:
    """(component, node, size, p, significant): the observed components of two nodes or more with their members.

    p is the share of permutations whose largest component has as many nodes; a component is significant if it has
    more than the 95 percent point of these sizes.
    """
    found = settled(strong_components(stacks, threshold, count, seed))
    null = largest_components(found, count).where("perm > 0")
    seen = found.where("perm = 0").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component")))
    sizes = seen.select("size").distinct()
    p = sizes.join(null.groupBy("largest").agg(F.count(F.lit(1)).alias("n")), F.col("largest") >= F.col("size"), "left").groupBy("size").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(count))).alias("p"))
    bar = null.agg(F.percentile("largest", F.lit(0.95)).alias("bar"))
    return seen.join(p, "size").crossJoin(F.broadcast(bar)).select("component", "node", "size", "p", (F.col("size") > F.col("bar")).alias("significant"))


def family_wise_p(null: DataFrame, stat: str) -> DataFrame:
    """(observed, p): share of permutations whose statistic reaches that of perm 0."""
    seen = null.where("perm = 0").agg(F.max(stat).alias("observed"))
    return null.where("perm > 0").crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), F.avg((F.col(stat) >= F.col("observed")).cast("double")).alias("p"))


def compare_groups(values: DataFrame, hubs: DataFrame, count: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(node metric tests, hub overlap) of two groups' networks.

    ``values`` (side, node, metric, value): each metric's node values are tested between the sides by
    two_sample_test(), a node of a side being a subject. ``hubs`` (side, node): (n_common, n_only_1, n_only_2, jaccard,
    common, only_1, only_2); no hubs at all have Jaccard null.
    """
    rows = values.select(F.concat_ws("/", F.col("side").cast("string"), "node").alias("subject"), "side", F.col("metric").alias("node"), "value")
    tests = two_sample_test(rows, count, seed).withColumnRenamed("node", "metric")
    own = lambda k: F.array_sort(F.coalesce(F.collect_set(F.when(F.col("side") == k, F.col("node"))), F.array().cast("array<string>")))
    sets = hubs.agg(own(1).alias("a"), own(2).alias("b"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    both, one, two, either = F.array_intersect("a", "b"), F.array_except("a", "b"), F.array_except("b", "a"), F.array_union("a", "b")
    overlap = sets.select(F.size(both).alias("n_common"), F.size(one).alias("n_only_1"), F.size(two).alias("n_only_2"), F.try_divide(F.size(both).cast("double"), F.size(either)).alias("jaccard"), text(both).alias("common"), text(one).alias("only_1"), text(two).alias("only_2"))
    return tests, overlap


GLOBAL_METRICS = ("density", "clustering", "path_length", "modularity")


RANK_RUN = 4096  # subjects of one node that are ranked in one group
RANK_BLOCK = 1024  # subjects, about, whose ranks are multiplied in one group


def _side_one(sides: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whether a subject is on side 1, a row per subject and a column per permutation, of strings of sides."""
    return np.frombuffer("".join(sides.to_pylist()).encode(), np.uint8).reshape(-1, width) == ord("1")


def _run_sizes(width: int):
    def run(table: pa.Table) -> pa.Table:
        one = _side_one(table["sides"], width)
        return pa.table({"node": table["node"][:1], "run": table["run"][:1], "ones": pa.array([one.sum(0)], pa.list_(pa.int64())), "n": pa.array([len(one)], pa.int64())})

    return run


def _run_starts(table: pa.Table) -> pa.Table:
    table = table.sort_by("run")
    ones, n = np.array(table["ones"].to_pylist()), table["n"].to_numpy()
    return pa.table({"node": table["node"], "run": table["run"], "ones": pa.array(list(np.cumsum(ones, 0) - ones), pa.list_(pa.int64())), "n": pa.array(np.cumsum(n) - n)})


def _side_ranks(width: int):
    """Twice the average rank of each subject among those of its side, per permutation; negative on side 2."""

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("value")
        v, one = table["value"].to_numpy(), _side_one(table["sides"], width)
        at = np.arange(len(v))
        new = np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))]
        first = np.maximum.accumulate(np.where(new, at, 0))
        last = np.r_[np.flatnonzero(new)[1:], len(v)][np.cumsum(new) - 1]
        seen = np.vstack([np.zeros((1, width), np.int64), np.cumsum(one, 0)])
        before = np.array(start["ones"][0].as_py())
        ones = 2 * before + seen[first] + seen[last]
        others = 2 * (start["n"][0].as_py() - before) + (first + last)[:, None] - seen[first] - seen[last]
        ranks = np.where(one, ones + 1, -(others + 1)).astype(np.int32)
        return pa.table({"subject": table["subject"], "node": table["node"], "ranks": pa.array([r.tobytes() for r in ranks], pa.binary())})

    return run


def _rank_sums(p: int, width: int):
    """Per permutation, both sides' subjects and sums of products of ranks of one block of subjects."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("subject", "ascending"), ("node", "ascending")])
        ranks = np.frombuffer(b"".join(table["ranks"].to_pylist()), np.int32).reshape(-1, p, width)
        loads = []
        for perm in range(width):
            x = ranks[:, :, perm].astype(float)
            sides = [x[x[:, 0] > 0], x[x[:, 0] < 0]]
            loads.append(b"".join(np.r_[len(v), (v.T @ v).ravel()].tobytes() for v in sides))
        return pa.table({"perm": pa.array(np.arange(width), pa.int32()), "load": pa.array(loads, pa.binary())})

    return run


def _rank_r(p: int):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(load, float).reshape(2, -1) for load in table["load"].to_pylist())
        i, j = np.triu_indices(p, 1)
        out = []
        for side, sums in enumerate(total, 1):
            n = sums[0]
            if n == 0:
                continue
            # ranks have the mean (n + 1) / 2, twice them n + 1
            c = sums[1:].reshape(p, p) - n * (n + 1) ** 2
            flat = np.diag(c) <= 0
            r = np.divide(c[i, j], np.sqrt(np.maximum(np.diag(c)[i] * np.diag(c)[j], 0)), out=np.zeros(len(i)), where=~(flat[i] | flat[j]))
            out.append(pa.table({"perm": pa.array([table["perm"][0].as_py()] * len(i), pa.int32()), "side": pa.array([side] * len(i), pa.int32()), "a": pa.array(i, pa.int32()), "b": pa.array(j, pa.int32()), "r": pa.array(r, pa.float64(), mask=flat[i] | flat[j])}))
        return pa.concat_tables(out)

    return run


def permuted_rank_correlations(rows: DataFrame, nodes: list[str], count: int, seed: int) -> DataFrame:
    """(perm, side, i, j, r): Spearman's over complete subjects (subject, side, values), subjects reshuffled.

    A node's values are sorted once for all permutations: they are cut into runs of equal or neighbouring values, and a
    subject's rank on its side is what the runs before hold of that side plus its place in its own run.
    """
    p, width = len(nodes), count + 1
    sides = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("perm", "side"))), lambda s: s["side"].cast("string")), "")
    drawn = permutations(rows.select("subject", "side"), count, seed).groupBy("subject").agg(sides.alias("sides"))
    long = impute.complete_cases(rows).select("subject", F.posexplode("values").alias("node", "value")).withColumn("value", F.col("value") + F.lit(0.0))
    run = F.floor((F.rank().over(Window.partitionBy("node").orderBy("value")) - 1) / RANK_RUN)
    held = settled(long.withColumn("run", run).join(drawn, "subject").select("subject", "node", "run", "value", "sides"))
    sizes = held.groupBy("node", "run").applyInArrow(_run_sizes(width), "node int, run long, ones array<long>, n long")
    starts = sizes.groupBy("node").applyInArrow(_run_starts, "node int, run long, ones array<long>, n long")
    ranks = held.groupBy("node", "run").cogroup(starts.groupBy("node", "run")).applyInArrow(_side_ranks(width), "subject long, node int, ranks binary")
    blocks = max(1, math.ceil(rows.count() / RANK_BLOCK))
    sums = ranks.withColumn("block", F.pmod(F.xxhash64("subject"), F.lit(blocks))).groupBy("block").applyInArrow(_rank_sums(p, width), "perm int, load binary")
    r = sums.groupBy("perm").applyInArrow(_rank_r(p), "perm int, side int, a int, b int, r double")
    names = F.array(*[F.lit(n) for n in nodes])
    return r.select("perm", "side", F.get(names, F.col("a")).alias("i"), F.get(names, F.col("b")).alias("j"), F.round("r", 12).alias("r"))


def permuted_correlations(rows: DataFrame, nodes: list[str], method: str, count: int, seed: int) -> DataFrame:
    """(perm, side, i, j, r) by any of correlate's methods, subjects (subject, side, values) reshuffled.

    Both sides of every permutation are the groups of one correlation table. Where a side is too small for ``partial``
    (or its matrix singular), Pearson's stands in, as for the biweight method over complete pairs.
    """
    from hubweave.operators import correlate

    if method not in (*correlate.METHODS, "bicor"):
        raise ValueError(f"unknown method {method}")
    if method == "spearman":
        return permuted_rank_correlations(rows, nodes, count, seed)
    perms = permutations(rows.select("subject", "side"), count, seed)
    grouped = perms.join(rows.select("subject", "values"), "subject").select(F.concat_ws("|", F.col("perm").cast("string"), F.col("side").cast("string")).alias("grp"), "subject", "values")
    found = getattr(correlate, method)(grouped, nodes)
    if method in ("partial", "shrinkage"):
        found = settled(found)
        found = found.unionByName(correlate.biweight(grouped, nodes).join(found.select("grp").distinct(), "grp", "left_anti"))
    side = F.split("grp", "[|]")
    return found.select(side[0].cast("int").alias("perm"), side[1].cast("int").alias("side"), "i", "j", "r")


def global_networks(rows: DataFrame, nodes: list[str], cut: float, count: int, seed: int, areas: DataFrame | None, method: str = "pearson") -> DataFrame:
    """(perm, side, density, clustering, path_length, modularity) of both sides' networks |r| >= cut, subjects reshuffled.

    Networks are binary. Clustering is the mean over all nodes of the linked share of their pairs of neighbours;
    path_length the mean number of hops, null for a network in several pieces; modularity that of the ``areas``
    (node, area), null without them or without edges. Each metric is one aggregation or loop over all networks.
    """
    key = ("perm", "side")
    r = permuted_correlations(rows, nodes, method, count, seed)
    edges = settled(r.where(F.abs("r") >= cut).select(*key, F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w")))
    names = F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node")
    all_nodes = edges.sparkSession.range(count + 1).select(F.col("id").cast("int").alias("perm"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side")).select(*key, names)
    density = graph_metrics.density(edges, all_nodes, key).select(*key, "density")
    clustering = graph_metrics.local_clustering(edges, all_nodes, key).groupBy(*key).agg(F.avg("clustering").alias("clustering"))
    paths = spread.path_metrics(edges, all_nodes, key, hops=True)[0].select(*key, F.when(F.col("connected"), F.col("path_length")).alias("path_length"))
    out = density.join(clustering, list(key)).join(paths, list(key))
    if areas is None:
        return out.withColumn("modularity", F.lit(None).cast("double"))
    own = all_nodes.join(areas.select("node", F.col("area").alias("community")), "node")
    return out.join(graph_metrics.modularity(edges, own, key), list(key), "left")


def global_test(rows: DataFrame, nodes: list[str], cut: float = 0.1, count: int = 50, seed: int = 42, areas: DataFrame | None = None, method: str = "pearson") -> DataFrame:
    """(metric, value1, value2, difference, p, n_null): both sides' global metrics and the share of permutations whose
    difference is as large; metrics that a network doesn't have don't count.

    ``rows`` (subject, side, values); three subjects a side at least, else ValueError.
    """
    n = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
    if min(n.get(1, 0), n.get(2, 0)) < 3:
        raise ValueError("at least 3 subjects a group are needed")
    found = global_networks(rows, nodes, cut, count, seed, areas, method).unpivot(["perm", "side"], list(GLOBAL_METRICS), "metric", "value")
    two = settled(found.groupBy("perm", "metric").agg(F.max(F.when(F.col("side") == 1, F.col("value"))).alias("value1"), F.max(F.when(F.col("side") == 2, F.col("value"))).alias("value2")).withColumn("difference", F.col("value1") - F.col("value2")))
    seen = two.where("perm = 0").drop("perm")
    null = two.where("perm > 0 and difference is not null").select("metric", F.col("difference").alias("null")).join(F.broadcast(seen.where("difference is not null").select("metric", "difference")), "metric")
    p = null.groupBy("metric").agg(F.avg((F.abs("null") >= F.abs("difference") - 1e-12).cast("double")).alias("p"), F.count(F.lit(1)).alias("n_null"))
    return seen.join(p, "metric", "left").select("metric", "value1", "value2", "difference", "p", F.coalesce("n_null", F.lit(0).cast("long")).alias("n_null"))


def global_density_test(rows: DataFrame, nodes: list[str], cut: float = 0.1, count: int = 50, seed: int = 42) -> DataFrame:
    """(perm, density1, density2, difference): share of pairs with |r| > cut on each side, subjects reshuffled.

    ``rows`` (subject, side, values); three subjects a side at least, else ValueError.
    """
    from hubweave.functions.stats import safe_corr
    from hubweave.operators.correlate import pair_values

    n = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
    if min(n.get(1, 0), n.get(2, 0)) < 3:
        raise ValueError("at least 3 subjects a group are needed")
    perms = permutations(rows.select("subject", "side"), count, seed)
    pairs = pair_values(perms.join(rows.select("subject", "values"), "subject"), nodes, keep=("perm", "side"))
    r = pairs.groupBy("perm", "side", "i", "j").agg(F.round(safe_corr("x", "y"), 12).alias("r"))
    d = r.groupBy("perm").agg(*[F.avg(F.when(F.col("side") == k, (F.abs("r") > cut).cast("double"))).alias(f"density{k}") for k in (1, 2)])
    return d.withColumn("difference", F.abs(F.col("density1") - F.col("density2")))


def with_p_values(table: DataFrame) -> DataFrame:
    """Adds p, the two-sided p-value of columns t and df."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    return table.withColumn("p", p("t", "df"))
