"""Similarity and conservation between the networks of groups. Pair tables have g1 < g2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import average_rank, safe_corr, z_score


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def paired(networks: DataFrame, *key: str) -> DataFrame:
    """(key, g1, g2, i, j, w1, w2) for every two groups; ``networks`` (key, grp, i, j, w) hold all pairs of nodes."""
    a = networks.select(*key, F.col("grp").alias("g1"), "i", "j", F.col("w").alias("w1"))
    b = networks.select(*key, F.col("grp").alias("g2"), "i", "j", F.col("w").alias("w2"))
    return a.join(b, [*key, "i", "j"]).where("g1 < g2")


def binary_similarity(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(method, g1, g2, ...) of the edge sets abs(r) > threshold: Jaccard, overlap, counts, preservation both ways."""
    e = corr.select("method", "grp", "i", "j", (F.abs("r") > threshold).cast("int").alias("w"))
    p = paired(e, "method").groupBy("method", "g1", "g2").agg(F.sum(F.col("w1") * F.col("w2")).alias("shared"), F.sum(F.greatest("w1", "w2")).alias("either"), F.sum("w1").alias("edges1"), F.sum("w2").alias("edges2"))
    s = F.col("shared").cast("double")
    return p.select("*", ratio(s, F.col("either")).alias("jaccard"), ratio(s, F.least("edges1", "edges2")).alias("overlap"), ratio(s, F.col("edges1")).alias("preserved_1_2"), ratio(s, F.col("edges2")).alias("preserved_2_1"))


def weighted_similarity(corr: DataFrame) -> DataFrame:
    """(method, g1, g2, ...) of abs(r): sums of min over max, overlap, Pearson, preservation, mean difference, totals."""
    w = corr.select("method", "grp", "i", "j", F.coalesce(F.abs("r"), F.lit(0.0)).alias("w"))
    p = paired(w, "method").groupBy("method", "g1", "g2").agg(
        F.sum(F.least("w1", "w2")).alias("low"), F.sum(F.greatest("w1", "w2")).alias("high"), F.sum("w1").alias("total1"), F.sum("w2").alias("total2"), F.avg(F.abs(F.col("w1") - F.col("w2"))).alias("mean_difference"), safe_corr("w1", "w2").alias("correlation")
    )
    return p.select("method", "g1", "g2", ratio(F.col("low"), F.col("high")).alias("weighted_jaccard"), ratio(F.col("low"), F.least("total1", "total2")).alias("overlap"), "correlation", ratio(F.col("low"), F.col("total1")).alias("preserved_1_2"), ratio(F.col("low"), F.col("total2")).alias("preserved_2_1"), "mean_difference", "total1", "total2")


def hub_conservation(table: DataFrame, value: str, top_n: int = 5, by_set: bool = True) -> DataFrame:
    """(method, g1, g2, shared, conservation): shared top-n nodes over the smaller set (``by_set``) or over n.

    Without ``by_set`` a pair in which a group has fewer than n nodes is 0.
    """
    place = F.row_number().over(Window.partitionBy("method", "grp").orderBy(F.col(value).desc(), "node"))
    top = table.withColumn("place", place).where(F.col("place") <= top_n).groupBy("method", "grp").agg(F.collect_set("node").alias("hubs"))
    a, b = top.toDF("method", "g1", "h1"), top.toDF("method", "g2", "h2")
    p = a.join(b, "method").where("g1 < g2").withColumn("shared", F.size(F.array_intersect("h1", "h2")))
    smaller = F.least(F.size("h1"), F.size("h2"))
    score = ratio(F.col("shared").cast("double"), smaller) if by_set else F.when(smaller < top_n, F.lit(0.0)).otherwise(F.col("shared") / F.lit(float(top_n)))
    return p.select("method", "g1", "g2", "shared", score.alias("conservation"))


def conserved_edges(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(method, i, j, n_groups, share, full, majority) of edges that some group has."""
    n = corr.groupBy("method").agg(F.countDistinct("grp").alias("all"))
    e = corr.where(F.abs("r") > threshold).groupBy("method", "i", "j").agg(F.count(F.lit(1)).alias("n_groups")).join(F.broadcast(n), "method")
    return e.select("method", "i", "j", "n_groups", (F.col("n_groups") / F.col("all")).alias("share"), (F.col("n_groups") == F.col("all")).alias("full"), (F.col("n_groups") >= F.ceil(F.col("all") / 2)).alias("majority"))


def edge_weight_statistics(corr: DataFrame) -> DataFrame:
    """(method, grp, ...) of abs(r)."""
    w = corr.select("method", "grp", F.abs("r").alias("w"))
    return w.groupBy("method", "grp").agg(F.avg("w").alias("mean"), F.median("w").alias("median"), F.stddev_samp("w").alias("sd"), F.min("w").alias("min"), F.max("w").alias("max"), F.sum("w").alias("sum"), F.count("w").alias("count"), F.count_if(F.col("w") > 0.3).alias("over_03"), F.count_if(F.col("w") > 0.5).alias("over_05"), F.count_if(F.col("w") > 0.7).alias("over_07"))


def network_similarity(corr: DataFrame, degrees: DataFrame, globals_: DataFrame, threshold: float) -> DataFrame:
    """(method, g1, g2, jaccard, dice, degree_correlation, density_difference, clustering_difference).

    ``degrees`` (method, grp, node, degree), ``globals_`` (method, grp, density, clustering). Degrees compare by
    Spearman over common nodes, more than 2; a side without edges gives Jaccard and Dice 0.
    """
    e = corr.select("method", "grp", "i", "j", (F.abs("r") >= threshold).cast("int").alias("w"))
    s = paired(e, "method").groupBy("method", "g1", "g2").agg(F.sum(F.col("w1") * F.col("w2")).alias("shared"), F.sum("w1").alias("n1"), F.sum("w2").alias("n2"))
    x = F.col("shared").cast("double")
    s = s.withColumn("jaccard", ratio(x, F.col("n1") + F.col("n2") - F.col("shared"))).withColumn("dice", ratio(2 * x, F.col("n1") + F.col("n2")))
    ranks = degrees.withColumn("rank", average_rank("degree", "method", "grp"))
    a = ranks.select("method", "node", F.col("grp").alias("g1"), F.col("rank").alias("x"))
    b = ranks.select("method", "node", F.col("grp").alias("g2"), F.col("rank").alias("y"))
    d = a.join(b, ["method", "node"]).where("g1 < g2").groupBy("method", "g1", "g2").agg(F.when(F.count(F.lit(1)) > 2, safe_corr("x", "y")).alias("degree_correlation"))
    g = globals_.select("method", "grp", "density", "clustering")
    both = s.join(d, ["method", "g1", "g2"], "left").join(F.broadcast(g.toDF("method", "g1", "d1", "c1")), ["method", "g1"]).join(F.broadcast(g.toDF("method", "g2", "d2", "c2")), ["method", "g2"])
    return both.select("method", "g1", "g2", "jaccard", "dice", "degree_correlation", F.abs(F.col("d1") - F.col("d2")).alias("density_difference"), F.abs(F.col("c1") - F.col("c2")).alias("clustering_difference"))


def similarity_over_methods(similarity: DataFrame) -> DataFrame:
    """Means and deviations of network_similarity() over the methods."""
    cols = ["jaccard", "dice", "degree_correlation", "density_difference", "clustering_difference"]
    return similarity.groupBy("g1", "g2").agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def metric_aggregation(globals_: DataFrame, metrics: list[str]) -> DataFrame:
    """(grp, metric, mean, sd, cv, min, max, range, n_methods, robustness) over methods, finite values only."""
    long = globals_.select("method", "grp", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["method", "grp"], metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    s = long.groupBy("grp", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_methods"))
    s = s.withColumn("cv", F.abs(F.try_divide("sd", "mean"))).withColumn("range", F.col("max") - F.col("min"))
    return s.withColumn("robustness", F.when(F.col("cv") <= 0.15, "very high").when(F.col("cv") <= 0.30, "high").when(F.col("cv") <= 0.50, "moderate").when(F.col("cv").isNotNull(), "low"))


def thresholded_jaccard(networks: DataFrame, *key: str, threshold: float = 0.0) -> DataFrame:
    """(key, g1, g2, jaccard): sums of min over max, weights below the threshold counting 0; 0 for empty networks."""
    w = networks.withColumn("w", F.when(F.abs("w") >= threshold, F.abs("w")).otherwise(F.lit(0.0)))
    return paired(w, *key).groupBy(*key, "g1", "g2").agg(ratio(F.sum(F.least("w1", "w2")), F.sum(F.greatest("w1", "w2"))).alias("jaccard"))


def averaged_jaccard(networks: DataFrame, averaging: str = "balanced") -> DataFrame:
    """(g1, g2, jaccard) over all networks (matrix_key, approach, grp, i, j, w).

    ``balanced``: the mean of the approaches' means; ``flat``: the mean over all networks alike. Networks of fewer
    than 3 nodes don't count.
    """
    per = thresholded_jaccard(networks, "matrix_key", "approach")
    if averaging == "flat":
        return per.groupBy("g1", "g2").agg(F.avg("jaccard").alias("jaccard"))
    return per.groupBy("g1", "g2", "approach").agg(F.avg("jaccard").alias("jaccard")).groupBy("g1", "g2").agg(F.avg("jaccard").alias("jaccard"))


def persistence_auc_jaccard(networks: DataFrame) -> DataFrame:
    """(method, g1, g2, auc): trapezoid of Jaccard over the thresholds, per unit of threshold; two thresholds at least."""
    per = thresholded_jaccard(networks.where("approach = 'persistence'"), "method", "threshold")
    w = Window.partitionBy("method", "g1", "g2").orderBy("threshold")
    steps = per.select("*", F.lead("threshold").over(w).alias("next_t"), F.lead("jaccard").over(w).alias("next_j"))
    area = F.sum((F.col("next_t") - F.col("threshold")) * (F.col("jaccard") + F.col("next_j")) / 2)
    return steps.groupBy("method", "g1", "g2").agg((area / (F.max("threshold") - F.min("threshold"))).alias("auc"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def group_similarity_matrix(networks: DataFrame) -> DataFrame:
    """(g1, g2, similarity): both directions of the flat mean, and 1 for a group with itself."""
    flat = averaged_jaccard(networks, "flat")
    own = networks.select("grp").distinct().select(F.col("grp").alias("g1"), F.col("grp").alias("g2"), F.lit(1.0).alias("similarity"))
    return flat.toDF("g1", "g2", "similarity").unionByName(flat.toDF("g2", "g1", "similarity")).unionByName(own)


def regional_jaccard(networks: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, g1, g2, jaccard): rows of an area's nodes against all nodes; pairs inside an area count from both ends."""
    directed = networks.select("matrix_key", "grp", F.col("i").alias("node"), F.concat_ws("|", "i", "j").alias("pair"), "w").unionByName(networks.select("matrix_key", "grp", F.col("j").alias("node"), F.concat_ws("|", "i", "j").alias("pair"), "w"))
    rows = directed.join(F.broadcast(areas.select("area", "node")), "node").select("matrix_key", "area", "grp", F.col("node").alias("i"), F.col("pair").alias("j"), "w")
    per = paired(rows, "matrix_key", "area").groupBy("matrix_key", "area", "g1", "g2").agg(F.sum(F.least("w1", "w2")).alias("low"), F.sum(F.greatest("w1", "w2")).alias("high")).where("high > 0")
    return per.groupBy("area", "g1", "g2").agg(F.avg(F.col("low") / F.col("high")).alias("jaccard"))


def hub_sets(scores: DataFrame, value: str, z_threshold: float = 1.5, *key: str) -> DataFrame:
    """(key, node, z) of nodes whose z-score within ``key`` (sample deviation) reaches the threshold."""
    return scores.withColumn("z", z_score(value, *key)).where(F.col("z") >= z_threshold).select(*key, "node", "z")


def hub_overlap(hubs: DataFrame, groups: DataFrame) -> DataFrame:
    """(g1, g2, n1, n2, n_shared, n_either, jaccard, shared, only_1, only_2) of hub sets (grp, node); groups without
    hubs have the empty set, and two empty sets have Jaccard 0. ValueError for fewer than two groups."""
    if groups.count() < 2:
        raise ValueError("at least two groups are needed")
    sets = groups.join(hubs.groupBy("grp").agg(F.sort_array(F.collect_set("node")).alias("h")), "grp", "left").select("grp", F.coalesce("h", F.array().cast("array<string>")).alias("h"))
    p = sets.toDF("g1", "h1").join(F.broadcast(sets.toDF("g2", "h2")), F.col("g1") < F.col("g2"))
    shared, either = F.array_intersect("h1", "h2"), F.array_union("h1", "h2")
    text = lambda a: F.array_join(F.sort_array(a), ",")
    return p.select("g1", "g2", F.size("h1").alias("n1"), F.size("h2").alias("n2"), F.size(shared).alias("n_shared"), F.size(either).alias("n_either"), ratio(F.size(shared).cast("double"), F.size(either)).alias("jaccard"), text(shared).alias("shared"), text(F.array_except("h1", "h2")).alias("only_1"), text(F.array_except("h2", "h1")).alias("only_2"))
