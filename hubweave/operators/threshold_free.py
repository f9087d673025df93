"""Threshold-free analyses of full networks: eigenvector tables, strengths, hubs, and comparisons with thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import min_rank, safe_corr
from hubweave.operators import graph_metrics, network, spread
from hubweave.sources.scratch import settled

KEY = ["method", "grp"]


def node_strength(corr: DataFrame) -> DataFrame:
    """(method, grp, node, node_strength, normalized_strength, strength_rank) over all pairs."""
    s = graph_metrics.doubled(network.full_network(corr)).groupBy(*KEY, "node").agg(F.sum("w").alias("node_strength"), F.avg("w").alias("avg_edge_weight"), F.count(F.lit(1)).alias("others"))
    s = s.withColumn("normalized_strength", F.col("node_strength") / F.col("others"))
    return s.withColumn("strength_rank", min_rank("node_strength", *KEY)).drop("others")


def weighted_eigenvector(corr: DataFrame) -> DataFrame:
    """(method, grp, node, weighted_eigenvector, node_strength, avg_edge_weight, weighted_rank); ranks to 9 decimals."""
    edges = network.full_network(corr.where("r is not null")).where("w > 0")
    values = spread.eigenvector(edges, graph_metrics.nodes_of(corr)).withColumnRenamed("eigenvector", "weighted_eigenvector")
    s = node_strength(corr).select(*KEY, "node", "node_strength", "avg_edge_weight")
    ranked = values.join(s, [*KEY, "node"]).withColumn("_e", F.round("weighted_eigenvector", 9))
    return ranked.withColumn("weighted_rank", min_rank("_e", *KEY)).drop("_e")


def spanning_trees(corr: DataFrame) -> DataFrame:
    """(method, grp, src, dst, w) of the minimum spanning forests over distances 1 - abs(r); a distance of 0 is no edge."""
    edges = corr.where("r is not null").select(*KEY, F.col("i").alias("src"), F.col("j").alias("dst"), (1 - F.abs("r")).alias("w")).where("w > 0")
    return settled(spread.spanning_forest(edges).drop("turn"))


def tree_central_nodes(trees: DataFrame, top_n: int = 5) -> DataFrame:
    """(method, grp, node, degree, strength, place): the nodes of most tree edges, by degree and then by name."""
    ends = trees.select(*KEY, F.explode(F.array("src", "dst")).alias("node"), "w").groupBy(*KEY, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("degree").desc(), "node"))
    return ends.withColumn("place", place).where(F.col("place") <= top_n)


def tree_summary(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, grp, n_edges, diameter, mean_path, total_weight, avg_weight, max_degree); mean_path infinite and diameter 0 for a forest."""
    sums = trees.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("total_weight"), F.avg("w").alias("avg_weight"))
    degree = trees.select(*KEY, F.explode(F.array("src", "dst")).alias("node")).groupBy(*KEY, "node").count().groupBy(*KEY).agg(F.max("count").alias("max_degree"))
    paths = spread.path_metrics(trees, nodes)[0].select(*KEY, "diameter", F.col("path_length").alias("mean_path"))
    return sums.join(paths, KEY).join(degree, KEY).select(*KEY, "n_edges", "diameter", "mean_path", "total_weight", "avg_weight", "max_degree")


def centrality_spread(table: DataFrame, value: str) -> DataFrame:
    """(method, node, mean, sd, cv, min, max, range, n_groups) of nodes of two groups or more."""
    s = table.groupBy("method", "node").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_groups")).where("n_groups >= 2")
    return s.withColumn("cv", F.try_divide("sd", "mean")).withColumn("range", F.col("max") - F.col("min"))


def pick_hubs(table: DataFrame, value: str, top_n: int = 10, threshold: float = 0.8) -> DataFrame:
    """(method, grp, node): the top n of a group, and every node of at least ``threshold``."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(value).desc(), "node"))
    return table.withColumn("place", place).where((F.col("place") <= top_n) | (F.col(value) >= threshold)).select(*KEY, "node", value)


def combined_centrality(percolation: DataFrame, weighted: DataFrame) -> DataFrame:
    """(method, grp, node, percolation, weighted, geometric, variance_weighted, rank, percolation_rank, difference).

    Both inputs have (method, grp, node, value); a missing weighted value is 0. Each side weighs its variance.
    """
    j = percolation.withColumnRenamed("value", "percolation").join(weighted.withColumnRenamed("value", "weighted"), [*KEY, "node"], "left").withColumn("weighted", F.coalesce("weighted", F.lit(0.0)))
    w = Window.partitionBy(*KEY)
    vp, vw = F.coalesce(F.var_samp("percolation").over(w), F.lit(0.0)), F.coalesce(F.var_samp("weighted").over(w), F.lit(0.0))
    j = j.withColumn("vp", vp).withColumn("vw", vw)
    mixed = F.coalesce(F.try_divide(F.col("vp") * F.col("percolation") + F.col("vw") * F.col("weighted"), F.col("vp") + F.col("vw")), (F.col("percolation") + F.col("weighted")) / 2)
    j = j.withColumn("geometric", F.sqrt(F.col("percolation") * F.col("weighted"))).withColumn("variance_weighted", mixed).drop("vp", "vw")
    j = j.withColumn("rank", min_rank("variance_weighted", *KEY)).withColumn("percolation_rank", min_rank("percolation", *KEY))
    return j.withColumn("difference", F.col("percolation_rank") - F.col("rank"))


def cross_method_nodes(weighted: DataFrame, percolation: DataFrame) -> DataFrame:
    """(method, grp, node, weighted, percolation, difference, ratio): nodes of both; no ratio to 0 or less."""
    j = weighted.withColumnRenamed("value", "weighted").join(percolation.withColumnRenamed("value", "percolation"), [*KEY, "node"])
    return j.withColumn("difference", F.col("weighted") - F.col("percolation")).withColumn("ratio", F.when(F.col("percolation") > 0, F.col("weighted") / F.col("percolation")))


def cross_method_correlation(joined: DataFrame) -> DataFrame:
    """(method, grp, n, r) between the two columns, more than 2 nodes."""
    return joined.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), safe_corr("weighted", "percolation").alias("r")).where("n > 2")
