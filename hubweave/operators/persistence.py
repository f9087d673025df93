"""Networks over a sweep of thresholds: persistence, evolution and areas under curves.

Sweeps are long tables with an integer ``step`` (the key) and the threshold as a value; thresholds without any edge
appear in ``grid`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import average_rank
from hubweave.operators import graph_metrics, kernels, spread
from hubweave.sources.scratch import settled

KEY = ["method", "grp"]
SWEPT = ("method", "grp", "step", "threshold")


def threshold_grid(spark, start: float, by: float, count: int) -> DataFrame:
    """(step, threshold) = start + step * by."""
    return spark.range(count).select(F.col("id").cast("int").alias("step"), (F.lit(start) + F.col("id") * F.lit(by)).alias("threshold"))


def swept_edges(corr: DataFrame, grid: DataFrame) -> DataFrame:
    """Edges with abs(r) >= threshold at every step; one pass over the pairs."""
    w = corr.select(*KEY, F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("r").alias("w"))
    return w.join(F.broadcast(grid), F.col("w") >= F.col("threshold")).where("w > 0").select(*SWEPT, "src", "dst", "w")


def swept_nodes(corr: DataFrame, edges: DataFrame) -> DataFrame:
    """(swept key, node): all nodes at each step that has an edge."""
    return edges.select(*SWEPT).distinct().join(graph_metrics.nodes_of(corr), KEY)


def swept_degrees(corr: DataFrame, grid: DataFrame) -> DataFrame:
    edges = swept_edges(corr, grid)
    return graph_metrics.node_degrees(edges, swept_nodes(corr, edges), SWEPT)


def swept_scores(corr: DataFrame, grid: DataFrame) -> DataFrame:
    """swept_degrees() with the eigenvector of every network of the sweep, all in one loop."""
    edges = settled(swept_edges(corr, grid))
    nodes = settled(swept_nodes(corr, edges))
    return graph_metrics.node_degrees(edges, nodes, SWEPT).join(spread.eigenvector(edges, nodes, SWEPT), [*SWEPT, "node"])


def swept_node_metrics(corr: DataFrame, grid: DataFrame, nodes: list[str], weights: str | None = "length") -> DataFrame:
    return kernels.node_metrics(swept_edges(corr, grid), nodes, SWEPT, weights)


def swept_global_metrics(corr: DataFrame, grid: DataFrame, nodes: list[str], weights: str | None = "length") -> DataFrame:
    return kernels.global_metrics(swept_edges(corr, grid), nodes, SWEPT, weights)


def hub_persistence(swept: DataFrame, value: str, top_n: int = 10) -> DataFrame:
    """(method, grp, node, score, min_threshold, max_threshold, threshold_range): share of the non-empty thresholds at
    which a node is among the top n."""
    steps = swept.groupBy(*KEY).agg(F.countDistinct("step").alias("steps"))
    place = F.row_number().over(Window.partitionBy(*KEY, "step").orderBy(F.col(value).desc(), "node"))
    top = swept.withColumn("place", place).where(F.col("place") <= top_n)
    s = top.groupBy(*KEY, "node").agg(F.count(F.lit(1)).alias("n"), F.min("threshold").alias("min_threshold"), F.max("threshold").alias("max_threshold"))
    return s.join(F.broadcast(steps), KEY).select(*KEY, "node", (F.col("n") / F.col("steps")).alias("score"), "min_threshold", "max_threshold", (F.col("max_threshold") - F.col("min_threshold")).alias("threshold_range"))


def importance_evolution(swept: DataFrame, value: str, grid: DataFrame) -> DataFrame:
    """Per node: ranks (average ties) and standardised scores 1 - (rank - 1) / (n - 1) over the thresholds, stability
    1 - sd (two values or more), the share of all thresholds at which it appears, first and last of them."""
    by = [*KEY, "step"]
    r = swept.withColumn("rank", average_rank(value, *by, descending=True)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    r = r.withColumn("std", F.when(F.col("n") > 1, 1 - (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(F.lit(1.0)))
    s = r.groupBy(*KEY, "node").agg(F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.avg("std").alias("mean_score"), F.median("std").alias("median_score"), (1 - F.stddev_samp("std")).alias("stability"), F.count(F.lit(1)).alias("n"), F.min("threshold").alias("first"), F.max("threshold").alias("last"))
    total = grid.agg(F.count(F.lit(1)).alias("total"))
    return s.crossJoin(F.broadcast(total)).withColumn("persistence_rate", F.col("n") / F.col("total")).drop("n", "total")


def metrics_evolution(globals_: DataFrame) -> DataFrame:
    """Global metrics by threshold; empty thresholds have no row."""
    return globals_.select(*KEY, "threshold", "density", "clustering", F.col("path_length").alias("avg_path_length"), "modularity", F.col("n_components").alias("components"))


def aggregated_metrics(swept: DataFrame, globals_: DataFrame, values: tuple[str, ...] = ("strength",)) -> DataFrame:
    """(method, grp, node, mean_<value>..., stability, appearance_rate): node values over the thresholds at which the
    node has a row, weighed by clustering * density of the threshold's network.

    A weight that is not above 0 (or not finite) counts as 0.01; others, however small, count as they are. stability is
    the mean weight. Rows in which a value is not finite count for the appearance only. A node isolated at a threshold
    has a row there, so its rate is the share of the thresholds that have a network.
    """
    product = F.col("clustering") * F.col("density")
    steps = F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("steps")  # beside the weights, so that the networks' metrics are computed once
    weight = globals_.select(*SWEPT, F.when((product > 0) & (product < float("inf")), product).otherwise(F.lit(0.01)).alias("weight"), steps)
    finite = F.lit(True)
    for v in values:
        finite &= F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    j = swept.join(F.broadcast(weight), list(SWEPT)).withColumn("used", F.when(finite, F.col("weight")))
    means = [F.coalesce(F.sum(F.col(v) * F.col("used")) / F.sum("used"), F.lit(0.0)).alias(f"mean_{v}") for v in values]
    s = j.groupBy(*KEY, "node").agg(*means, F.coalesce(F.avg("used"), F.lit(0.0)).alias("stability"), F.count(F.lit(1)).alias("seen"), F.max("steps").alias("steps"))
    return s.select(*KEY, "node", *[f"mean_{v}" for v in values], "stability", (F.col("seen") / F.col("steps")).alias("appearance_rate"))


def trapezoid(table: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, auc, mean, sd) of ``value`` over ``threshold``; auc 0 for fewer than two thresholds."""
    w = Window.partitionBy(*key).orderBy("threshold")
    steps = table.select(*key, value, "threshold", F.lead("threshold").over(w).alias("nt"), F.lead(value).over(w).alias("nv"))
    area = F.sum((F.col("nt") - F.col("threshold")) * (F.col(value) + F.col("nv")) / 2)
    return steps.groupBy(*key).agg(F.coalesce(area, F.lit(0.0)).alias("auc"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def node_auc(swept: DataFrame, value: str) -> DataFrame:
    """AUC per node over thresholds with an edge."""
    return trapezoid(swept.select(*KEY, "node", "threshold", F.col(value).cast("double").alias(value)), value, *KEY, "node")


def zero_filled_auc(swept: DataFrame, value: str, nodes: DataFrame, grid: DataFrame) -> DataFrame:
    """AUC per node with 0 at every threshold where it is absent."""
    full = nodes.crossJoin(F.broadcast(grid)).join(swept.select(*KEY, "node", "step", F.col(value).cast("double").alias(value)), [*KEY, "node", "step"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    return trapezoid(full, value, *KEY, "node").select(*KEY, "node", "auc")
