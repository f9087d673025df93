"""Tables that users export or plot, made from the results of the other operators, and the drivers that collect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubweave.operators import similarity, threshold_free

KEY = ["method", "grp"]


def safe_filename(name: Column) -> Column:
    """``name`` with every character but letters and digits of ASCII as an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def method_agreement(hubs: DataFrame, methods: list[str], *key: str) -> DataFrame:
    """(key, node, one column of 0 or 1 per method): whether the method calls the node a hub."""
    flags = [F.max(F.when((F.col("method") == m) & F.col("is_hub"), 1).otherwise(0)).alias(m) for m in methods]
    return hubs.groupBy(*key, "node").agg(*flags)


def consensus_hubs(hubs: DataFrame, *key: str) -> DataFrame:
    """(key, node, n_hub, share): how many networks call a node a hub, and their share."""
    return hubs.groupBy(*key, "node").agg(F.count_if("is_hub").alias("n_hub"), F.avg(F.col("is_hub").cast("double")).alias("share"))


def hub_lists(hubs: DataFrame, *key: str) -> DataFrame:
    """(key, n_hubs, hubs): the hubs of each network by name, joined by commas."""
    named = F.sort_array(F.collect_list(F.when(F.col("is_hub"), F.col("node"))))
    return hubs.groupBy(*key).agg(F.count_if("is_hub").cast("long").alias("n_hubs"), F.array_join(named, ",").alias("hubs"))


def top_per_network(table: DataFrame, value: str, n: int, *key: str) -> DataFrame:
    """Adds place (from 1) and keeps the first ``n`` rows of each key by falling value, then by node."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.round(value, 9).desc(), "node"))
    return table.withColumn("place", place).where(F.col("place") <= n)


def top_overlaps(overlap: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` pairs of groups of the highest Jaccard similarity, ties in order of the groups."""
    return overlap.orderBy(F.round("jaccard", 9).desc(), "g1", "g2").limit(n)


def persistence_heatmap(swept: DataFrame, value: str, steps: int, cut: float = 0.1, top_n: int = 10) -> DataFrame:
    """(method, grp, node, score, s0, s1, ...): values by step, 0 where a node is absent; score is the share of steps
    whose value is above ``cut``. The ``top_n`` nodes of each network by score, then by name."""
    columns = [F.coalesce(F.max(F.when(F.col("step") == k, F.col(value))), F.lit(0.0)).alias(f"s{k}") for k in range(steps)]
    wide = swept.groupBy(*KEY, "node").agg(*columns)
    score = sum((F.when(F.col(f"s{k}") > cut, 1.0).otherwise(0.0) for k in range(steps)), F.lit(0.0)) / steps
    return top_per_network(wide.withColumn("score", score), "score", top_n, *KEY).drop("place")


def metric_variance(aggregated: DataFrame, n: int = 5, most_robust: bool = True) -> DataFrame:
    """The ``n`` metrics of each group with the smallest (or largest) CV over methods; metrics without a CV are left out."""
    cv = F.round("cv", 9)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(cv.asc() if most_robust else cv.desc(), "metric"))
    return aggregated.where("cv is not null").withColumn("place", place).where(F.col("place") <= n)


def regional_summary(a: DataFrame, b: DataFrame, areas: DataFrame) -> DataFrame:
    """(grp, area, n, q1_a, median_a, q3_a, q1_b, median_b, q3_b): two node values merged by a full outer join on
    (grp, node) and summarised by area; nodes of no area are in ``Other``."""
    both = a.select("grp", "node", F.col("value").alias("a")).join(b.select("grp", "node", F.col("value").alias("b")), ["grp", "node"], "full")
    named = both.join(areas.select("node", "area"), "node", "left").withColumn("area", F.coalesce("area", F.lit("Other")))
    boxes = [F.percentile(v, q).alias(f"{name}_{v}") for v in ("a", "b") for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return named.groupBy("grp", "area").agg(F.count(F.lit(1)).alias("n"), *boxes)


def conservation(corr: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5) -> dict[str, DataFrame]:
    """The conservation tables of thresholded networks: similarity and conserved edges.

    ``thresholds`` (method, grp, threshold) are those of the networks; a network without one is cut at ``default``.
    """
    if thresholds is None:
        cut = corr.withColumn("threshold", F.lit(default))
    else:
        cut = corr.join(thresholds.select(*KEY, "threshold"), KEY, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    edges = cut.select(*KEY, "i", "j", F.when(F.abs("r") > F.col("threshold"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("r"))
    return {"similarity": similarity.binary_similarity(edges, 0.5), "conserved_edges": similarity.conserved_edges(edges, 0.5)}


def weighted_conservation(corr: DataFrame) -> dict[str, DataFrame]:
    """The conservation tables of full networks: similarity, conserved strength hubs and edge weight statistics."""
    strength = threshold_free.node_strength(corr)
    return {"similarity": similarity.weighted_similarity(corr), "hubs": similarity.hub_conservation(strength, "node_strength"), "edge_weights": similarity.edge_weight_statistics(corr)}


def threshold_free_analysis(corr: DataFrame, nodes: list[str], analysis: str = "all") -> dict[str, DataFrame]:
    """The threshold-free tables: ``node_strength``, ``weighted_eigenvector``, or both with ``all``."""
    tables = {"node_strength": lambda: threshold_free.node_strength(corr), "weighted_eigenvector": lambda: threshold_free.weighted_eigenvector(corr)}
    if analysis != "all" and analysis not in tables:
        raise ValueError(f"analysis is one of all, {', '.join(tables)}")
    return {name: make() for name, make in tables.items() if analysis in ("all", name)}


def write_results(tables: dict[str, DataFrame], path: str, *by: str) -> None:
    """Each table as CSV with a header in a folder of its name, with folders by those of ``by`` that it has."""
    for name, table in tables.items():
        folders = [c for c in by if c in table.columns]
        writer = table.write.mode("overwrite").option("header", True)
        (writer.partitionBy(*folders) if folders else writer).csv(f"{path}/{name}")


def read_results(spark, path: str, schema, name: str) -> DataFrame:
    """A table that write_results() wrote, with its folders as columns again; columns and types as in ``schema``."""
    stored = spark.read.option("header", True).option("basePath", f"{path}/{name}").csv(f"{path}/{name}", inferSchema=False)
    named = {f.name: f.dataType for f in schema}
    return stored.select(*[F.col(c).cast(t).alias(c) for c, t in named.items()])
