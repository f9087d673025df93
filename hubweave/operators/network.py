"""Thresholds and networks: edge tables (method, grp, ..., src, dst, w) from correlation tables, w = abs(r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.operators import graph_metrics, spread
from hubweave.sources.scratch import settled

GRID = 95  # thresholds 0.01 .. 0.95


def percolation_curve(corr: DataFrame) -> DataFrame:
    """(method, grp, step, threshold, giant, n_components, density) on the grid of step / 100.

    The maximum spanning forest joins the same nodes at every threshold as all edges do, so components are those of
    its edges (n - 1 at most), of all networks and thresholds in one loop. Densities are running counts of the pairs by
    the last step that they reach.
    """
    return _curve(corr, strongest_forest(corr))


def strongest_forest(corr: DataFrame) -> DataFrame:
    """(method, grp, src, dst, w): maximum spanning forests over abs(r)."""
    return settled(spread.spanning_forest(full_network(corr.where("r is not null")), largest=True).drop("turn"))


def _curve(corr: DataFrame, forest: DataFrame) -> DataFrame:
    k = ["method", "grp"]
    w = full_network(corr.where("r is not null"))
    sizes = graph_metrics.nodes_of(corr).groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    grid = corr.sparkSession.range(1, GRID + 1).select(F.col("id").cast("int").alias("step"), (F.col("id") / 100.0).alias("threshold"))
    strong = settled(forest.join(F.broadcast(grid), F.col("w") >= F.col("threshold")))
    key = (*k, "step")
    merged = strong.groupBy(*key).agg(F.count(F.lit(1)).alias("merged"))
    giant = spread.components(strong, key).groupBy(*key, "component").agg(F.count(F.lit(1)).alias("giant")).groupBy(*key).agg(F.max("giant").alias("giant"))
    last = F.least(F.floor(F.round(F.col("w") * 100, 10)), F.lit(GRID)).cast("int")
    counts = w.groupBy(*k, last.alias("step")).agg(F.count(F.lit(1)).alias("own"))
    per = sizes.select(*k, "n", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("step")).join(counts, [*key], "left").join(merged, [*key], "left").join(giant, [*key], "left")
    edges = F.sum(F.coalesce("own", F.lit(0))).over(Window.partitionBy(*k).orderBy(F.col("step").desc()))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return per.select(
        *k, "step", (F.col("step") / 100.0).alias("threshold"), (F.coalesce("giant", F.lit(1)) / F.col("n")).alias("giant"),
        (F.col("n") - F.coalesce("merged", F.lit(0))).cast("int").alias("n_components"), F.coalesce(F.try_divide(edges, pairs), F.lit(0.0)).alias("density"),
    )


def percolation_thresholds(corr: DataFrame) -> DataFrame:
    """(method, grp, threshold): the highest grid point that keeps the graph in one piece, or else 98% of the largest
    giant fraction; 0.95 without any edge.

    A forest that is one tree falls apart above its weakest edge; only for other networks the curve is needed.
    """
    k = ["method", "grp"]
    forest = strongest_forest(corr)
    trees = forest.groupBy(*k).agg(F.count(F.lit(1)).alias("edges"), F.least(F.floor(F.round(F.min("w") * 100, 10)), F.lit(GRID)).alias("last"))
    sizes = graph_metrics.nodes_of(corr).groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    known = settled(sizes.join(trees, k, "left").withColumn("whole", F.coalesce((F.col("edges") == F.col("n") - 1) & (F.col("last") >= 1), F.lit(False))))
    whole = known.where("whole").select(*k, (F.col("last") / 100.0).alias("threshold"))
    rest = known.where("not whole").select(*k)
    if rest.isEmpty():
        return whole
    curve = settled(_curve(corr.join(rest, k, "left_semi"), forest.join(rest, k, "left_semi")))
    best = curve.groupBy(*k).agg(F.max("giant").alias("best"), F.max("density").alias("dense"))
    need = F.when(F.col("best") == 1, F.lit(1.0)).otherwise(0.98 * F.col("best"))
    hit = curve.join(best, k).where((F.col("giant") >= need) | (F.col("dense") == 0))
    return whole.unionByName(hit.groupBy(*k).agg(F.max("threshold").alias("threshold")))


def threshold_network(corr: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Edges with abs(r) >= threshold: a number, or a table (method, grp, threshold). Zero weights are no edges."""
    if threshold is None:
        raise ValueError("a threshold is needed")
    w = corr.select("method", "grp", F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("r").alias("w"))
    joined = w.join(F.broadcast(threshold), ["method", "grp"]) if isinstance(threshold, DataFrame) else w.withColumn("threshold", F.lit(float(threshold)))
    return joined.where("w >= threshold and w > 0").select("method", "grp", "threshold", "src", "dst", "w")


def full_network(corr: DataFrame) -> DataFrame:
    return corr.select("method", "grp", F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("r").alias("w"))


def all_networks(corr: DataFrame, thresholds: DataFrame, grid: list[float]) -> DataFrame:
    """(matrix_key, method, approach, threshold, grp, i, j, w): weighted, percolation and persistence networks as full
    upper triangles; w is 0 where a network has no edge."""
    w = corr.where("r is not null").select("method", "grp", "i", "j", F.abs("r").alias("w"))
    weighted = w.select(F.concat("method", F.lit("_weighted")).alias("matrix_key"), "method", F.lit("weighted").alias("approach"), F.lit(None).cast("double").alias("threshold"), "grp", "i", "j", "w")
    cut = F.when(F.col("w") >= F.col("threshold"), F.col("w")).otherwise(F.lit(0.0))
    percolation = w.join(F.broadcast(thresholds), ["method", "grp"]).select(F.concat("method", F.lit("_percolation")).alias("matrix_key"), "method", F.lit("percolation").alias("approach"), "threshold", "grp", "i", "j", cut.alias("w"))
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(grid)])
    swept = w.select("*", F.explode(points).alias("p")).select("method", "grp", "i", "j", "w", F.col("p.t").alias("threshold"), F.concat("method", F.lit("_persistence_"), F.format_string("%.3f", F.col("p.t"))).alias("matrix_key"))
    persistence = swept.select("matrix_key", "method", F.lit("persistence").alias("approach"), "threshold", "grp", "i", "j", cut.alias("w"))
    return weighted.unionByName(percolation).unionByName(persistence)


def matched_persistence(networks: DataFrame, g1: str, g2: str) -> DataFrame:
    """(method, threshold, i, j, w1, w2) of persistence networks that both groups have."""
    p = networks.where("approach = 'persistence'")
    a = p.where(F.col("grp") == g1).select("method", "matrix_key", "threshold", "i", "j", F.col("w").alias("w1"))
    b = p.where(F.col("grp") == g2).select("matrix_key", "i", "j", F.col("w").alias("w2"))
    return a.join(b, ["matrix_key", "i", "j"]).drop("matrix_key")


def binary_edges(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges by the strict rule abs(r) > threshold, as conservation uses."""
    return corr.where(F.abs("r") > threshold).select("method", "grp", "i", "j")


def assign_areas(nodes: DataFrame, areas: DataFrame, last: bool = True) -> DataFrame:
    """(node, area). ``last``: names compare without case and the last area wins, else "Unassigned"; otherwise with
    case, the first area wins, else "Other"."""
    if last:
        named = areas.select(F.lower("node").alias("k"), "area", "area_ord").groupBy("k").agg(F.max_by("area", "area_ord").alias("area"))
        return nodes.join(F.broadcast(named), F.lower("node") == F.col("k"), "left").select("node", F.coalesce("area", F.lit("Unassigned")).alias("area"))
    named = areas.groupBy(F.col("node").alias("k")).agg(F.min_by("area", "area_ord").alias("area"))
    return nodes.join(F.broadcast(named), F.col("node") == F.col("k"), "left").select("node", F.coalesce("area", F.lit("Other")).alias("area"))
