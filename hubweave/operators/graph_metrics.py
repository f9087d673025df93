"""Graph metrics of edge tables in relational form. Networks are keyed by ``KEY`` columns; edges have src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("method", "grp")


def doubled(edges: DataFrame, key=KEY) -> DataFrame:
    """(key, node, other, w): every edge from both ends."""
    a = edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("other"), "w")
    return a.unionByName(edges.select(*key, F.col("dst").alias("node"), F.col("src").alias("other"), "w"))


def node_degrees(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, node, degree, strength); ``nodes`` (key, node) keeps isolated nodes, with zeros."""
    deg = doubled(edges, key).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    return nodes.join(deg, [*key, "node"], "left").select(*key, "node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def nodes_of(corr: DataFrame, key=KEY) -> DataFrame:
    """(key, node) of a correlation table."""
    return corr.select(*key, F.col("i").alias("node")).union(corr.select(*key, F.col("j").alias("node"))).distinct()


def density(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, n_nodes, n_edges, density)."""
    n = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n_edges"))
    out = n.join(m, list(key), "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("long")))
    return out.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))


def triangles(edges: DataFrame, key=KEY) -> DataFrame:
    """(key, a, b, c) with a < b < c."""
    e = edges.select(*key, "src", "dst")
    ab, bc, ac = e.toDF(*key, "a", "b"), e.toDF(*key, "b", "c"), e.toDF(*key, "a", "c")
    return ab.join(bc, [*key, "b"]).join(ac, [*key, "a", "c"]).select(*key, "a", "b", "c")


def local_clustering(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, node, degree, triangles, clustering); 0 for fewer than two neighbours."""
    t = triangles(edges, key).select(*key, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("triangles"))
    d = node_degrees(edges, nodes, key).drop("strength")
    d = d.join(t, [*key, "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    return d.withColumn("clustering", F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)))


def transitivity(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, transitivity): 3 triangles over connected triples, 0 without any."""
    per = local_clustering(edges, nodes, key).groupBy(*key).agg(F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    return per.select(*key, F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("triples")), F.lit(0.0)).alias("transitivity"))


def assortativity(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, assortativity): correlation of the degrees at both ends over both directions, 0 if undefined."""
    deg = node_degrees(edges, nodes, key).select(*key, "node", "degree")
    both = doubled(edges, key).join(deg.withColumnRenamed("degree", "x"), [*key, "node"]).join(deg.withColumnsRenamed({"node": "other", "degree": "y"}), [*key, "other"])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return both.groupBy(*key).agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)).alias("assortativity"))


def weighted_neighbour_clustering(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """(key, clustering): mean over nodes of the weight among a node's neighbours over k (k - 1) / 2."""
    d = doubled(edges, key)
    x = d.select(*key, "node", F.col("other").alias("src"))
    y = d.select(*key, "node", F.col("other").alias("dst"))
    among = x.join(y, [*key, "node"]).where("src < dst").join(edges.select(*key, "src", "dst", "w"), [*key, "src", "dst"]).groupBy(*key, "node").agg(F.sum("w").alias("weight"))
    deg = node_degrees(edges, nodes, key).join(among, [*key, "node"], "left")
    c = F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(F.coalesce("weight", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1) / 2))
    return deg.groupBy(*key).agg(F.avg(c).alias("clustering"))


def area_metrics(edges: DataFrame, nodes: DataFrame, areas: DataFrame, key=KEY) -> DataFrame:
    """(key, area, n_nodes, avg_degree, avg_clustering, internal_edges, external_edges); ``areas``: (node, area).

    Means of further node tables (as betweenness) are those of area_means().
    """
    per = local_clustering(edges, nodes, key).join(F.broadcast(areas), "node")
    means = per.groupBy(*key, "area").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("avg_degree"), F.avg("clustering").alias("avg_clustering"))
    ends = edges.join(F.broadcast(areas.toDF("src", "sa")), "src").join(F.broadcast(areas.toDF("dst", "da")), "dst")
    inside = F.col("sa") == F.col("da")
    touched = ends.select(*key, F.explode(F.array_distinct(F.array("sa", "da"))).alias("area"), inside.alias("inside"))
    counts = touched.groupBy(*key, "area").agg(F.count_if("inside").alias("internal_edges"), F.count_if(~F.col("inside")).alias("external_edges"))
    zero = F.lit(0).cast("long")
    return means.join(counts, [*key, "area"], "left").withColumn("internal_edges", F.coalesce("internal_edges", zero)).withColumn("external_edges", F.coalesce("external_edges", zero))


def modularity(edges: DataFrame, membership: DataFrame, key=KEY) -> DataFrame:
    """(key, modularity) of a given partition (key, node, community), weighted."""
    d = doubled(edges, key).join(membership, [*key, "node"]).join(membership.withColumnsRenamed({"node": "other", "community": "oc"}), [*key, "other"])
    per = d.groupBy(*key, "community").agg(F.sum(F.when(F.col("oc") == F.col("community"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    total = d.groupBy(*key).agg(F.sum("w").alias("total"))
    return per.join(total, list(key)).groupBy(*key).agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("all") / F.col("total"), F.lit(2.0))).alias("modularity"))


def area_means(values: DataFrame, areas: DataFrame, value: str, key=KEY) -> DataFrame:
    """(key, area, avg_<value>) of a node table (key, node, value)."""
    return values.join(areas.select("node", "area"), "node").groupBy(*key, "area").agg(F.avg(value).alias(f"avg_{value}"))
