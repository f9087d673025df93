"""Result sinks: partitioned CSV folders and a JSON network export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(df: DataFrame, path: str, *by: str) -> None:
    """CSV with a header, one folder per value of ``by``."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def dense_correlations(corr: DataFrame, nodes: list[str]) -> DataFrame:
    """(method, grp, node, one column per node): the full symmetric matrix with 1 on the diagonal, a row per node."""
    both = corr.select("method", "grp", "i", "j", "r").union(corr.select("method", "grp", F.col("j"), F.col("i"), "r"))
    own = corr.select("method", "grp").distinct().select("method", "grp", F.explode(F.array(*[F.lit(n) for n in nodes])).alias("i")).select("method", "grp", "i", F.col("i").alias("j"), F.lit(1.0).alias("r"))
    return both.union(own).groupBy("method", "grp", F.col("i").alias("node")).pivot("j", nodes).agg(F.first("r"))


def network_json(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, grp, json): elements {nodes, edges} of each network, weights to 4 places, edges numbered e1, e2, ..."""
    k = ["method", "grp"]
    n = nodes.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(F.struct(F.col("node").alias("id"), F.col("node").alias("name")).alias("data")))).alias("nodes"))
    e = edges.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("src", "dst", F.round("w", 4).alias("w")))).alias("list"))
    numbered = F.transform("list", lambda x, i: F.struct(F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("id"), x["src"].alias("source"), x["dst"].alias("target"), x["w"].alias("weight")).alias("data")))
    joined = n.join(e, k, "left").withColumn("edges", F.coalesce(numbered, F.array()))
    body = F.struct(F.struct(F.lit("1.0").alias("format_version"), "method", F.col("grp").alias("group")).alias("metadata"), F.struct("nodes", "edges").alias("elements"))
    return joined.select(*k, F.to_json(body).alias("json"))
