"""Consensus of correlation tables over methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG = 0.4


def consensus(corr: DataFrame, how: str = "median") -> DataFrame:
    """(grp, i, j, r): median or mean over the methods, missing values left out."""
    if how not in ("median", "mean"):
        raise ValueError(f"consensus by {how!r}; median or mean")
    return corr.groupBy("grp", "i", "j").agg((F.median("r") if how == "median" else F.avg("r")).alias("r"))


def consensus_metadata(corr: DataFrame, how: str = "median") -> DataFrame:
    """(grp, n_methods, total_pairs, mean_abs_r, strong, density) of the consensus."""
    methods = corr.groupBy("grp").agg(F.countDistinct("method").alias("n_methods"))
    found = consensus(corr, how).groupBy("grp").agg(F.count(F.lit(1)).alias("total_pairs"), F.avg(F.abs("r")).alias("mean_abs_r"), F.count_if(F.abs("r") >= STRONG).alias("strong"))
    return found.join(methods, "grp").withColumn("density", F.col("strong") / F.col("total_pairs"))


def common_methods(corr: DataFrame) -> DataFrame:
    """Methods present in every group."""
    groups = corr.select("grp").distinct().count()
    return corr.groupBy("method").agg(F.countDistinct("grp").alias("groups")).where(F.col("groups") == groups).select("method")
