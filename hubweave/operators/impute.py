"""Cleaning and imputation of vectors (grp, subject, values)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def mean_fill(long: DataFrame) -> DataFrame:
    """Missing values of a node become its mean over all subjects; a node without values stays missing."""
    means = long.groupBy("node").agg(F.avg("value").alias("mean"))
    return long.join(F.broadcast(means), "node").select("grp", "subject", "node", F.coalesce("value", "mean").alias("value"))


def missing_profile(long: DataFrame) -> DataFrame:
    """(node, n_missing, n_total)."""
    return long.groupBy("node").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_total"))


def standardised(long: DataFrame) -> DataFrame:
    """Nodes without any value go, gaps take the node's mean, then mean 0 and sample deviation 1 (0 where constant)."""
    stats = long.groupBy("node").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where("n > 0").select("node", "mean")
    filled = long.join(F.broadcast(stats), "node").select("grp", "subject", "node", "mean", F.coalesce("value", "mean").alias("value"))
    spread = filled.groupBy("node").agg(F.stddev_samp("value").alias("sd"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.col("sd")), F.lit(0.0))
    return filled.join(F.broadcast(spread), "node").select("grp", "subject", "node", z.alias("value"))


def complete_cases(rows: DataFrame) -> DataFrame:
    """Subjects with a value for every node."""
    return rows.where(F.forall("values", lambda v: v.isNotNull()))


def shrinkage_admissible(long: DataFrame) -> DataFrame:
    """(grp, n, worst_variance, admissible): at least 3 subjects, no missing or non-finite value, no flat node."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    per_node = long.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.var_samp(F.when(~bad, F.col("value"))).alias("variance"))
    found = per_node.groupBy("grp").agg(F.max("n").alias("n"), F.sum("bad").alias("bad"), F.min("variance").alias("worst_variance"))
    return found.select("grp", "n", "worst_variance", ((F.col("n") >= 3) & (F.col("bad") == 0) & F.coalesce(F.col("worst_variance") >= 100 * EPS, F.lit(False))).alias("admissible"))


def nearest(known: np.ndarray, wanted: np.ndarray, count: int) -> list[np.ndarray]:
    """Places of the ``count`` values of ``known`` nearest to each of ``wanted``, nearest first; of ties the first places.

    Known values are sorted once. Of equal ones only the first ``count`` can be chosen, so that twice as many on either
    side of a wanted value hold its nearest, ties included.
    """
    order = np.argsort(known, kind="stable")
    at = np.arange(len(order))
    starts = np.r_[True, known[order][1:] != known[order][:-1]]
    order = order[at - np.maximum.accumulate(np.where(starts, at, 0)) < count]
    places = np.searchsorted(known[order], wanted)[:, None] + np.arange(-2 * count, 2 * count)
    inside = (places >= 0) & (places < len(order))
    near = order[np.clip(places, 0, len(order) - 1)]
    far = np.where(inside, np.abs(known[near] - wanted[:, None]), np.inf)
    best = np.lexsort((near, far))[:, : min(count, len(order))]
    return list(np.take_along_axis(near, best, 1))


def predictive_mean_matching(rows: DataFrame, nodes: list[str], iterations: int = 10, donors: int = 5, seed: int = 123) -> DataFrame:
    """Chained equations with predictive mean matching, group by group; the first completed dataset.

    Observed values stay; an imputed value is always an observed one of the same node, that of one of the ``donors``
    subjects with the nearest prediction, chosen by a generator seeded from ``seed`` and the group. Nodes that a group
    never saw stay missing; groups of fewer than 3 observed values of a node take its mean there.
    """

    def impute(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("subject")
        x = np.array(pdf["values"].tolist(), float).reshape(len(pdf), len(nodes))
        gaps = np.isnan(x)
        rng = np.random.default_rng([seed, *str(key[0]).encode()])
        means = np.array([np.nan if gaps[:, j].all() else x[~gaps[:, j], j].mean() for j in range(x.shape[1])])
        filled = np.where(gaps, means, x)
        usable = np.flatnonzero(~np.isnan(means))
        for _ in range(iterations):
            for j in usable:
                if not gaps[:, j].any() or (~gaps[:, j]).sum() < 3:
                    continue
                others = np.column_stack([np.ones(len(x)), filled[:, usable[usable != j]]])
                seen = ~gaps[:, j]
                ridge = 1e-5 * np.eye(others.shape[1])
                beta = np.linalg.solve(others[seen].T @ others[seen] + ridge, others[seen].T @ x[seen, j])
                guess = others @ beta
                own, missing = x[seen, j], np.flatnonzero(gaps[:, j])
                for i, near in zip(missing, nearest(guess[seen], guess[missing], donors), strict=True):
                    filled[i, j] = own[rng.choice(near)]
        out = [[None if np.isnan(v) else float(v) for v in row] for row in filled]
        return pd.DataFrame({"grp": pdf["grp"].tolist(), "subject": pdf["subject"].tolist(), "values": out})

    return rows.groupBy("grp").applyInPandas(impute, "grp string, subject long, values array<double>")


def rank_in_group(long: DataFrame) -> DataFrame:
    """Values replaced by their average ranks within (grp, node)."""
    by = Window.partitionBy("grp", "node")
    low = F.rank().over(by.orderBy("value"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("grp", "node", "value"))
    return long.select("grp", "subject", "node", (low + (ties - 1) / 2).alias("value"))
