"""Consensus scoring of nodes over methods and approaches.

Input of most functions: ``scores`` (approach, method, node, value) of one group, one row per node of every network.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import min_rank, z_score
from hubweave.operators import graph_metrics, network, persistence, spread
from hubweave.sources.scratch import settled

APPROACHES = ("weighted", "percolation", "persistence")
NETWORK = ("method", "grp", "approach", "step")
GROUP = "grp"
CASES = 15  # denominator of the sensitivity analysis: five methods by three approaches, whatever there is


def approach_networks(corr: DataFrame, thresholds: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of every network of the three approaches, keyed by method, grp, approach and step.

    weighted: all pairs; percolation: at the network's own threshold (``thresholds``: method, grp, threshold);
    persistence: one network for each step of ``grid`` at which it has an edge. Step is -1 but for persistence.
    """
    whole = network.full_network(corr.where("r is not null")).where("w > 0").select("method", "grp", F.lit("weighted").alias("approach"), F.lit(-1).alias("step"), "src", "dst", "w")
    cut = network.threshold_network(corr, thresholds).select("method", "grp", F.lit("percolation").alias("approach"), F.lit(-1).alias("step"), "src", "dst", "w")
    swept = persistence.swept_edges(corr, grid).select("method", "grp", F.lit("persistence").alias("approach"), "step", "src", "dst", "w")
    edges = settled(whole.unionByName(cut).unionByName(swept))
    return edges, edges.select(*NETWORK).distinct().join(graph_metrics.nodes_of(corr), ["method", "grp"])


def approach_scores(corr: DataFrame, thresholds: DataFrame, grid: DataFrame) -> DataFrame:
    """(grp, approach, method, node, eigenvector, strength): of persistence the areas under both over the whole grid,
    0 where a threshold has no network."""
    edges, nodes = approach_networks(corr, thresholds, grid)
    nodes = settled(nodes)
    values = settled(spread.eigenvector(edges, nodes, NETWORK).join(graph_metrics.node_degrees(edges, nodes, NETWORK).drop("degree"), [*NETWORK, "node"]))
    single = values.where("approach <> 'persistence'").select("grp", "approach", "method", "node", "eigenvector", "strength")
    swept, all_nodes = values.where("approach = 'persistence'"), graph_metrics.nodes_of(corr)
    areas = [persistence.zero_filled_auc(swept, v, all_nodes, grid).withColumnRenamed("auc", v) for v in ("eigenvector", "strength")]
    both = areas[0].join(areas[1], ["method", "grp", "node"])
    return single.unionByName(both.select("grp", F.lit("persistence").alias("approach"), "method", "node", "eigenvector", "strength"))


def rank_consensus_of_both(scores: DataFrame, *key: str) -> DataFrame:
    """(key, node, avg_eigen_rank, consensus_eigenvector, avg_strength_rank, consensus_node_strength, n_methods):
    rank_consensus() of the eigenvector and of the strength columns of approach_scores()."""
    one = lambda v, rank, name: rank_consensus(scores.select(*key, "approach", "method", "node", F.col(v).alias("value")), *key).withColumnsRenamed({"avg_rank": rank, "consensus": name})
    a = one("eigenvector", "avg_eigen_rank", "consensus_eigenvector")
    b = one("strength", "avg_strength_rank", "consensus_node_strength").drop("n_methods")
    return a.join(b, [*key, "node"]).select(*key, "node", "avg_eigen_rank", "consensus_eigenvector", "avg_strength_rank", "consensus_node_strength", "n_methods")


def rank_consensus(scores: DataFrame, *key: str) -> DataFrame:
    """(key, node, avg_rank, consensus, n_methods): mean of falling min-ranks over all columns, missing nodes counting
    as 0, rescaled so that the best node is 1 (all 1 where all are equal). Values that agree to 9 decimals tie."""
    columns = scores.select(*key, "approach", "method").distinct()
    nodes = scores.select(*key, "node").distinct()
    full = columns.join(nodes, list(key)).join(scores, [*key, "approach", "method", "node"], "left").withColumn("value", F.coalesce(F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(0.0)).otherwise(F.col("value")), F.lit(0.0)))
    ranks = full.withColumn("value", F.round("value", 9)).withColumn("rank", min_rank("value", *key, "approach", "method")).groupBy(*key, "node").agg(F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("n_methods"))
    w = Window.partitionBy(*key)
    scaled = F.try_divide(F.max("avg_rank").over(w) - F.col("avg_rank"), F.max("avg_rank").over(w) - F.min("avg_rank").over(w))
    return ranks.withColumn("consensus", F.coalesce(scaled, F.lit(1.0)))


def standardised_hubs(scores: DataFrame, z_threshold: float = 1.5, *key: str) -> DataFrame:
    """(key, approach, method, node, value, z, is_hub): z with the sample deviation within a network."""
    z = z_score("value", *key, "approach", "method")
    return scores.withColumn("z", z).withColumn("is_hub", F.coalesce(F.col("z") >= z_threshold, F.lit(False)))


def weighted_consensus(hubs: DataFrame, *key: str) -> DataFrame:
    """Confidence-weighted hub probability per node over the three approaches.

    Per approach: probability = share of methods that call the node a hub, mean z, CV = |sd / mean| (infinite for a
    mean within 0.01 of 0), weight 1 / (1 + CV). A single method has no sd, so no weight. Weights are normalised over
    the approaches that have one (a third each where none has), the score is the weighted sum of probabilities, and
    the interval spans one deviation of the weighted terms, within [0, 1].
    """
    s = hubs.groupBy(*key, "node", "approach").agg(F.avg(F.col("is_hub").cast("double")).alias("prob"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"))
    cv = F.when(F.abs("mean_z") > 0.01, F.abs(F.col("sd_z") / F.col("mean_z"))).otherwise(F.when(F.col("sd_z").isNotNull(), F.lit(float("inf"))))
    s = s.withColumn("weight", 1 / (1 + cv))
    wide = s.groupBy(*key, "node").agg(*[f for a in APPROACHES for f in (F.coalesce(F.max(F.when(F.col("approach") == a, F.col("prob"))), F.lit(0.0)).alias(f"{a}_prob"), F.max(F.when(F.col("approach") == a, F.col("weight"))).alias(f"{a}_raw"), F.count_if(F.col("approach") == a).alias(f"{a}_n"))])
    for a in APPROACHES:  # an absent approach weighs 0, one without a deviation has no weight
        wide = wide.withColumn(f"{a}_raw", F.when(F.col(f"{a}_n") == 0, F.lit(0.0)).otherwise(F.col(f"{a}_raw")))
    total = sum((F.coalesce(F.col(f"{a}_raw"), F.lit(0.0)) for a in APPROACHES), F.lit(0.0))
    wide = wide.withColumn("total", total)
    for a in APPROACHES:
        wide = wide.withColumn(f"{a}_weight", F.when(F.col("total") > 0, F.coalesce(F.col(f"{a}_raw"), F.lit(0.0)) / F.col("total")).otherwise(F.lit(1.0) / 3))
    terms = [F.col(f"{a}_prob") * F.col(f"{a}_weight") for a in APPROACHES]
    mean = (terms[0] + terms[1] + terms[2]) / 3
    sd = F.sqrt(sum(((t - mean) * (t - mean) for t in terms), F.lit(0.0)) / 2)
    wide = wide.withColumn("score", terms[0] + terms[1] + terms[2]).withColumn("sd", sd)
    wide = wide.withColumn("low", F.greatest(F.lit(0.0), F.col("score") - F.col("sd"))).withColumn("high", F.least(F.lit(1.0), F.col("score") + F.col("sd")))
    width = F.col("high") - F.col("low")
    wide = wide.withColumn("confidence", F.when(width < 0.2, "High").when(width < 0.4, "Medium").otherwise("Low"))
    return wide.select(*key, "node", *[f"{a}_prob" for a in APPROACHES], *[f"{a}_weight" for a in APPROACHES], "score", "low", "high", "confidence")


def uncertainty(consensus: DataFrame) -> DataFrame:
    """Adds sd and CV over the three probabilities, their class, and how many approaches agree (at 0.6)."""
    p = [F.col(f"{a}_prob") for a in APPROACHES]
    mean = (p[0] + p[1] + p[2]) / 3
    out = consensus.withColumn("prob_sd", F.sqrt(sum(((x - mean) * (x - mean) for x in p), F.lit(0.0)) / 2))
    out = out.withColumn("prob_cv", F.when(mean > 0.01, F.col("prob_sd") / mean).otherwise(F.lit(float("inf"))))
    agree = sum(((x >= 0.6).cast("int") for x in p), F.lit(0))
    kind = F.when(F.col("prob_cv") <= 0.2, "consistent").when(F.col("prob_cv") <= 0.4, "moderate").otherwise("variable")
    return out.withColumn("uncertainty", kind).withColumn("all_three_agree", agree == 3).withColumn("two_agree", agree >= 2)


def _at_taus(hubs: DataFrame, taus: list[float], *key: str) -> DataFrame:
    points = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(float(t)).alias("tau")) for i, t in enumerate(taus)])
    return hubs.select(*key, "node", "z", F.explode(points).alias("p")).select(*key, "node", "z", "p.at", "p.tau")


def calibrate_threshold(hubs: DataFrame, taus: list[float], *key: str) -> DataFrame:
    """(key, tau, share, hub_modularity, hub_clustering, hub_density, score, best): quality of each threshold.

    The z of all networks of a key are pooled. A third of the distinct z (to 9 decimals) stands for the number of
    nodes, a third of the distinct ones from tau on for that of hubs. Fewer than 2 hubs score 0. Else the score adds

    * 1 for a share of hubs from 5 to 15 percent, otherwise exp(-10 |share - 0.1|);
    * modularity: 1 - sd / mean of the hubs' z, within 0 and 1 (0 for 3 z or fewer);
    * clustering: 1 / (1 + range of the hubs' z) (0 for 3 z or fewer);
    * 0.5 if density, twice the share but 0.6 at most, is 0.1 at least.

    The first tau of the highest score is marked.
    """
    exact = F.round("z", 9)
    nodes = hubs.groupBy(*key).agg((F.count_distinct(exact) / 3).alias("nodes"))
    z = F.when(F.col("z") >= F.col("tau"), F.col("z"))
    s = _at_taus(hubs, taus, *key).groupBy(*key, "at", "tau").agg(
        (F.count_distinct(F.when(F.col("z") >= F.col("tau"), exact)) / 3).alias("hubs"),
        F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_samp(z).alias("sd"), (F.max(z) - F.min(z)).alias("range"),
    )
    s = s.join(nodes, list(key)).withColumn("share", F.col("hubs") / F.col("nodes"))
    several = F.col("n") > 3
    s = s.withColumn("hub_modularity", F.when(several, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.col("mean")))).otherwise(F.lit(0.0)))
    s = s.withColumn("hub_clustering", F.when(several, 1 / (1 + F.col("range"))).otherwise(F.lit(0.0)))
    s = s.withColumn("hub_density", F.least(2 * F.col("share"), F.lit(0.6)))
    fair = F.when((F.col("share") >= 0.05) & (F.col("share") <= 0.15), F.lit(1.0)).otherwise(F.exp(-10 * F.abs(F.col("share") - 0.1)))
    dense = F.when(F.col("hub_density") >= 0.1, F.lit(0.5)).otherwise(F.lit(0.0))
    s = s.withColumn("score", fair + F.col("hub_modularity") + F.col("hub_clustering") + dense)
    measures = ["share", "hub_modularity", "hub_clustering", "hub_density", "score"]
    s = s.select(*key, "at", "tau", *[F.when(F.col("hubs") >= 2, F.col(m)).otherwise(F.lit(0.0)).alias(m) for m in measures])
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.round("score", 9).desc(), "at")) == 1
    return s.withColumn("best", first).select(*key, "tau", *measures, "best")


def _shares(hubs: DataFrame, taus: list[float], *key: str) -> DataFrame:
    """(key, at, tau, node, share): share of networks, of CASES, that call a node a hub at each tau."""
    hit = F.when(F.col("z") >= F.col("tau"), F.lit(1)).otherwise(F.lit(0))
    return _at_taus(hubs, taus, *key).groupBy(*key, "at", "tau", "node").agg((F.sum(hit) / F.lit(float(CASES))).alias("share"))


def stable_hubs(hubs: DataFrame, taus: list[float], *key: str) -> DataFrame:
    """(key, node, mean_share, n_taus_hub, stable): a consensus hub from a share of 0.5, stable in 80 percent of the taus."""
    s = _shares(hubs, taus, *key).groupBy(*key, "node").agg(F.avg("share").alias("mean_share"), F.count_if(F.col("share") >= 0.5).alias("n_taus_hub"))
    return s.withColumn("stable", F.col("n_taus_hub") >= math.ceil(0.8 * len(taus)))


def threshold_sensitivity(hubs: DataFrame, taus: list[float], *key: str) -> DataFrame:
    """(key, tau, n_consensus_hubs, n_three_way, avg_score, stable_hubs): nodes whose share is 0.5 and 0.6 at least,
    the mean share of nodes that any network calls a hub (null without one), and how many of the hubs are stable."""
    shares = _shares(hubs, taus, *key).join(stable_hubs(hubs, taus, *key).select(*key, "node", "stable"), [*key, "node"])
    hub, share = F.col("share") >= 0.5, F.col("share")
    return shares.groupBy(*key, "tau").agg(
        F.count_if(hub).alias("n_consensus_hubs"), F.count_if(share >= 0.6).alias("n_three_way"),
        F.avg(F.when(share > 0, share)).alias("avg_score"), F.count_if(hub & F.col("stable")).alias("stable_hubs"),
    )


def agreement_sensitivity(hubs: DataFrame, agreements: list[float], tau: float = 1.5, *key: str) -> DataFrame:
    """(key, agreement, n_hubs, avg_confidence): nodes whose share at ``tau`` reaches each agreement, and their mean share."""
    points = F.explode(F.array(*[F.lit(float(a)) for a in agreements])).alias("agreement")
    s = _shares(hubs, [tau], *key).select(*key, "share", points)
    reached = F.round(F.col("share") - F.col("agreement"), 9) >= 0
    return s.groupBy(*key, "agreement").agg(F.count_if(reached).alias("n_hubs"), F.coalesce(F.avg(F.when(reached, F.col("share"))), F.lit(0.0)).alias("avg_confidence"))


def comprehensive(scores: DataFrame, z_threshold: float | str | None = 1.5, *key: str) -> DataFrame:
    """Standardise, combine, and label each node's robustness. "auto" or None takes each key's calibrated threshold."""
    if z_threshold in ("auto", None):
        hubs = standardised_hubs(scores, 1.5, *key)
        best = calibrate_threshold(hubs, [round(1 + 0.1 * k, 1) for k in range(16)], *key).where("best").select(*key, "tau")
        hubs = (hubs.join(best, list(key), "left") if key else hubs.crossJoin(best)).withColumn("is_hub", F.coalesce(F.col("z") >= F.coalesce("tau", F.lit(1.5)), F.lit(False))).drop("tau")
    else:
        hubs = standardised_hubs(scores, float(z_threshold), *key)
    out = uncertainty(weighted_consensus(hubs, *key))
    label = F.when(F.col("all_three_agree"), "all three").when(F.col("two_agree"), "two").when(F.round("score", 9) >= 0.4, "consensus").otherwise("none")
    return out.withColumn("robustness", label)
