"""Queries of plot data and of dense sinks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubweave.operators import graph_metrics, network, permute, persistence, plotdata, scoring, similarity, threshold_free
from hubweave.plans import binding as B
from hubweave.plans import comparisons as C
from hubweave.plans import core
from hubweave.plans import scores as K
from hubweave.plans.binding import q, r6
from hubweave.sources import sinks

Q, S = {}, {}


def add(name, build, sql=None):
    Q[name] = q(build)
    if sql:
        S[name] = sql


KEY = ("method", "grp")


def strength(s, d):
    return threshold_free.node_strength(B.corr2(s, d)[0]).select(*KEY, "node", "node_strength")


def absolute(s, d):
    return B.corr2(s, d)[0].select(*KEY, F.abs("r").alias("w"))


def both(s, d):
    return threshold_free.cross_method_nodes(*C.two_strengths(s, d))


def combined(s, d):
    return scoring.weighted_consensus(scoring.standardised_hubs(K.scores(s, d), K.HUB_Z, "grp"), "grp")


add("r_top_strength", lambda s, d: plotdata.top(strength(s, d), "node_strength", 5, *KEY), f"WITH {C.STRENGTH}, p AS (SELECT method, grp, node, node_strength, row_number() OVER (PARTITION BY method, grp ORDER BY node_strength DESC, node) AS place FROM st) SELECT method, grp, node, {r6('node_strength')}, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5")
add("r_weight_histogram", lambda s, d: plotdata.histogram(absolute(s, d), "w", 0.0, 1.0, 20, *KEY), f"WITH {B.CORR2} SELECT method, grp, CAST(least(greatest(floor(round(abs(r) * 20, 9)) + 1, 1), 20) AS INTEGER) AS bin, count(*) AS n FROM corr WHERE r IS NOT NULL GROUP BY ALL")
add("r_weight_quartiles", lambda s, d: plotdata.quartiles(absolute(s, d), "w", *KEY), f"WITH {B.CORR2}, w AS (SELECT method, grp, abs(r) AS w FROM corr) SELECT method, grp, {r6('quantile_cont(w, 0.25) AS q1', 'median(w) AS median', 'quantile_cont(w, 0.75) AS q3', 'avg(w) AS mean', 'stddev_samp(w) AS sd')} FROM w GROUP BY method, grp")
add("r_area_strength", lambda s, d: plotdata.area_means(strength(s, d), "node_strength", B.areas(s).select("node", "area"), *KEY), f"WITH {C.STRENGTH}, {B.AREA_SQL} SELECT method, grp, area, {r6('avg(node_strength) AS mean', 'stddev_samp(node_strength) / sqrt(count(*)) AS se')}, count(*) AS n FROM st JOIN areas USING (node) GROUP BY method, grp, area")
add("r_strength_regression", lambda s, d: plotdata.regression(both(s, d), "weighted", "percolation", *KEY), f"WITH {C.PERC_ST} SELECT method, grp, {r6('regr_slope(p, node_strength) AS slope', 'regr_intercept(p, node_strength) AS intercept', 'corr(p, node_strength) AS r')} FROM st JOIN ps USING (method, grp, node) GROUP BY method, grp")
add("r_inverted_ranks", lambda s, d: plotdata.inverted_ranks(strength(s, d), "node_strength", *KEY), f"WITH {C.STRENGTH} SELECT method, grp, node, {r6('node_strength')}, round(({B.DIMS} - (rank() OVER (PARTITION BY method, grp ORDER BY node_strength DESC) + (count(*) OVER (PARTITION BY method, grp, node_strength) - 1) / 2.0) + 1) / {B.DIMS}, 6) + 0.0 AS inverted_rank FROM st")
add("r_hub_regions", lambda s, d: plotdata.hub_regions(combined(s, d), "grp"), f"WITH RECURSIVE {K.J4}, rg AS (SELECT grp, CASE WHEN weighted_prob >= 0.6 THEN 'W' ELSE '' END || CASE WHEN percolation_prob >= 0.6 THEN 'P' ELSE '' END || CASE WHEN persistence_prob >= 0.6 THEN 'S' ELSE '' END AS region FROM cn) SELECT grp, region, count(*) AS n FROM rg WHERE region <> '' GROUP BY grp, region")
add("r_agreement_bins", lambda s, d: plotdata.agreement_bins(combined(s, d), "grp"), f"WITH RECURSIVE {K.J4} SELECT grp, CASE WHEN score <= 0.33 THEN 'low' WHEN score <= 0.66 THEN 'middle' ELSE 'high' END AS bin, count(*) AS n FROM cn GROUP BY ALL")
DENSE = ", ".join(f"round(max(r) FILTER (j = 'd{k:02d}'), 6) + 0.0 AS d{k:02d}" for k in range(B.DIMS))
add("a3_dense_correlations", lambda s, d: sinks.dense_correlations(*B.corr2(s, d)), f"""WITH {B.CORR2},
w AS (SELECT method, grp, i, j, r FROM corr UNION ALL SELECT method, grp, j, i, r FROM corr UNION ALL SELECT DISTINCT method, grp, node, node, 1.0 FROM (SELECT DISTINCT method FROM corr), (SELECT DISTINCT grp, node FROM obs))
SELECT method, grp, i AS node, {DENSE} FROM w GROUP BY method, grp, i""")
add("a11_network_json", lambda s, d: sinks.network_json(B.cut_edges(s, d)[0], graph_metrics.nodes_of(B.pearson(s, d)[0])))


# matrices, extremes and comparisons
def area_names(s):
    return B.areas(s).select("node", "area")


def hubs(s, d):
    return scoring.standardised_hubs(K.scores(s, d), K.HUB_Z, "grp")


def spread(s, d):
    return threshold_free.centrality_spread(strength(s, d), "node_strength")


def ranking(s, d):
    scored = combined(s, d).withColumn("score", F.round("score", 9))
    return plotdata.top(scored, "score", 5, "grp").select("grp", "node", "score", "low", "high", "place")


def both_pairs(s, d):
    corr = B.corr2(s, d)[0]
    return plotdata.conservation_pairs(similarity.binary_similarity(corr, 0.21), similarity.weighted_similarity(corr))


def percolated(s, d):
    corr = B.pearson(s, d)[0]
    kept = corr.join(F.broadcast(network.percolation_thresholds(corr)), list(KEY))
    return kept.select(*KEY, "i", "j", F.abs("r").alias("w"), "threshold", (F.abs("r") >= F.col("threshold")).alias("above"))


def persistent(s, d):
    return K.scores(s, d).where("approach = 'persistence'")


def swept(s, d):
    return persistence.swept_degrees(B.corr2(s, d)[0], persistence.threshold_grid(s, 0.052, 0.05, 8))


PLACED = "rkd AS (SELECT grp, node, round(score, 9) AS score, low, high, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, node) AS place FROM cn)"
CV = "cvs AS (SELECT method, node, stddev_samp(node_strength) / avg(node_strength) AS cv FROM st GROUP BY method, node)"
BOTH_PAIRS = "cp AS (SELECT method, g1, g2, count(*) FILTER (w1 > 0.21 AND w2 > 0.21) / nullif(count(*) FILTER (w1 > 0.21 OR w2 > 0.21), 0) AS bj, sum(least(w1, w2)) / sum(greatest(w1, w2)) AS wj FROM pr GROUP BY ALL), cq AS (SELECT method, g1, g2, coalesce(bj, 0) AS jaccard, wj AS weighted_jaccard FROM cp)"
add("r_similarity_matrix", lambda s, d: plotdata.symmetric(similarity.weighted_similarity(B.corr2(s, d)[0]), "weighted_jaccard", "method"), f"WITH {C.PAIR}, x AS (SELECT method, g1, g2, sum(least(w1, w2)) / sum(greatest(w1, w2)) AS v FROM pr GROUP BY ALL), y AS (SELECT method, g1 AS a, g2 AS b, v FROM x UNION ALL SELECT method, g2, g1, v FROM x) SELECT method, a, b, {r6('v AS weighted_jaccard')} FROM y UNION ALL SELECT DISTINCT method, a, a, 1.0::DOUBLE FROM y")
add("r_consensus_ranking", ranking, f"WITH RECURSIVE {K.J4}, {PLACED} SELECT grp, node, {r6('score', 'low', 'high')}, CAST(place AS INTEGER) AS place FROM rkd WHERE place <= 5")
add("r_consensus_heatmap", lambda s, d: combined(s, d).unpivot(["grp", "node"], [f"{a}_prob" for a in K.A3], "approach", "prob").join(ranking(s, d).select("grp", "node"), ["grp", "node"], "left_semi"), f"WITH RECURSIVE {K.J4}, {PLACED} SELECT cn.grp, cn.node, unnest(['weighted_prob', 'percolation_prob', 'persistence_prob']) AS approach, unnest([{r6('weighted_prob').split(' AS ')[0]}, {r6('percolation_prob').split(' AS ')[0]}, {r6('persistence_prob').split(' AS ')[0]}]) AS prob FROM cn JOIN rkd USING (grp, node) WHERE place <= 5")
add("r_strength_stability", lambda s, d: plotdata.extremes(spread(s, d).withColumn("cv", F.round("cv", 9)), "cv", 3, "method"), f"WITH {C.STRENGTH}, {CV}, lh AS (SELECT method, node, cv, 'low' AS side, row_number() OVER (PARTITION BY method ORDER BY round(cv, 9), node) AS place FROM cvs UNION ALL SELECT method, node, cv, 'high', row_number() OVER (PARTITION BY method ORDER BY round(cv, 9) DESC, node) FROM cvs) SELECT method, side, CAST(place AS INTEGER) AS place, node, {r6('round(cv, 9) AS cv')} FROM lh WHERE place <= 3")
add("r_stability_percentiles", lambda s, d: spread(s, d).groupBy("method").agg(*[F.percentile("cv", p / 100).alias(f"p{p}") for p in (90, 95, 99)]), f"WITH {C.STRENGTH}, {CV} SELECT method, {r6('quantile_cont(cv, 0.9) AS p90', 'quantile_cont(cv, 0.95) AS p95', 'quantile_cont(cv, 0.99) AS p99')} FROM cvs GROUP BY method")
add("r_regional_ranks", lambda s, d: plotdata.mean_ranks_of_areas(hubs(s, d), area_names(s), "grp"), f"WITH RECURSIVE {K.HUB}, {B.AREA_SQL}, mz AS (SELECT grp, node, round(avg(z), 9) AS z FROM hz GROUP BY grp, node), mr AS (SELECT grp, node, rank() OVER (PARTITION BY grp ORDER BY z DESC) + (count(*) OVER (PARTITION BY grp, z) - 1) / 2.0 AS rank FROM mz) SELECT grp, area, {r6('avg(rank) AS mean_rank')} FROM mr JOIN areas USING (node) GROUP BY grp, area")
add("r_subregional_means", lambda s, d: hubs(s, d).groupBy("grp", "node").agg(F.avg("z").alias("mean_z")).join(F.broadcast(area_names(s)), "node").select("grp", "area", "node", "mean_z"), f"WITH RECURSIVE {K.HUB}, {B.AREA_SQL}, mz AS (SELECT grp, node, avg(z) AS mean_z FROM hz GROUP BY grp, node) SELECT grp, area, node, {r6('mean_z')} FROM mz JOIN areas USING (node)")
add("r_average_network", lambda s, d: plotdata.average_network(B.corr2(s, d)[0]), f"WITH {B.CORR2}, av AS (SELECT method, i, j, avg(abs(r)) AS w FROM corr GROUP BY ALL), md AS (SELECT method, median(w) AS cut FROM av WHERE w > 0 GROUP BY method) SELECT method, i, j, {r6('w')} FROM av JOIN md USING (method) WHERE w > cut")
add("r_dual_network", lambda s, d: plotdata.dual_network(B.corr2(s, d)[0], "g0", "g1"), f"WITH {B.CORR2}, ew AS (SELECT method, grp, i, j, round(abs(r), 9) AS w FROM corr WHERE grp IN ('g0', 'g1')), md AS (SELECT method, grp, median(w) AS cut FROM ew WHERE w > 0 GROUP BY ALL), kp AS (SELECT method, grp, i, j FROM ew JOIN md USING (method, grp) WHERE round(w - cut, 9) > 0) SELECT method, i, j, CASE WHEN count(*) = 2 THEN 'both' WHEN min(grp) = 'g0' THEN 'first' ELSE 'second' END AS found FROM kp GROUP BY method, i, j")
add("r_group_percolation", percolated, f"{core.PERC} SELECT corr.method, corr.grp, i, j, {r6('abs(r) AS w', 'threshold')}, abs(r) >= threshold AS above FROM corr JOIN thr ON thr.grp = corr.grp")
add("r_area_edges", lambda s, d: plotdata.area_edges(B.cut_edges(s, d)[0], area_names(s), *KEY), f"WITH {B.EDGES}, {B.AREA_SQL}, en AS (SELECT method, grp, a.area AS x, b.area AS y FROM edges JOIN areas a ON a.node = src JOIN areas b ON b.node = dst), us AS (SELECT method, grp, x AS area, x = y AS inside FROM en UNION ALL SELECT method, grp, y, false FROM en WHERE x <> y) SELECT method, grp, area, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS external FROM us GROUP BY method, grp, area")
add("r_scaled_strengths", lambda s, d: plotdata.scaled(both(s, d), ["weighted", "percolation"], *KEY), f"WITH {C.PERC_ST}, x AS (SELECT method, grp, node, node_strength AS a, p AS b FROM st JOIN ps USING (method, grp, node)) SELECT method, grp, node, {r6('coalesce((a - min(a) OVER w) / nullif(max(a) OVER w - min(a) OVER w, 0), 0) AS weighted', 'coalesce((b - min(b) OVER w) / nullif(max(b) OVER w - min(b) OVER w, 0), 0) AS percolation')} FROM x WINDOW w AS (PARTITION BY method, grp)")
add("r_pooled_area_strength", lambda s, d: plotdata.area_means(both(s, d).unpivot([*KEY, "node"], ["weighted", "percolation"], "approach", "value"), "value", area_names(s), *KEY), f"WITH {C.PERC_ST}, {B.AREA_SQL}, v AS (SELECT method, grp, node, node_strength AS value FROM st UNION ALL SELECT method, grp, node, p FROM ps) SELECT method, grp, area, {r6('avg(value) AS mean', 'stddev_samp(value) / sqrt(count(*)) AS se')}, count(*) AS n FROM v JOIN areas USING (node) GROUP BY method, grp, area")
add("r_rank_agreement", lambda s, d: plotdata.rank_agreement(both(s, d).withColumn("percolation", F.round("percolation", 9)), "weighted", "percolation", *KEY), f"WITH {C.PERC_ST}, rr AS (SELECT method, grp, rank() OVER (PARTITION BY method, grp ORDER BY node_strength) + (count(*) OVER (PARTITION BY method, grp, node_strength) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method, grp ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY method, grp, round(p, 9)) - 1) / 2.0 AS ry FROM st JOIN ps USING (method, grp, node)) SELECT method, grp, count(*) AS n, {r6('corr(rx, ry) AS rho')} FROM rr GROUP BY method, grp HAVING count(*) >= 6")
add("r_conservation_pairs", both_pairs, f"WITH {C.PAIR}, {BOTH_PAIRS} SELECT method, g1, g2, {r6('jaccard', 'weighted_jaccard', 'weighted_jaccard - jaccard AS difference')} FROM cq")
add("r_conservation_summary", lambda s, d: plotdata.conservation_summary(both_pairs(s, d)), f"WITH {C.PAIR}, {BOTH_PAIRS} SELECT method, {r6('avg(jaccard) AS mean_jaccard', 'stddev_samp(jaccard) AS sd_jaccard', 'avg(weighted_jaccard) AS mean_weighted_jaccard', 'stddev_samp(weighted_jaccard) AS sd_weighted_jaccard', 'corr(jaccard, weighted_jaccard) AS correlation', 'avg(weighted_jaccard - jaccard) AS mean_difference')} FROM cq GROUP BY method")
add("r_test_log_p", lambda s, d: plotdata.minus_log_p(permute.adjust(permute.two_sample_test(K.two_sides(s, d), K.PERMS)), "p_adjusted"), f"WITH RECURSIVE {K.K2}, rr AS (SELECT node, p, row_number() OVER (ORDER BY p) AS rk FROM kt), ad AS (SELECT node, {K.BH} AS pa FROM rr) SELECT node, {r6('CASE WHEN pa > 0 THEN -log10(pa) ELSE 1.2 * max(CASE WHEN pa > 0 THEN -log10(pa) END) OVER () END AS minus_log10')} FROM ad")
add("r_approach_regressions", lambda s, d: plotdata.pairwise_regressions(K.scores(s, d), *KEY), f"WITH RECURSIVE {K.SCORES} SELECT a.method, a.grp, a.approach AS first, b.approach AS second, {r6('regr_slope(b.value, a.value) AS slope', 'regr_intercept(b.value, a.value) AS intercept', 'corr(a.value, b.value) AS r')} FROM sc a JOIN sc b ON a.method = b.method AND a.grp = b.grp AND a.node = b.node AND a.approach < b.approach GROUP BY a.method, a.grp, a.approach, b.approach")
add("r_persistence_box", lambda s, d: plotdata.quartiles(swept(s, d), "strength", *KEY, "step"), f"WITH {C.SWEEP} SELECT method, grp, step, {r6('quantile_cont(strength, 0.25) AS q1', 'median(strength) AS median', 'quantile_cont(strength, 0.75) AS q3', 'avg(strength) AS mean', 'stddev_samp(strength) AS sd')} FROM sw GROUP BY method, grp, step")
add("r_area_persistence", lambda s, d: plotdata.area_means(persistent(s, d), "value", area_names(s), *KEY), f"WITH RECURSIVE {K.SCORES}, {B.AREA_SQL} SELECT method, grp, area, {r6('avg(value) AS mean', 'stddev_samp(value) / sqrt(count(*)) AS se')}, count(*) AS n FROM sc JOIN areas USING (node) WHERE approach = 'persistence' GROUP BY method, grp, area")
