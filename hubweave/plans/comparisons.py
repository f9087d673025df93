"""Queries over threshold-free analyses, similarity, conservation and persistence, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubweave.operators import graph_metrics, kernels, network, persistence, similarity, threshold_free
from hubweave.plans import binding as B
from hubweave.plans import core
from hubweave.plans.binding import q, r6

Q, S = {}, {}


def add(name, build, sql=None):
    Q[name] = q(build)
    if sql:
        S[name] = sql


on_corr2 = core.on_corr2
STRENGTH = f"{B.CORR2}, fd AS (SELECT method, grp, i AS node, abs(r) AS w FROM corr UNION ALL SELECT method, grp, j, abs(r) FROM corr), st AS (SELECT method, grp, node, sum(w) AS node_strength, avg(w) AS avg_edge_weight, sum(w) / {B.DIMS - 1} AS normalized_strength FROM fd GROUP BY ALL)"

def hub_cons(source, value, n, by):
    return f"tp AS (SELECT method, grp, node FROM (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY {value} DESC, node) AS place FROM {source}) WHERE place <= {n}), gg AS (SELECT DISTINCT method, grp FROM tp) SELECT *, round(shared / {by}, 6) + 0.0 AS conservation FROM (SELECT a.method, a.grp AS g1, b.grp AS g2, CAST((SELECT count(*) FROM tp x JOIN tp y ON x.node = y.node WHERE x.method = a.method AND y.method = a.method AND x.grp = a.grp AND y.grp = b.grp) AS INTEGER) AS shared FROM gg a JOIN gg b ON a.method = b.method AND a.grp < b.grp)"


# G: threshold-free
G1 = f"""WITH {STRENGTH}, gn AS MATERIALIZED (SELECT method || '|' || grp AS net, i AS a, j AS b, abs(r) AS w FROM corr UNION ALL SELECT method || '|' || grp, j, i, abs(r) FROM corr),
gk AS (SELECT DISTINCT net, a AS node FROM gn), {B.eigen_sql('g', 'gn', 'gk')}, ge AS (SELECT split_part(net, '|', 1) AS method, split_part(net, '|', 2) AS grp, node, eigenvector FROM g_eig)"""
add("g1_weighted_eigenvector", on_corr2(lambda c, n: threshold_free.weighted_eigenvector(c)), f"""{G1}
SELECT method, grp, node, {r6('eigenvector AS weighted_eigenvector', 'node_strength', 'avg_edge_weight')}, CAST(rank() OVER (PARTITION BY method, grp ORDER BY round(eigenvector, 9) DESC) AS INTEGER) AS weighted_rank FROM ge JOIN st USING (method, grp, node)""")
add("g2_eigenvector_spread", on_corr2(lambda c, n: threshold_free.centrality_spread(threshold_free.weighted_eigenvector(c), "weighted_eigenvector")), f"""{G1}
SELECT method, node, {r6('avg(eigenvector) AS mean', 'stddev_samp(eigenvector) AS sd', 'stddev_samp(eigenvector) / avg(eigenvector) AS cv', 'min(eigenvector) AS min', 'max(eigenvector) AS max', 'max(eigenvector) - min(eigenvector) AS range')}, count(*) AS n_groups FROM ge GROUP BY method, node""")
add("g3_eigenvector_hubs", on_corr2(lambda c, n: threshold_free.pick_hubs(threshold_free.weighted_eigenvector(c).withColumn("weighted_eigenvector", F.round("weighted_eigenvector", 9)), "weighted_eigenvector", 10, 0.8)), f"""{G1},
p AS (SELECT method, grp, node, round(eigenvector, 9) AS e, row_number() OVER (PARTITION BY method, grp ORDER BY round(eigenvector, 9) DESC, node) AS place FROM ge)
SELECT method, grp, node, {r6('e AS weighted_eigenvector')} FROM p WHERE place <= 10 OR e >= 0.8""")
add("h6_eigenvector_hub_conservation", on_corr2(lambda c, n: similarity.hub_conservation(threshold_free.weighted_eigenvector(c).withColumn("value", F.round("weighted_eigenvector", 9)), "value", by_set=False)), f"""{G1},
hv AS (SELECT method, grp, node, round(eigenvector, 9) AS value FROM ge), {hub_cons('hv', 'value', 5, 5.0)}""")
add("g2_strength_spread", on_corr2(lambda c, n: threshold_free.centrality_spread(threshold_free.node_strength(c), "node_strength")), f"WITH {STRENGTH} SELECT method, node, {r6('avg(node_strength) AS mean', 'stddev_samp(node_strength) AS sd', 'stddev_samp(node_strength) / avg(node_strength) AS cv', 'min(node_strength) AS min', 'max(node_strength) AS max', 'max(node_strength) - min(node_strength) AS range')}, count(*) AS n_groups FROM st GROUP BY method, node")
add("g3_strength_hubs", on_corr2(lambda c, n: threshold_free.pick_hubs(threshold_free.node_strength(c), "node_strength", 3, 2.0)), f"WITH {STRENGTH}, p AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY node_strength DESC, node) AS place FROM st) SELECT method, grp, node, {r6('node_strength')} FROM p WHERE place <= 3 OR node_strength >= 2.0")
add("g5_node_strength", on_corr2(lambda c, n: threshold_free.node_strength(c)), f"WITH {STRENGTH} SELECT method, grp, node, {r6('node_strength', 'avg_edge_weight', 'normalized_strength')}, CAST(rank() OVER (PARTITION BY method, grp ORDER BY node_strength DESC) AS INTEGER) AS strength_rank FROM st")
PERC_ST = f"{STRENGTH}, ps AS (SELECT k.method, k.grp, k.node, coalesce(sum(w), 0) AS p FROM (SELECT DISTINCT method, grp, node FROM fd) k LEFT JOIN (SELECT * FROM fd WHERE w >= {B.CUT}) f USING (method, grp, node) GROUP BY ALL)"


def two_strengths(s, d):
    corr, _ = B.corr2(s, d)
    edges = network.threshold_network(corr, B.CUT)
    cut = graph_metrics.node_degrees(edges, graph_metrics.nodes_of(corr)).select("method", "grp", "node", F.col("strength").alias("value"))
    return threshold_free.node_strength(corr).select("method", "grp", "node", F.col("node_strength").alias("value")), cut


G4 = f"WITH {PERC_ST}, j AS (SELECT method, grp, node, p AS percolation, node_strength AS weighted, var_samp(p) OVER w AS vp, var_samp(node_strength) OVER w AS vw FROM ps JOIN st USING (method, grp, node) WINDOW w AS (PARTITION BY method, grp)), k AS (SELECT *, sqrt(percolation * weighted) AS geometric, coalesce((vp * percolation + vw * weighted) / nullif(vp + vw, 0), (percolation + weighted) / 2) AS vwt FROM j), l AS (SELECT *, rank() OVER (PARTITION BY method, grp ORDER BY vwt DESC) AS rk, rank() OVER (PARTITION BY method, grp ORDER BY percolation DESC) AS pr FROM k) SELECT method, grp, node, {r6('percolation', 'weighted', 'geometric', 'vwt AS variance_weighted')}, CAST(rk AS INTEGER) AS rank, CAST(pr AS INTEGER) AS percolation_rank, CAST(pr - rk AS INTEGER) AS difference FROM l"
add("g4_combined_centrality", lambda s, d: threshold_free.combined_centrality(*two_strengths(s, d)[::-1]), G4)
TREE = f"""{B.CORR2}, ke AS MATERIALIZED (SELECT method, grp, i, j, 1 - abs(r) AS w, row_number() OVER (PARTITION BY method, grp ORDER BY 1 - abs(r), i, j) AS k FROM corr WHERE 1 - abs(r) > 0),
kd AS MATERIALIZED (SELECT method, grp, i AS a, j AS b, k FROM ke UNION ALL SELECT method, grp, j, i, k FROM ke),
mm AS (SELECT method, grp, a, b, k, 0 AS turn FROM kd),
{', '.join(f"m{t + 1} AS MATERIALIZED (SELECT method, grp, a, b, min(k) AS k FROM (SELECT method, grp, a, b, k FROM {'kd' if t == 0 else f'm{t}'} UNION ALL SELECT x.method, x.grp, x.a, y.b, greatest(x.k, y.k) FROM {'kd' if t == 0 else f'm{t}'} x JOIN {'kd' if t == 0 else f'm{t}'} y ON x.method = y.method AND x.grp = y.grp AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)" for t in range(6))},
tree AS MATERIALIZED (SELECT ke.method, ke.grp, ke.i AS src, ke.j AS dst, ke.w FROM ke JOIN m6 ON m6.method = ke.method AND m6.grp = ke.grp AND m6.a = ke.i AND m6.b = ke.j AND m6.k = ke.k)"""
add("g7_spanning_trees", on_corr2(lambda c, n: threshold_free.spanning_trees(c)), f"WITH {TREE} SELECT method, grp, src, dst, {r6('w')} FROM tree")
T2 = "te AS (SELECT method, grp, src AS node, w FROM tree UNION ALL SELECT method, grp, dst, w FROM tree), td AS (SELECT method, grp, node, count(*) AS degree, sum(w) AS strength FROM te GROUP BY ALL)"
add("g7_central_nodes", on_corr2(lambda c, n: threshold_free.tree_central_nodes(threshold_free.spanning_trees(c))), f"""WITH {TREE}, {T2}, tp AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY degree DESC, node) AS place FROM td)
SELECT method, grp, node, degree, {r6('strength')}, CAST(place AS INTEGER) AS place FROM tp WHERE place <= 5""")
TD = [f"t{k + 1} AS MATERIALIZED (SELECT x.method, x.grp, x.a, y.b, min(x.d + y.d) AS d FROM t{k}_ x JOIN t{k}_ y ON x.method = y.method AND x.grp = y.grp AND x.b = y.a GROUP BY ALL)".replace("t0_", "td0").replace("_ ", " ") for k in range(6)]
add("g7_tree_summary", on_corr2(lambda c, n: threshold_free.tree_summary(threshold_free.spanning_trees(c), graph_metrics.nodes_of(c))), f"""WITH {TREE}, {T2},
td0 AS (SELECT method, grp, src AS a, dst AS b, w AS d FROM tree UNION ALL SELECT method, grp, dst, src, w FROM tree UNION ALL SELECT method, grp, node, node, 0 FROM td), {', '.join(TD)},
tl AS (SELECT method, grp, max(d) AS diameter, sum(d) / (count(*) - {B.DIMS}) AS mean_path FROM t6 GROUP BY ALL), tm AS (SELECT method, grp, max(degree) AS max_degree FROM td GROUP BY ALL)
SELECT method, grp, count(*) AS n_edges, {r6('any_value(diameter) AS diameter', 'any_value(mean_path) AS mean_path', 'sum(w) AS total_weight', 'avg(w) AS avg_weight')}, any_value(max_degree) AS max_degree
FROM tree JOIN tl USING (method, grp) JOIN tm USING (method, grp) GROUP BY method, grp""")
add("g8_pca", on_corr2(lambda c, n: kernels.pca(c, n)))
add("g9_cross_method_nodes", lambda s, d: threshold_free.cross_method_nodes(*two_strengths(s, d)), f"WITH {PERC_ST} SELECT method, grp, node, {r6('node_strength AS weighted', 'p AS percolation', 'node_strength - p AS difference', 'CASE WHEN p > 0 THEN node_strength / p END AS ratio')} FROM st JOIN ps USING (method, grp, node)")
add("g9_cross_method_correlation", lambda s, d: threshold_free.cross_method_correlation(threshold_free.cross_method_nodes(*two_strengths(s, d))), f"WITH {PERC_ST} SELECT method, grp, count(*) AS n, {r6('covar_pop(node_strength, p) / nullif(stddev_pop(node_strength) * stddev_pop(p), 0) AS r')} FROM st JOIN ps USING (method, grp, node) GROUP BY method, grp")

# H: similarity and conservation
PAIR = f"{B.CORR2}, pr AS (SELECT a.method, a.grp AS g1, b.grp AS g2, a.i, a.j, abs(a.r) AS w1, abs(b.r) AS w2 FROM corr a JOIN corr b ON a.method = b.method AND a.i = b.i AND a.j = b.j AND a.grp < b.grp)"
H1 = f"WITH {PAIR}, x AS (SELECT method, g1, g2, CAST(sum(CASE WHEN w1 > 0.21 AND w2 > 0.21 THEN 1 ELSE 0 END) AS BIGINT) AS shared, CAST(sum(CASE WHEN w1 > 0.21 OR w2 > 0.21 THEN 1 ELSE 0 END) AS BIGINT) AS either, CAST(sum(CASE WHEN w1 > 0.21 THEN 1 ELSE 0 END) AS BIGINT) AS edges1, CAST(sum(CASE WHEN w2 > 0.21 THEN 1 ELSE 0 END) AS BIGINT) AS edges2 FROM pr GROUP BY ALL) SELECT *, {r6('coalesce(shared / nullif(either, 0), 0) AS jaccard', 'coalesce(shared / nullif(least(edges1, edges2), 0), 0) AS overlap', 'coalesce(shared / nullif(edges1, 0), 0) AS preserved_1_2', 'coalesce(shared / nullif(edges2, 0), 0) AS preserved_2_1')} FROM x"
add("h1_binary_similarity", on_corr2(lambda c, n: similarity.binary_similarity(c, 0.21)), H1)
DEG2 = f"{B.CORR2}, dd AS (SELECT method, grp, i AS node, (abs(r) >= {B.CUT})::INT AS e, abs(r) AS w FROM corr UNION ALL SELECT method, grp, j, (abs(r) >= {B.CUT})::INT, abs(r) FROM corr), deg AS (SELECT method, grp, node, CAST(sum(e) AS BIGINT) AS degree, sum(CASE WHEN e = 1 THEN w ELSE 0 END) AS strength FROM dd GROUP BY ALL)"


def degrees2(corr):
    return graph_metrics.node_degrees(network.threshold_network(corr, B.CUT), graph_metrics.nodes_of(corr))


add("h2_hub_conservation", on_corr2(lambda c, n: similarity.hub_conservation(degrees2(c), "degree")), f"WITH {DEG2}, {hub_cons('deg', 'degree', 5, 5.0)}")
add("h3_conserved_edges", on_corr2(lambda c, n: similarity.conserved_edges(c, 0.21)), f"WITH {B.CORR2} SELECT method, i, j, count(*) AS n_groups, {r6('count(*) / 10.0 AS share')}, count(*) = 10 AS full, count(*) >= 5 AS majority FROM corr WHERE abs(r) > 0.21 GROUP BY method, i, j")
H5 = f"WITH {PAIR}, x AS (SELECT method, g1, g2, sum(least(w1, w2)) AS lo, sum(greatest(w1, w2)) AS hi, sum(w1) AS t1, sum(w2) AS t2, avg(abs(w1 - w2)) AS md, covar_pop(w1, w2) / (stddev_pop(w1) * stddev_pop(w2)) AS c FROM pr GROUP BY ALL) SELECT method, g1, g2, {r6('lo / hi AS weighted_jaccard', 'lo / least(t1, t2) AS overlap', 'c AS correlation', 'lo / t1 AS preserved_1_2', 'lo / t2 AS preserved_2_1', 'md AS mean_difference', 't1 AS total1', 't2 AS total2')} FROM x"
add("h5_weighted_similarity", on_corr2(lambda c, n: similarity.weighted_similarity(c)), H5)
add("h6_weighted_hub_conservation", on_corr2(lambda c, n: similarity.hub_conservation(threshold_free.node_strength(c), "node_strength", by_set=False)), f"WITH {STRENGTH}, {hub_cons('st', 'node_strength', 5, 5.0)}")
add("h7_edge_weight_statistics", on_corr2(lambda c, n: similarity.edge_weight_statistics(c)), f"WITH {B.CORR2}, w AS (SELECT method, grp, abs(r) AS w FROM corr) SELECT method, grp, {r6('avg(w) AS mean', 'median(w) AS median', 'stddev_samp(w) AS sd', 'min(w) AS min', 'max(w) AS max', 'sum(w) AS sum')}, count(w) AS count, count(*) FILTER (w > 0.3) AS over_03, count(*) FILTER (w > 0.5) AS over_05, count(*) FILTER (w > 0.7) AS over_07 FROM w GROUP BY method, grp")
H9 = f"""WITH {DEG2}, ee AS (SELECT method, grp, i, j, (abs(r) >= {B.CUT})::INT AS e FROM corr), x AS (SELECT a.method, a.grp AS g1, b.grp AS g2, sum(a.e * b.e) AS s, sum(a.e) AS n1, sum(b.e) AS n2 FROM ee a JOIN ee b ON a.method = b.method AND a.i = b.i AND a.j = b.j AND a.grp < b.grp GROUP BY ALL),
drk AS (SELECT method, grp, node, rank() OVER (PARTITION BY method, grp ORDER BY degree) + (count(*) OVER (PARTITION BY method, grp, degree) - 1) / 2.0 AS rk FROM deg),
dc AS (SELECT a.method, a.grp AS g1, b.grp AS g2, covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0) AS dc FROM drk a JOIN drk b ON a.method = b.method AND a.node = b.node AND a.grp < b.grp GROUP BY ALL),
tr AS (SELECT a.method, a.grp, count(*) AS t FROM ee a JOIN ee b ON a.method = b.method AND a.grp = b.grp AND a.j = b.i AND a.e = 1 AND b.e = 1 JOIN ee c ON c.method = a.method AND c.grp = a.grp AND c.i = a.i AND c.j = b.j AND c.e = 1 GROUP BY ALL),
gl AS (SELECT d.method, d.grp, sum(degree) / {2.0 * B.PAIRS} AS dens, CASE WHEN sum(degree * (degree - 1)) = 0 THEN 0 ELSE 3.0 * coalesce(max(t), 0) / (sum(degree * (degree - 1)) / 2.0) END AS clu FROM deg d LEFT JOIN tr ON d.method = tr.method AND d.grp = tr.grp GROUP BY d.method, d.grp),
sim AS (SELECT x.method, x.g1, x.g2, coalesce(s / nullif(n1 + n2 - s, 0), 0) AS jaccard, coalesce(2.0 * s / nullif(n1 + n2, 0), 0) AS dice, dc AS degree_correlation, abs(u.dens - v.dens) AS density_difference, abs(u.clu - v.clu) AS clustering_difference FROM x JOIN dc USING (method, g1, g2) JOIN gl u ON u.method = x.method AND u.grp = g1 JOIN gl v ON v.method = x.method AND v.grp = g2)"""


def sim9(s, d):
    corr, _ = B.corr2(s, d)
    edges, nodes = network.threshold_network(corr, B.CUT), graph_metrics.nodes_of(corr)
    globals_ = graph_metrics.density(edges, nodes).join(graph_metrics.transitivity(edges, nodes).withColumnRenamed("transitivity", "clustering"), ["method", "grp"])
    return similarity.network_similarity(corr, degrees2(corr), globals_, B.CUT)


add("h9_network_similarity", sim9, f"{H9} SELECT method, g1, g2, {r6('jaccard', 'dice', 'degree_correlation', 'density_difference', 'clustering_difference')} FROM sim")
H9COLS = ["jaccard", "dice", "degree_correlation", "density_difference", "clustering_difference"]
add("h9_similarity_over_methods", lambda s, d: similarity.similarity_over_methods(sim9(s, d)), f"{H9} SELECT g1, g2, {r6(*[f'avg({c}) AS mean_{c}' for c in H9COLS], *[f'stddev_samp({c}) AS sd_{c}' for c in H9COLS])} FROM sim GROUP BY g1, g2")


def agg10(s, d):
    corr, nodes = B.corr2(s, d)
    edges = network.threshold_network(corr, B.CUT)
    k = graph_metrics.nodes_of(corr)
    g = graph_metrics.density(edges, k).join(graph_metrics.transitivity(edges, k).withColumnRenamed("transitivity", "clustering"), ["method", "grp"])
    return similarity.metric_aggregation(g, ["density", "clustering", "n_edges"])


H10 = f"{H9}, lg AS (SELECT method, grp, unnest(['density', 'clustering', 'n_edges']) AS metric, unnest([dens, clu, dens * {B.PAIRS}.0]) AS value FROM gl), ag AS (SELECT grp, metric, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, count(*) AS n_methods, abs(stddev_samp(value) / nullif(avg(value), 0)) AS cv FROM lg GROUP BY grp, metric) SELECT grp, metric, {r6('mean', 'sd', 'cv', 'mn AS min', 'mx AS max', 'mx - mn AS range')}, n_methods, CASE WHEN cv <= 0.15 THEN 'very high' WHEN cv <= 0.30 THEN 'high' WHEN cv <= 0.50 THEN 'moderate' WHEN cv IS NOT NULL THEN 'low' END AS robustness FROM ag"
add("h10_metric_aggregation", agg10, H10)
NETS = f"{B.CORR2}, {core.NETS}, jx AS (SELECT a.matrix_key, a.method, a.approach, a.threshold, a.grp AS g1, b.grp AS g2, coalesce(sum(least(a.w, b.w)) / nullif(sum(greatest(a.w, b.w)), 0), 0) AS jaccard FROM nets a JOIN nets b ON a.matrix_key = b.matrix_key AND a.i = b.i AND a.j = b.j AND a.grp < b.grp GROUP BY ALL)"


def on_nets(f):
    return lambda s, d: f(core.networks(s, d)[0])


add("h11_thresholded_jaccard", on_corr2(lambda c, n: similarity.thresholded_jaccard(c.select("method", "grp", "i", "j", F.col("r").alias("w")), "method", threshold=0.21)), f"WITH {PAIR}, x AS (SELECT method, g1, g2, CASE WHEN w1 >= 0.21 THEN w1 ELSE 0 END AS a, CASE WHEN w2 >= 0.21 THEN w2 ELSE 0 END AS b FROM pr) SELECT method, g1, g2, {r6('coalesce(sum(least(a, b)) / nullif(sum(greatest(a, b)), 0), 0) AS jaccard')} FROM x GROUP BY method, g1, g2")
add("h12_matrix_jaccard", on_nets(lambda n: similarity.thresholded_jaccard(n, "matrix_key")), f"WITH {NETS} SELECT matrix_key, g1, g2, {r6('jaccard')} FROM jx")
add("h13_balanced_jaccard", on_nets(similarity.averaged_jaccard), f"WITH {NETS}, a AS (SELECT g1, g2, approach, avg(jaccard) AS jaccard FROM jx GROUP BY ALL) SELECT g1, g2, {r6('avg(jaccard) AS jaccard')} FROM a GROUP BY g1, g2")
add("h14_approach_jaccard", on_nets(lambda n: similarity.thresholded_jaccard(n, "matrix_key", "approach").groupBy("approach", "g1", "g2").agg(F.avg("jaccard").alias("jaccard"))), f"WITH {NETS} SELECT approach, g1, g2, {r6('avg(jaccard) AS jaccard')} FROM jx GROUP BY approach, g1, g2")
add("h16_flat_jaccard", on_nets(lambda n: similarity.averaged_jaccard(n, "flat")), f"WITH {NETS} SELECT g1, g2, {r6('avg(jaccard) AS jaccard')} FROM jx GROUP BY g1, g2")
add("h17_persistence_auc_jaccard", on_nets(similarity.persistence_auc_jaccard), f"WITH {NETS}, l AS (SELECT *, lead(threshold) OVER w AS nt, lead(jaccard) OVER w AS nj FROM jx WHERE approach = 'persistence' WINDOW w AS (PARTITION BY method, g1, g2 ORDER BY threshold)) SELECT method, g1, g2, {r6('sum((nt - threshold) * (jaccard + nj) / 2) / (max(threshold) - min(threshold)) AS auc')} FROM l GROUP BY method, g1, g2")
add("h18_group_similarity_matrix", on_nets(similarity.group_similarity_matrix), f"WITH {NETS}, f AS (SELECT g1, g2, avg(jaccard) AS s FROM jx GROUP BY g1, g2) SELECT g1, g2, {r6('s AS similarity')} FROM (SELECT g1, g2, s FROM f UNION ALL SELECT g2, g1, s FROM f UNION ALL SELECT DISTINCT grp, grp, 1.0 FROM nets)")
H19 = f"WITH {B.CORR2}, {core.NETS}, {B.AREA_SQL}, dr AS (SELECT matrix_key, grp, area, node, i, j, w FROM (SELECT *, i AS node FROM nets UNION ALL SELECT *, j FROM nets) JOIN areas USING (node)), x AS (SELECT a.matrix_key, a.area, a.grp AS g1, b.grp AS g2, sum(least(a.w, b.w)) AS lo, sum(greatest(a.w, b.w)) AS hi FROM dr a JOIN dr b ON a.matrix_key = b.matrix_key AND a.area = b.area AND a.node = b.node AND a.i = b.i AND a.j = b.j AND a.grp < b.grp GROUP BY ALL) SELECT area, g1, g2, {r6('avg(lo / hi) AS jaccard')} FROM x WHERE hi > 0 GROUP BY area, g1, g2"
add("h19_regional_jaccard", lambda s, d: similarity.regional_jaccard(core.networks(s, d)[0], B.areas(s)), H19)


def hubs20(s, d):
    corr, _ = B.pearson(s, d)
    hubs = similarity.hub_sets(threshold_free.node_strength(corr), "node_strength", 0.8, "method", "grp")
    return similarity.hub_overlap(hubs.select("grp", "node"), corr.select("grp").distinct())


HUBS = f"{STRENGTH}, zz AS (SELECT method, grp, node, (node_strength - avg(node_strength) OVER w) / stddev_samp(node_strength) OVER w AS z FROM st WINDOW w AS (PARTITION BY method, grp)), hb AS (SELECT grp, node FROM zz WHERE z >= 0.8 AND method = 'pearson'), gg AS (SELECT DISTINCT grp FROM corr)"
H20 = f"WITH {HUBS}, hl AS (SELECT grp, coalesce(list(node ORDER BY node) FILTER (node IS NOT NULL), []) AS h FROM gg LEFT JOIN hb USING (grp) GROUP BY grp), p AS (SELECT a.grp AS g1, b.grp AS g2, a.h AS h1, b.h AS h2, list_sort(list_intersect(a.h, b.h)) AS sh FROM hl a JOIN hl b ON a.grp < b.grp) SELECT g1, g2, CAST(len(h1) AS INTEGER) AS n1, CAST(len(h2) AS INTEGER) AS n2, CAST(len(sh) AS INTEGER) AS n_shared, CAST(len(h1) + len(h2) - len(sh) AS INTEGER) AS n_either, {r6('coalesce(len(sh) / nullif(len(h1) + len(h2) - len(sh), 0), 0) AS jaccard')}, array_to_string(sh, ',') AS shared, array_to_string(list_filter(h1, lambda x: NOT list_contains(h2, x)), ',') AS only_1, array_to_string(list_filter(h2, lambda x: NOT list_contains(h1, x)), ',') AS only_2 FROM p"
add("h20_hub_overlap", hubs20, H20)
add("h21_hub_sets", on_corr2(lambda c, n: similarity.hub_sets(threshold_free.node_strength(c), "node_strength", 1.0, "method", "grp")), f"WITH {STRENGTH}, z AS (SELECT method, grp, node, (node_strength - avg(node_strength) OVER w) / stddev_samp(node_strength) OVER w AS z FROM st WINDOW w AS (PARTITION BY method, grp)) SELECT method, grp, node, {r6('z')} FROM z WHERE z >= 1.0")

# I: persistence
SWEEP = f"{B.CORR2}, grid AS (SELECT CAST(k AS INTEGER) AS step, 0.052::DOUBLE + k * 0.05::DOUBLE AS threshold FROM (SELECT unnest(range(0, 8)) AS k)), se AS (SELECT method, grp, step, threshold, i, j, abs(r) AS w FROM corr JOIN grid ON abs(r) >= threshold AND abs(r) > 0), sd AS (SELECT method, grp, step, threshold, i AS node, w FROM se UNION ALL SELECT method, grp, step, threshold, j, w FROM se), sw AS (SELECT k.method, k.grp, k.step, k.threshold, n.node, count(w) AS degree, coalesce(sum(w), 0) AS strength FROM (SELECT DISTINCT method, grp, step, threshold FROM se) k CROSS JOIN (SELECT DISTINCT node FROM obs) n LEFT JOIN sd ON sd.method = k.method AND sd.grp = k.grp AND sd.step = k.step AND sd.node = n.node GROUP BY ALL)"


def sweep(s, d):
    corr, nodes = B.corr2(s, d)
    grid = persistence.threshold_grid(s, 0.052, 0.05, 8)
    return corr, nodes, grid, persistence.swept_degrees(corr, grid)


add("i1_persistence_sweep", lambda s, d: sweep(s, d)[3], f"WITH {SWEEP} SELECT method, grp, step, {r6('threshold')}, node, degree, {r6('strength')} FROM sw")
add("i1_swept_node_metrics", lambda s, d: persistence.swept_node_metrics(*(lambda c, n, g, w: (c, g, n))(*sweep(s, d))))
add("i2_hub_persistence", lambda s, d: persistence.hub_persistence(sweep(s, d)[3], "strength", 4), f"WITH {SWEEP}, p AS (SELECT *, row_number() OVER (PARTITION BY method, grp, step ORDER BY strength DESC, node) AS place FROM sw), n AS (SELECT method, grp, count(DISTINCT step) AS steps FROM sw GROUP BY ALL) SELECT method, grp, node, {r6('count(*) / max(steps) AS score', 'min(threshold) AS min_threshold', 'max(threshold) AS max_threshold', 'max(threshold) - min(threshold) AS threshold_range')} FROM p JOIN n USING (method, grp) WHERE place <= 4 GROUP BY method, grp, node")
I3 = f"WITH {SWEEP}, r AS (SELECT *, rank() OVER (PARTITION BY method, grp, step ORDER BY degree DESC) + (count(*) OVER (PARTITION BY method, grp, step, degree) - 1) / 2.0 AS rk FROM sw), t AS (SELECT *, 1 - (rk - 1) / {B.DIMS - 1.0} AS sc FROM r) SELECT method, grp, node, {r6('avg(rk) AS mean_rank', 'median(rk) AS median_rank', 'min(rk) AS best_rank', 'max(rk) AS worst_rank', 'avg(sc) AS mean_score', 'median(sc) AS median_score', '1 - stddev_samp(sc) AS stability', 'min(threshold) AS first', 'max(threshold) AS last', 'count(*) / 8.0 AS persistence_rate')} FROM t GROUP BY method, grp, node"
add("i3_importance_evolution", lambda s, d: persistence.importance_evolution(sweep(s, d)[3], "degree", sweep(s, d)[2]), I3)
add("i4_metrics_evolution", lambda s, d: persistence.metrics_evolution(persistence.swept_global_metrics(*(lambda c, n, g, w: (c, g, n))(*sweep(s, d)))))


def swept_globals(s, d):
    corr, nodes, grid, _ = sweep(s, d)
    edges = persistence.swept_edges(corr, grid)
    k = persistence.swept_nodes(corr, edges)
    return graph_metrics.density(edges, k, persistence.SWEPT).join(graph_metrics.transitivity(edges, k, persistence.SWEPT).withColumnRenamed("transitivity", "clustering"), list(persistence.SWEPT))


GLOB = f"{SWEEP}, tr AS (SELECT a.method, a.grp, a.step, count(*) AS t FROM se a JOIN se b ON a.method = b.method AND a.grp = b.grp AND a.step = b.step AND a.j = b.i JOIN se c ON c.method = a.method AND c.grp = a.grp AND c.step = a.step AND c.i = a.i AND c.j = b.j GROUP BY ALL), gl AS (SELECT s.method, s.grp, s.step, s.threshold, sum(degree) / {2.0 * B.PAIRS} AS density, CASE WHEN sum(degree * (degree - 1)) = 0 THEN 0 ELSE 3.0 * coalesce(max(t), 0) / (sum(degree * (degree - 1)) / 2.0) END AS clustering FROM sw s LEFT JOIN tr USING (method, grp, step) GROUP BY ALL)"
add("i5_aggregated_metrics", lambda s, d: persistence.aggregated_metrics(sweep(s, d)[3], swept_globals(s, d)), f"""WITH {GLOB},
g AS (SELECT *, CASE WHEN clustering * density > 0 THEN clustering * density ELSE 0.01 END AS wt, count(*) OVER (PARTITION BY method, grp) AS steps FROM gl)
SELECT method, grp, node, {r6('sum(strength * wt) / sum(wt) AS mean_strength', 'avg(wt) AS stability', 'count(*) / any_value(steps) AS appearance_rate')}
FROM sw JOIN g USING (method, grp, step) GROUP BY method, grp, node""")
SE = f"""{SWEEP}, xn AS MATERIALIZED (SELECT method || '|' || grp || '|' || step AS net, i AS a, j AS b, w FROM se UNION ALL SELECT method || '|' || grp || '|' || step, j, i, w FROM se),
xk AS (SELECT * FROM (SELECT DISTINCT net FROM xn), (SELECT DISTINCT node FROM obs)), {B.eigen_sql('x', 'xn', 'xk')},
xw AS (SELECT sw.*, eigenvector FROM sw JOIN x_eig ON x_eig.net = sw.method || '|' || sw.grp || '|' || sw.step AND x_eig.node = sw.node)"""


def swept5(s, d):
    corr, _ = B.corr2(s, d)
    return persistence.swept_scores(corr, persistence.threshold_grid(s, 0.052, 0.05, 8))


add("i1_swept_eigenvectors", swept5, f"WITH {SE} SELECT method, grp, step, {r6('threshold')}, node, degree, {r6('strength', 'eigenvector')} FROM xw")
add("i5_aggregated_eigenvector", lambda s, d: persistence.aggregated_metrics(swept5(s, d), swept_globals(s, d), ("eigenvector", "strength")), f"""WITH {GLOB}, {SE[len(SWEEP) + 2:]},
g AS (SELECT *, CASE WHEN clustering * density > 0 THEN clustering * density ELSE 0.01 END AS wt, count(*) OVER (PARTITION BY method, grp) AS steps FROM gl)
SELECT method, grp, node, {r6('sum(eigenvector * wt) / sum(wt) AS mean_eigenvector', 'sum(strength * wt) / sum(wt) AS mean_strength', 'avg(wt) AS stability', 'count(*) / any_value(steps) AS appearance_rate')}
FROM xw JOIN g USING (method, grp, step) GROUP BY method, grp, node""")
add("i6_eigenvector_auc", lambda s, d: persistence.node_auc(swept5(s, d), "eigenvector"), f"""WITH {SE},
l AS (SELECT *, eigenvector AS v, lead(threshold) OVER w AS nt, lead(eigenvector) OVER w AS nv FROM xw WINDOW w AS (PARTITION BY method, grp, node ORDER BY threshold))
SELECT method, grp, node, {r6('coalesce(sum((nt - threshold) * (v + nv) / 2), 0) AS auc', 'avg(v) AS mean', 'stddev_samp(v) AS sd')} FROM l GROUP BY method, grp, node""")
TRAP = "lead(threshold) OVER w AS nt, lead(v) OVER w AS nv"
add("i6_global_auc", lambda s, d: persistence.trapezoid(swept_globals(s, d), "density", "method", "grp"), f"WITH {GLOB}, l AS (SELECT *, density AS v, lead(threshold) OVER w AS nt, lead(density) OVER w AS nv FROM gl WINDOW w AS (PARTITION BY method, grp ORDER BY threshold)) SELECT method, grp, {r6('coalesce(sum((nt - threshold) * (v + nv) / 2), 0) AS auc', 'avg(v) AS mean', 'stddev_samp(v) AS sd')} FROM l GROUP BY method, grp")
add("i6_node_auc", lambda s, d: persistence.node_auc(sweep(s, d)[3], "degree"), f"WITH {SWEEP}, l AS (SELECT *, degree AS v, lead(threshold) OVER w AS nt, lead(degree) OVER w AS nv FROM sw WINDOW w AS (PARTITION BY method, grp, node ORDER BY threshold)) SELECT method, grp, node, {r6('coalesce(sum((nt - threshold) * (v + nv) / 2), 0) AS auc', 'avg(v) AS mean', 'stddev_samp(v) AS sd')} FROM l GROUP BY method, grp, node")
add("i7_zero_filled_auc", lambda s, d: persistence.zero_filled_auc(sweep(s, d)[3], "strength", graph_metrics.nodes_of(B.corr2(s, d)[0]), sweep(s, d)[2]), f"WITH {SWEEP}, f AS (SELECT k.method, k.grp, k.node, g.step, g.threshold, coalesce(strength, 0) AS v FROM (SELECT DISTINCT method, grp, node FROM (SELECT method, grp FROM corr), (SELECT node FROM obs)) k CROSS JOIN grid g LEFT JOIN sw ON sw.method = k.method AND sw.grp = k.grp AND sw.node = k.node AND sw.step = g.step), l AS (SELECT *, lead(threshold) OVER w AS nt, lead(v) OVER w AS nv FROM f WINDOW w AS (PARTITION BY method, grp, node ORDER BY threshold)) SELECT method, grp, node, {r6('coalesce(sum((nt - threshold) * (v + nv) / 2), 0) AS auc')} FROM l GROUP BY method, grp, node")
