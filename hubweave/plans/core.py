"""Queries over observations, correlations, networks and graph metrics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubweave.functions.stats import z_score
from hubweave.operators import consensus_matrix, correlate, graph_metrics, impute, kernels, network, spread
from hubweave.plans import binding as B
from hubweave.plans.binding import q, r6
from hubweave.sources.observations import to_long, to_vectors

Q, S = {}, {}


def add(name, build, sql=None):
    Q[name] = q(build)
    if sql:
        S[name] = sql


def on_edges(f):
    return lambda s, d: f(*B.cut_edges(s, d))


def on_pearson(f):
    return lambda s, d: f(*B.pearson(s, d))


def on_corr2(f):
    return lambda s, d: f(*B.corr2(s, d))


# A, B: observations and cleaning
add("a1_observations", lambda s, d: to_long(*B.obs(s, d)), f"WITH {B.OBS} SELECT grp, subject, node, {r6('value')} FROM obs")
add("a2_group_filter", lambda s, d: to_long(B.obs(s, d)[0].where("grp = 'g3'"), B.obs(s, d)[1]), f"WITH {B.OBS} SELECT grp, subject, node, {r6('value')} FROM obs WHERE grp = 'g3'")
add("b1_mean_fill", lambda s, d: impute.mean_fill(B.long_gappy(s, d)), f"WITH {B.GAPPY} SELECT grp, subject, node, {r6('coalesce(value, avg(value) OVER (PARTITION BY node)) AS value')} FROM gap")
add("b2_pmm_imputation", lambda s, d: to_long(impute.predictive_mean_matching(*B.gappy(s, d)), B.gappy(s, d)[1]))
add("b3_missing_profile", lambda s, d: impute.missing_profile(B.long_gappy(s, d)), f"WITH {B.GAPPY} SELECT node, count(*) FILTER (value IS NULL) AS n_missing, count(*) AS n_total FROM gap GROUP BY node")
add("b4_standardise", lambda s, d: impute.standardised(B.long_gappy(s, d)), f"WITH {B.GAPPY}, f AS (SELECT grp, subject, node, coalesce(value, avg(value) OVER (PARTITION BY node)) AS value FROM gap) SELECT grp, subject, node, {r6('(value - avg(value) OVER (PARTITION BY node)) / stddev_samp(value) OVER (PARTITION BY node) AS value')} FROM f")
add("b5_complete_cases", lambda s, d: impute.complete_cases(B.gappy(s, d)[0]).select("grp", "subject"), f"WITH {B.GAPPY} SELECT grp, subject FROM gap GROUP BY grp, subject HAVING count(value) = {B.DIMS}")
add("b6_pairwise_pearson", lambda s, d: correlate.biweight(*B.gappy(s, d)), f"WITH {B.GAPPY}, {B.corr_sql('c', 'gap', 'biweight')} SELECT method, grp, i, j, {r6('r')} FROM c")
add("b7_shrinkage_check", lambda s, d: impute.shrinkage_admissible(B.long_gappy(s, d)), f"WITH {B.GAPPY}, p AS (SELECT grp, node, count(*) AS n, count(*) FILTER (value IS NULL) AS bad, var_samp(value) AS v FROM gap GROUP BY grp, node) SELECT grp, max(n) AS n, round(min(v), 6) + 0.0 AS worst_variance, (max(n) >= 3 AND sum(bad) = 0 AND min(v) >= 2.220446049250313e-14) AS admissible FROM p GROUP BY grp")

# C: correlations
COMPLETE = f"{B.GAPPY}, cc AS (SELECT gap.* FROM gap JOIN (SELECT grp, subject FROM gap GROUP BY grp, subject HAVING count(value) = {B.DIMS}) k USING (grp, subject))"
add("c1_pearson", lambda s, d: correlate.pearson(*B.gappy(s, d)), f"WITH {COMPLETE}, {B.corr_sql('c', 'cc', 'pearson')} SELECT method, grp, i, j, {r6('r')} FROM c")
TIED = f"{B.OBS}, tied AS (SELECT grp, subject, node, round(value, 1) AS value FROM obs)"
add("c2_spearman", lambda s, d: correlate.spearman(*B.tied(s, d)), f"WITH {TIED}, {B.rank_sql('rk', 'tied')}, {B.corr_sql('c', 'rk', 'spearman')} SELECT method, grp, i, j, {r6('r')} FROM c")
KENDALL = f"""WITH {TIED}, p AS (SELECT a.grp, a.node AS i, b.node AS j, a.subject, a.value AS x, b.value AS y FROM tied a JOIN tied b ON a.grp = b.grp AND a.subject = b.subject AND a.node < b.node),
k AS (SELECT u.grp, u.i, u.j, sum(sign(u.x - v.x) * sign(u.y - v.y)) AS s, sum(abs(sign(u.x - v.x))) AS nx, sum(abs(sign(u.y - v.y))) AS ny FROM p u JOIN p v ON u.grp = v.grp AND u.i = v.i AND u.j = v.j AND u.subject < v.subject GROUP BY ALL)
SELECT 'kendall' AS method, grp, i, j, {r6('CASE WHEN nx * ny = 0 THEN NULL ELSE s / sqrt(nx * ny) END AS r')} FROM k"""
add("c3_kendall", lambda s, d: correlate.kendall(*B.tied(s, d)), KENDALL)
BICOR = f"""WITH {B.OBS}, m AS (SELECT *, value - median(value) OVER (PARTITION BY grp, node) AS d FROM obs), a AS (SELECT *, median(abs(d)) OVER (PARTITION BY grp, node) AS mad FROM m),
w AS (SELECT grp, subject, node, CASE WHEN abs(d / (9 * mad)) < 1 THEN d * (1 - (d / (9 * mad)) * (d / (9 * mad))) * (1 - (d / (9 * mad)) * (d / (9 * mad))) ELSE 0 END AS value FROM a)
SELECT 'bicor' AS method, x.grp, x.node AS i, y.node AS j, round(sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))), 6) + 0.0 AS r FROM w x JOIN w y ON x.grp = y.grp AND x.subject = y.subject AND x.node < y.node GROUP BY x.grp, x.node, y.node"""
add("c4_bicor", lambda s, d: correlate.bicor(*B.obs(s, d)), BICOR)
SHRINK = f"""WITH {B.OBS}, z AS (SELECT grp, subject, node, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM obs WINDOW w AS (PARTITION BY grp, node)),
p AS (SELECT x.grp, x.node AS i, y.node AS j, avg(x.value * y.value) AS a, avg(x.value * y.value * x.value * y.value) AS qq, count(*) AS n FROM z x JOIN z y ON x.grp = y.grp AND x.subject = y.subject AND x.node < y.node GROUP BY x.grp, x.node, y.node),
l AS (SELECT grp, least(1, greatest(0, (sum(qq) - sum(a * a)) / sum(a * a) / (max(n) - 1))) AS lam FROM p GROUP BY grp)
SELECT 'shrinkage' AS method, grp, i, j, {r6('(1 - lam) * a * n / (n - 1) AS r')} FROM p JOIN l USING (grp)"""
add("c5_shrinkage", lambda s, d: correlate.shrinkage(*B.obs(s, d)), SHRINK)


def coarse(s, d):
    """Observations in two groups, even and odd labels: a partial correlation needs more subjects than nodes."""
    rows, nodes = B.obs(s, d)
    return rows.withColumn("grp", F.concat(F.lit("p"), (F.substring("grp", 2, 9).cast("int") % 2).cast("string"))), nodes


add("c6_partial", lambda s, d: correlate.partial(*coarse(s, d)))
add("c7_all_methods", lambda s, d: correlate.correlations(*B.obs(s, d), ("pearson", "spearman", "biweight")), f"WITH {B.CORR2}, {B.corr_sql('bw', 'obs', 'biweight')} SELECT method, grp, i, j, {r6('r')} FROM (SELECT * FROM corr UNION ALL SELECT * FROM bw)")
add("c10_significance", lambda s, d: correlate.significance(*B.obs(s, d)).drop("p"), f"WITH {B.PEARSON}, n AS (SELECT grp, count(DISTINCT subject) AS n FROM obs GROUP BY grp) SELECT grp, i, j, n, {r6('r', 'r * sqrt(n - 2) / sqrt(1 - r * r) AS t', 'tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS ci_low', 'tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS ci_high')} FROM corr JOIN n USING (grp)")
add("c10_p_values", lambda s, d: correlate.significance(*B.obs(s, d)))
add("c11_method_advice", lambda s, d: correlate.data_profile(*B.tied(s, d)), f"WITH {TIED}, p AS (SELECT grp, node, count(value) AS n, count(DISTINCT value) AS d FROM tied GROUP BY grp, node), a AS (SELECT grp, max(n) AS n, count(*) AS p, avg(1 - d / n) AS tie, count(*) FILTER (d <= 1) AS constant_nodes FROM p GROUP BY grp) SELECT grp, n, p, {r6('tie AS tie_ratio')}, constant_nodes, CASE WHEN constant_nodes > 0 THEN 'pairwise' WHEN n <= p + 5 THEN 'shrinkage' WHEN tie > 0.2 THEN 'kendall' WHEN n < 30 THEN 'spearman' ELSE 'partial' END AS advice FROM a")

# E: consensus over methods
add("e1_consensus", on_corr2(lambda c, n: consensus_matrix.consensus(c)), f"WITH {B.CORR2} SELECT grp, i, j, {r6('median(r) AS r')} FROM corr GROUP BY grp, i, j")
add("e3_consensus_metadata", on_corr2(lambda c, n: consensus_matrix.consensus_metadata(c)), f"WITH {B.CORR2}, m AS (SELECT grp, i, j, median(r) AS r FROM corr GROUP BY ALL) SELECT grp, count(*) AS total_pairs, {r6('avg(abs(r)) AS mean_abs_r')}, count(*) FILTER (abs(r) >= 0.4) AS strong, {r6('count(*) FILTER (abs(r) >= 0.4) / count(*) AS density')}, (SELECT count(DISTINCT method) FROM corr) AS n_methods FROM m GROUP BY grp")
add("e4_common_methods", on_corr2(lambda c, n: consensus_matrix.common_methods(c)), f"WITH {B.CORR2} SELECT method FROM corr GROUP BY method HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM corr)")

# D: thresholds and networks
CURVE = f"""{B.PEARSON}, grid AS (SELECT unnest(range(1, 96)) AS step), e AS (SELECT grp, step, i, j FROM corr, grid WHERE abs(r) >= step / 100.0),
d2 AS (SELECT grp, step, i AS a, j AS b FROM e UNION ALL SELECT grp, step, j, i FROM e),
reach AS (SELECT DISTINCT grp, step, node, node AS other FROM obs, grid)"""
REACH = CURVE.replace("reach AS (SELECT DISTINCT grp, step, node, node AS other FROM obs, grid)", "reach AS (SELECT DISTINCT grp, step, node, node AS other FROM obs, grid UNION SELECT r.grp, r.step, r.node, d2.b FROM reach r JOIN d2 ON r.grp = d2.grp AND r.step = d2.step AND r.other = d2.a)")
COMP = f"lab AS (SELECT grp, step, node, min(other) AS comp FROM reach GROUP BY ALL), sz AS (SELECT grp, step, comp, count(*) AS n FROM lab GROUP BY ALL), crv AS (SELECT sz.grp, sz.step, max(n) / {B.DIMS}.0 AS giant, count(*) AS n_components FROM sz GROUP BY sz.grp, sz.step), crv2 AS (SELECT crv.*, coalesce(m, 0) / {B.PAIRS}.0 AS density FROM crv LEFT JOIN (SELECT grp, step, count(*) AS m FROM e GROUP BY ALL) USING (grp, step))"
add("d1_percolation_curve", on_pearson(lambda c, n: network.percolation_curve(c)), f"WITH RECURSIVE {REACH}, {COMP} SELECT 'pearson' AS method, grp, CAST(step AS INTEGER) AS step, {r6('step / 100.0 AS threshold', 'giant', 'density')}, CAST(n_components AS INTEGER) AS n_components FROM crv2")
PERC = f"WITH RECURSIVE {REACH}, {COMP}, top AS (SELECT grp, max(giant) AS best, max(density) AS dense FROM crv2 GROUP BY grp), thr AS (SELECT 'pearson' AS method, grp, max(step) / 100.0 AS threshold FROM crv2 JOIN top USING (grp) WHERE giant >= CASE WHEN best = 1 THEN 1 ELSE 0.98 * best END OR dense = 0 GROUP BY grp)"
add("d1_percolation_threshold", on_pearson(lambda c, n: network.percolation_thresholds(c)), f"{PERC} SELECT method, grp, {r6('threshold')} FROM thr")
add("d2_threshold_network", on_pearson(lambda c, n: network.threshold_network(c, network.percolation_thresholds(c))), f"{PERC} SELECT corr.method, corr.grp, {r6('threshold')}, i AS src, j AS dst, {r6('abs(r) AS w')} FROM corr JOIN thr USING (grp) WHERE abs(r) >= threshold AND abs(r) > 0")
add("d3_full_network", on_corr2(lambda c, n: network.full_network(c)), f"WITH {B.CORR2} SELECT method, grp, i AS src, j AS dst, {r6('abs(r) AS w')} FROM corr")
GRID3 = (0.11, 0.21, 0.31)
NETS = f"nets AS (SELECT method || '_weighted' AS matrix_key, method, 'weighted' AS approach, CAST(NULL AS DOUBLE) AS threshold, grp, i, j, abs(r) AS w FROM corr UNION ALL SELECT method || '_percolation', method, 'percolation', {B.CUT}, grp, i, j, CASE WHEN abs(r) >= {B.CUT} THEN abs(r) ELSE 0 END FROM corr UNION ALL SELECT method || '_persistence_' || format('{{:.3f}}', t), method, 'persistence', t, grp, i, j, CASE WHEN abs(r) >= t THEN abs(r) ELSE 0 END FROM corr, (SELECT unnest([0.11, 0.21, 0.31]::DOUBLE[]) AS t))"


def fixed_thresholds(corr):
    return corr.select("method", "grp", F.lit(B.CUT).alias("threshold")).distinct()


def networks(s, d):
    corr, nodes = B.corr2(s, d)
    return network.all_networks(corr, fixed_thresholds(corr), list(GRID3)), nodes


add("d4_all_networks", lambda s, d: networks(s, d)[0], f"WITH {B.CORR2}, {NETS} SELECT matrix_key, method, approach, {r6('threshold')}, grp, i, j, {r6('w')} FROM nets")
D6 = f"""WITH {B.CORR2}, {NETS}, pa AS (SELECT * FROM nets WHERE grp = 'g0' AND approach = 'persistence'), pb AS (SELECT * FROM nets WHERE grp = 'g1' AND approach = 'persistence')
SELECT a.method, {r6('a.threshold AS threshold')}, a.i, a.j, {r6('a.w AS w1', 'b.w AS w2')} FROM pa a JOIN pb b USING (matrix_key, i, j)"""
add("d6_matched_persistence", lambda s, d: network.matched_persistence(networks(s, d)[0], "g0", "g1"), D6)
add("d7_binary_edges", on_corr2(lambda c, n: network.binary_edges(c, 0.21)), f"WITH {B.CORR2} SELECT method, grp, i, j FROM corr WHERE abs(r) > 0.21")
ODD = "odd AS (SELECT * FROM areas UNION ALL SELECT 'z', 9, 'D01' UNION ALL SELECT 'y', 8, 'd02')"


def odd_areas(s):
    return B.areas(s).unionByName(s.createDataFrame([("z", 9, "D01"), ("y", 8, "d02")], "area string, area_ord int, node string"))


def some_nodes(s, d):
    rows, nodes = B.obs(s, d)
    return to_long(rows, nodes).select("node").distinct()


add("d8_areas_last", lambda s, d: network.assign_areas(some_nodes(s, d), odd_areas(s).where("node <> 'd05'")), f"WITH {B.OBS}, {B.AREA_SQL}, {ODD}, n AS (SELECT DISTINCT node FROM obs) SELECT node, coalesce((SELECT arg_max(area, area_ord) FROM odd WHERE lower(odd.node) = n.node AND odd.node <> 'd05'), 'Unassigned') AS area FROM n")
add("d8_areas_first", lambda s, d: network.assign_areas(some_nodes(s, d), odd_areas(s).where("node <> 'd05'"), last=False), f"WITH {B.OBS}, {B.AREA_SQL}, {ODD}, n AS (SELECT DISTINCT node FROM obs) SELECT node, coalesce((SELECT arg_min(area, area_ord) FROM odd WHERE odd.node = n.node AND odd.node <> 'd05'), 'Other') AS area FROM n")

# F: graph metrics
DEG = "deg AS (SELECT n.method, n.grp, n.node, count(d.node) AS degree, coalesce(sum(w), 0) AS strength FROM nodes n LEFT JOIN dbl d ON n.grp = d.grp AND n.node = d.node GROUP BY ALL)"
TRI = "tri AS (SELECT x.grp, x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.grp = y.grp AND x.dst = y.src JOIN edges z ON z.grp = x.grp AND z.src = x.src AND z.dst = y.dst), tn AS (SELECT grp, node, count(*) AS t FROM (SELECT grp, unnest([a, b, c]) AS node FROM tri) GROUP BY ALL)"
CLU = f"{B.EDGES}, {DEG}, {TRI}, clu AS (SELECT deg.*, coalesce(t, 0) AS triangles, CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END AS clustering FROM deg LEFT JOIN tn USING (grp, node))"
add("f1_density", on_edges(lambda e, n, _: graph_metrics.density(e, n)), f"WITH {B.EDGES} SELECT method, grp, CAST({B.DIMS} AS BIGINT) AS n_nodes, coalesce(m, 0) AS n_edges, {r6('2.0 * coalesce(m, 0) / 4032 AS density')} FROM (SELECT DISTINCT method, grp FROM nodes) LEFT JOIN (SELECT grp, count(*) AS m FROM edges GROUP BY grp) USING (grp)")
add("f2_components", on_edges(lambda e, n, _: spread.all_components(e, n)), f"WITH RECURSIVE {B.EDGES}, reach AS (SELECT grp, node, node AS other FROM nodes UNION SELECT r.grp, r.node, d.other FROM reach r JOIN dbl d ON r.grp = d.grp AND r.other = d.node) SELECT 'pearson' AS method, grp, node, min(other) AS component FROM reach GROUP BY grp, node")
add("f3_transitivity", on_edges(lambda e, n, _: graph_metrics.transitivity(e, n)), f"WITH {CLU} SELECT method, grp, {r6('CASE WHEN sum(degree * (degree - 1)) = 0 THEN 0 ELSE sum(triangles) / (sum(degree * (degree - 1)) / 2.0) END AS transitivity')} FROM clu GROUP BY method, grp")
add("f4_local_clustering", on_edges(lambda e, n, _: graph_metrics.local_clustering(e, n)), f"WITH {CLU} SELECT method, grp, node, degree, triangles, {r6('clustering')} FROM clu")
add("f5_global_metrics", on_edges(lambda e, n, names: kernels.global_metrics(e, names)))
add("f7_modularity_of_areas", lambda s, d: graph_metrics.modularity(B.cut_edges(s, d)[0], graph_metrics.nodes_of(B.pearson(s, d)[0]).join(F.broadcast(B.areas(s).select("node", F.col("area").alias("community"))), "node")), f"WITH {B.EDGES}, {B.AREA_SQL}, x AS (SELECT d.grp, a.area, CASE WHEN a.area = b.area THEN w ELSE 0 END AS inn, w FROM dbl d JOIN areas a ON d.node = a.node JOIN areas b ON d.other = b.node), y AS (SELECT grp, area, sum(inn) AS inn, sum(w) AS al FROM x GROUP BY ALL), z AS (SELECT grp, sum(w) AS tot FROM x GROUP BY grp) SELECT 'pearson' AS method, grp, {r6('sum(inn / tot - (al / tot) * (al / tot)) AS modularity')} FROM y JOIN z USING (grp) GROUP BY grp")
add("f8_assortativity", on_edges(lambda e, n, _: graph_metrics.assortativity(e, n)), f"WITH {B.EDGES}, {DEG} SELECT 'pearson' AS method, d.grp, {r6('coalesce(CASE WHEN stddev_pop(x.degree) = 0 THEN 0 ELSE covar_pop(x.degree, y.degree) / (stddev_pop(x.degree) * stddev_pop(y.degree)) END, 0) AS assortativity')} FROM dbl d JOIN deg x ON d.grp = x.grp AND d.node = x.node JOIN deg y ON d.grp = y.grp AND d.other = y.node GROUP BY d.grp")
add("f10_degree_strength", on_edges(lambda e, n, _: graph_metrics.node_degrees(e, n)), f"WITH {B.EDGES}, {DEG} SELECT method, grp, node, degree, {r6('strength')} FROM deg")
add("f11_node_metrics", on_edges(lambda e, n, names: kernels.node_metrics(e, names)))
LENGTHS = ["d0 AS MATERIALIZED (SELECT grp, node AS a, other AS b, w AS d FROM dbl UNION ALL SELECT grp, node, node, 0 FROM nodes)"]
LENGTHS += [f"d{k + 1} AS MATERIALIZED (SELECT x.grp, x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.grp = y.grp AND x.b = y.a GROUP BY ALL)" for k in range(6)]
PATHS = f"""{B.EDGES}, {', '.join(LENGTHS)},
sz AS (SELECT grp, count(*) AS n FROM nodes GROUP BY grp), rc AS (SELECT grp, count(*) AS pairs, sum(d) AS total, max(d) AS longest FROM d6 WHERE a <> b GROUP BY grp),
pm AS (SELECT grp, n, coalesce(pairs, 0) = n * (n - 1) AS connected, total, longest FROM sz LEFT JOIN rc USING (grp))"""
add("f5_paths", on_edges(lambda e, n, _: spread.path_metrics(e, n)[0]), f"""WITH {PATHS}
SELECT 'pearson' AS method, grp, connected, round(CASE WHEN connected THEN total / (n * (n - 1)) ELSE 'Infinity'::DOUBLE END, 6) + 0.0 AS path_length, {r6('CASE WHEN connected THEN longest ELSE 0 END AS diameter')} FROM pm""")
add("f12_closeness", on_edges(lambda e, n, _: spread.path_metrics(e, n)[1]), f"""WITH {PATHS}, fa AS (SELECT grp, a AS node, sum(d) AS far FROM d6 GROUP BY ALL)
SELECT 'pearson' AS method, grp, node, {r6('CASE WHEN connected THEN (n - 1) / far ELSE 0 END AS closeness')} FROM fa JOIN pm USING (grp)""")
BETWEEN = f"""{PATHS}, pa AS MATERIALIZED (SELECT x.grp, x.a AS s, e.node AS u, e.other AS v FROM d6 x JOIN dbl e ON e.grp = x.grp AND e.node = x.b JOIN d6 y ON y.grp = x.grp AND y.a = x.a AND y.b = e.other WHERE e.other <> x.a AND abs(x.d + e.w - y.d) <= 1e-10),
n0 AS (SELECT grp, a AS s, b AS v, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END AS n FROM d6),
{", ".join(f"n{k + 1} AS MATERIALIZED (SELECT p.grp, p.s, p.v, sum(n) AS n FROM pa p JOIN n{k} n ON n.grp = p.grp AND n.s = p.s AND n.v = p.u GROUP BY ALL UNION ALL SELECT grp, node, node, 1 FROM nodes)" for k in range(16))},
nd AS MATERIALIZED (SELECT n.grp, n.s, n.v, n.n, d FROM n16 n JOIN d6 x ON x.grp = n.grp AND x.a = n.s AND x.b = n.v),
dp AS MATERIALIZED (SELECT x.grp, x.s, x.v, x.n, coalesce(sum(x.n * y.n / z.n) FILTER (abs(x.d + y.d - z.d) <= 1e-10 AND y.v <> x.v), 0) AS beyond FROM nd x JOIN nd y ON y.grp = x.grp AND y.s = x.v JOIN nd z ON z.grp = x.grp AND z.s = x.s AND z.v = y.v WHERE x.s <> x.v AND x.s <> y.v GROUP BY ALL)"""
add("f11_betweenness", on_edges(lambda e, n, _: spread.betweenness(e, n)[0]), f"""WITH {BETWEEN}
SELECT 'pearson' AS method, n.grp, n.node, {r6(f'coalesce(sum(beyond), 0) / 2 / {(B.DIMS - 1) * (B.DIMS - 2) // 2} AS betweenness')} FROM nodes n LEFT JOIN dp ON dp.grp = n.grp AND dp.v = n.node GROUP BY n.grp, n.node""")
F17 = f"""WITH {BETWEEN}, us AS (SELECT p.grp, least(p.u, p.v) AS src, greatest(p.u, p.v) AS dst, sum(nu.n / dp.n * (beyond + 1)) / 2 AS b
  FROM pa p JOIN dp ON dp.grp = p.grp AND dp.s = p.s AND dp.v = p.v JOIN nd nu ON nu.grp = p.grp AND nu.s = p.s AND nu.v = p.u GROUP BY ALL)
SELECT method, e.grp, e.src, e.dst, {r6('w', 'coalesce(b, 0) AS betweenness')} FROM edges e LEFT JOIN us ON us.grp = e.grp AND us.src = e.src AND us.dst = e.dst"""
add("f18_area_betweenness", lambda s, d: graph_metrics.area_means(spread.betweenness(*B.cut_edges(s, d)[:2])[0], B.areas(s), "betweenness"), f"""WITH {BETWEEN}, {B.AREA_SQL},
bt AS (SELECT n.grp, n.node, coalesce(sum(beyond), 0) / 2 / {(B.DIMS - 1) * (B.DIMS - 2) // 2} AS b FROM nodes n LEFT JOIN dp ON dp.grp = n.grp AND dp.v = n.node GROUP BY n.grp, n.node)
SELECT 'pearson' AS method, grp, area, {r6('avg(b) AS avg_betweenness')} FROM bt JOIN areas USING (node) GROUP BY grp, area""")
EIGEN = f"WITH {B.EDGES}, en AS MATERIALIZED (SELECT grp AS net, node AS a, other AS b, w FROM dbl), ek AS (SELECT grp AS net, node FROM nodes), {B.eigen_sql('f', 'en', 'ek')}"
add("f13_eigenvector", on_edges(lambda e, n, _: spread.eigenvector(e, n)), f"{EIGEN} SELECT 'pearson' AS method, net AS grp, node, {r6('eigenvector')} FROM f_eig")
add("f16_edge_list", on_edges(lambda e, n, _: e.drop("threshold")), f"WITH {B.EDGES} SELECT method, grp, src, dst, {r6('w')} FROM edges")
add("f17_edge_betweenness", on_edges(lambda e, n, _: spread.betweenness(e, n)[1]), F17)
AREA_M = f"""WITH {CLU}, {B.AREA_SQL}, m AS (SELECT method, grp, area, count(*) AS n_nodes, avg(degree) AS avg_degree, avg(clustering) AS avg_clustering FROM clu JOIN areas USING (node) GROUP BY ALL),
x AS (SELECT e.grp, a.area AS sa, b.area AS da FROM edges e JOIN areas a ON e.src = a.node JOIN areas b ON e.dst = b.node)
SELECT method, grp, area, n_nodes, {r6('avg_degree', 'avg_clustering')}, (SELECT count(*) FROM x WHERE x.grp = m.grp AND sa = area AND da = area) AS internal_edges, (SELECT count(*) FROM x WHERE x.grp = m.grp AND (sa = area) <> (da = area)) AS external_edges FROM m"""
add("f18_area_metrics", lambda s, d: graph_metrics.area_metrics(*B.cut_edges(s, d)[:2], B.areas(s).select("node", "area")), AREA_M)
F19 = f"WITH {B.EDGES}, {DEG}, am AS (SELECT x.grp, x.node, sum(e.w) AS weight FROM dbl x JOIN dbl y ON x.grp = y.grp AND x.node = y.node AND x.other < y.other JOIN edges e ON e.grp = x.grp AND e.src = x.other AND e.dst = y.other GROUP BY ALL) SELECT method, deg.grp, {r6('avg(CASE WHEN degree < 2 THEN 0 ELSE coalesce(weight, 0) / (degree * (degree - 1) / 2.0) END) AS clustering')} FROM deg LEFT JOIN am USING (grp, node) GROUP BY method, deg.grp"
add("f19_weighted_clustering", on_edges(lambda e, n, _: graph_metrics.weighted_neighbour_clustering(e, n)), F19)


def hub_query(s, d):
    edges, nodes, _ = B.cut_edges(s, d)
    deg = graph_metrics.node_degrees(edges, nodes)
    return deg.withColumn("z", z_score("strength", "method", "grp")).withColumn("is_hub", F.coalesce(F.col("z") >= 1.5, F.lit(False)))


add("hub_query", hub_query, f"WITH {B.EDGES}, {DEG}, zz AS (SELECT *, (strength - avg(strength) OVER (PARTITION BY grp)) / stddev_samp(strength) OVER (PARTITION BY grp) AS z FROM deg) SELECT method, grp, node, degree, {r6('strength', 'z')}, coalesce(z >= 1.5, false) AS is_hub FROM zz")


def wide_correlations(s, d):
    """Correlations of lineitem's numeric columns by return flag, from the wide rows: one aggregate, no join."""
    t = s.read.parquet(f"{d}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    t = t.select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in cols])
    wide = t.groupBy("l_returnflag").agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot("l_returnflag", [f"{a}|{b}" for a, b in pairs], "pair", "r").select(F.col("l_returnflag").alias("grp"), F.split("pair", r"\|")[0].alias("i"), F.split("pair", r"\|")[1].alias("j"), "r")


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("c1_wide_lineitem", wide_correlations, " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{a}' AS i, '{b}' AS j, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 AS r FROM lineitem GROUP BY l_returnflag" for k, a in enumerate(LINE_COLS) for b in LINE_COLS[k + 1 :]))


def event_networks(s, d):
    """Users x event types (mean value), Pearson over pairwise complete users, group = parity of the user id."""
    t = s.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    names = [r[0] for r in t.select("event_type").distinct().orderBy("event_type").collect()]
    long = t.select((F.col("user_id") % 2).cast("string").alias("grp"), F.col("user_id").alias("subject"), F.col("event_type").alias("node"), "value")
    return correlate.biweight(to_vectors(long, names), names)


add("c4_event_networks", event_networks, f"WITH o AS (SELECT CAST(user_id % 2 AS VARCHAR) AS grp, user_id AS subject, event_type AS node, avg(value) AS value FROM events GROUP BY ALL), {B.corr_sql('c', 'o', 'biweight')} SELECT method, grp, i, j, {r6('r')} FROM c")
