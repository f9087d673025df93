"""Queries over consensus scores, statistical tests, contributions and discovery, with their SQL twins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubweave.operators import discover, graph_metrics, penalised, permute, scoring, spread, threshold_free
from hubweave.plans import binding as B
from hubweave.plans import comparisons as C
from hubweave.plans import core
from hubweave.plans.binding import q, r6
from hubweave.sources.scratch import settled

Q, S = {}, {}
GRP = ("grp",)
PERMS = 500
HUB_Z = 1.5


def add(name, build, sql=None):
    Q[name] = q(build)
    if sql:
        S[name] = sql


def scores(s, d, methods=B.FIVE):
    """(grp, approach, method, node, value, strength): eigenvectors of full, percolation and swept networks (as areas)."""
    return B.scores5(s, d, methods).withColumnRenamed("eigenvector", "value")


START, STEP, COUNT = B.SWEEP
BOTTLENECKS = ", ".join(f"bx{k + 1} AS MATERIALIZED (SELECT net, a, b, max(w) AS w FROM (SELECT * FROM bx{k} UNION ALL SELECT x.net, x.a, y.b, least(x.w, y.w) FROM bx{k} x JOIN bx{k} y ON x.net = y.net AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)" for k in range(6))
SCORES = f"""{B.CORR5},
b2 AS MATERIALIZED (SELECT method || '|' || grp AS net, i AS a, j AS b, abs(r) AS w FROM corr UNION ALL SELECT method || '|' || grp, j, i, abs(r) FROM corr),
be AS MATERIALIZED (SELECT * FROM b2 UNION ALL SELECT DISTINCT net, a, a, 9 FROM b2),
bn AS (SELECT net, a AS node, CASE WHEN a = 'd00' THEN 9.0::DOUBLE ELSE 0 END AS w, 0 AS turn FROM b2 GROUP BY net, a
  UNION ALL SELECT e.net, e.b, max(least(p.w, e.w)), any_value(turn) + 1 FROM bn p JOIN be e ON e.net = p.net AND e.a = p.node WHERE turn < {B.DIMS - 1} GROUP BY e.net, e.b),
th AS MATERIALIZED (SELECT net, floor(round(min(w) * 100, 10)) / 100 AS threshold FROM bn WHERE turn = {B.DIMS - 1} GROUP BY net),
bx0 AS (SELECT b2.* FROM b2 JOIN th USING (net) WHERE threshold < 0.01), {BOTTLENECKS},
bg AS (SELECT net, step, max(n) AS giant FROM (SELECT net, a, step, 1 + count(*) FILTER (w >= step / 100.0) AS n FROM bx6, (SELECT unnest(range(1, 96)) AS step) GROUP BY ALL) GROUP BY ALL),
thr AS (SELECT * FROM th WHERE threshold >= 0.01
  UNION ALL SELECT net, coalesce(max(step) FILTER (giant >= CASE WHEN best = {B.DIMS} THEN best ELSE 0.98 * best END), 95) / 100.0 FROM (SELECT *, max(giant) OVER (PARTITION BY net) AS best FROM bg) WHERE best > 1 GROUP BY net),
grid AS (SELECT CAST(k AS INTEGER) AS step, {START}::DOUBLE + k * {STEP}::DOUBLE AS threshold FROM (SELECT unnest(range(0, {COUNT})) AS k)),
jn AS MATERIALIZED (SELECT net || '|weighted|-1' AS net, a, b, w FROM b2 WHERE w > 0
  UNION ALL SELECT net || '|percolation|-1', a, b, w FROM b2 JOIN thr USING (net) WHERE w >= threshold AND w > 0
  UNION ALL SELECT net || '|persistence|' || step, a, b, w FROM b2 JOIN grid ON w >= threshold WHERE w > 0),
jk AS (SELECT * FROM (SELECT DISTINCT net FROM jn), (SELECT DISTINCT node FROM obs)),
{B.eigen_sql('j', 'jn', 'jk')},
jv AS (SELECT split_part(net, '|', 1) AS method, split_part(net, '|', 2) AS grp, split_part(net, '|', 3) AS approach, split_part(net, '|', 4)::INT AS step, e.node, eigenvector, coalesce(st, 0) AS strength
  FROM j_eig e LEFT JOIN (SELECT net, a AS node, sum(w) AS st FROM jn GROUP BY ALL) USING (net, node)),
zf AS (SELECT k.method, k.grp, k.node, g.step, g.threshold, coalesce(eigenvector, 0) AS e, coalesce(strength, 0) AS v
  FROM (SELECT * FROM (SELECT DISTINCT method, grp FROM corr), (SELECT DISTINCT node FROM obs)) k CROSS JOIN grid g
  LEFT JOIN jv ON jv.approach = 'persistence' AND jv.method = k.method AND jv.grp = k.grp AND jv.node = k.node AND jv.step = g.step),
zl AS (SELECT *, lead(threshold) OVER w AS nt, lead(v) OVER w AS nv, lead(e) OVER w AS ne FROM zf WINDOW w AS (PARTITION BY method, grp, node ORDER BY threshold)),
sc AS MATERIALIZED (SELECT grp, approach, method, node, eigenvector AS value, strength FROM jv WHERE approach <> 'persistence'
  UNION ALL SELECT grp, 'persistence', method, node, coalesce(sum((nt - threshold) * (e + ne) / 2), 0), coalesce(sum((nt - threshold) * (v + nv) / 2), 0) FROM zl GROUP BY grp, method, node)"""
HUB = f"{SCORES}, hb AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM sc WINDOW w AS (PARTITION BY grp, approach, method)), hz AS (SELECT *, coalesce(z >= {HUB_Z}, false) AS is_hub FROM hb)"


def ranked_sql(kept: str = "true") -> str:
    return f"""WITH RECURSIVE {SCORES},
rk2 AS (SELECT *, rank() OVER (PARTITION BY grp, approach, method ORDER BY round(value, 9) DESC) AS re, rank() OVER (PARTITION BY grp, approach, method ORDER BY round(strength, 9) DESC) AS rs FROM sc WHERE {kept}),
ra AS (SELECT grp, node, avg(re) AS e, avg(rs) AS s, count(*) AS n_methods FROM rk2 GROUP BY grp, node)
SELECT grp, node, {r6('e AS avg_eigen_rank', 's AS avg_strength_rank')}, n_methods,
  {r6('coalesce((max(e) OVER w - e) / nullif(max(e) OVER w - min(e) OVER w, 0), 1) AS consensus_eigenvector')},
  {r6('coalesce((max(s) OVER w - s) / nullif(max(s) OVER w - min(s) OVER w, 0), 1) AS consensus_node_strength')}
FROM ra WINDOW w AS (PARTITION BY grp)"""


add("j2_rank_consensus", lambda s, d: scoring.rank_consensus_of_both(scores(s, d).withColumnRenamed("value", "eigenvector"), *GRP), ranked_sql())
add("j1_three_way_rank_consensus", lambda s, d: scoring.rank_consensus_of_both(scores(s, d, ("pearson",)).withColumnRenamed("value", "eigenvector"), *GRP), ranked_sql("method = 'pearson'"))
add("j3_standardised_hubs", lambda s, d: scoring.standardised_hubs(scores(s, d), HUB_Z, *GRP), f"WITH RECURSIVE {HUB} SELECT grp, approach, method, node, {r6('value', 'strength', 'z')}, is_hub FROM hz")
A3 = ("weighted", "percolation", "persistence")
J4 = f"""{HUB}, ap AS (SELECT grp, node, approach, avg(is_hub::INT) AS prob, avg(z) AS mz, stddev_samp(z) AS sz FROM hz GROUP BY ALL),
aw AS (SELECT *, 1 / (1 + CASE WHEN abs(mz) > 0.01 THEN abs(sz / mz) WHEN sz IS NOT NULL THEN 'Infinity'::DOUBLE END) AS wt FROM ap),
wd AS (SELECT grp, node, {", ".join(f"coalesce(max(prob) FILTER (approach = '{a}'), 0) AS {a}_prob, coalesce(max(wt) FILTER (approach = '{a}'), 0) AS {a}_raw" for a in A3)} FROM aw GROUP BY grp, node),
wn AS (SELECT grp, node, {", ".join(f"{a}_prob" for a in A3)}, {", ".join(f"CASE WHEN weighted_raw + percolation_raw + persistence_raw > 0 THEN {a}_raw / (weighted_raw + percolation_raw + persistence_raw) ELSE 1 / 3.0 END AS {a}_weight" for a in A3)} FROM wd),
wt AS (SELECT *, {", ".join(f"{a}_prob * {a}_weight AS t{k}" for k, a in enumerate(A3))} FROM wn),
ws AS (SELECT *, t0 + t1 + t2 AS score, sqrt(((t0 - (t0 + t1 + t2) / 3) * (t0 - (t0 + t1 + t2) / 3) + (t1 - (t0 + t1 + t2) / 3) * (t1 - (t0 + t1 + t2) / 3) + (t2 - (t0 + t1 + t2) / 3) * (t2 - (t0 + t1 + t2) / 3)) / 2) AS sd FROM wt),
wc AS (SELECT *, greatest(0, score - sd) AS low, least(1, score + sd) AS high FROM ws),
cn AS (SELECT *, CASE WHEN high - low < 0.2 THEN 'High' WHEN high - low < 0.4 THEN 'Medium' ELSE 'Low' END AS confidence, (weighted_prob + percolation_prob + persistence_prob) / 3 AS pm FROM wc),
un AS (SELECT *, sqrt(((weighted_prob - pm) * (weighted_prob - pm) + (percolation_prob - pm) * (percolation_prob - pm) + (persistence_prob - pm) * (persistence_prob - pm)) / 2) AS prob_sd, (weighted_prob >= 0.6)::INT + (percolation_prob >= 0.6)::INT + (persistence_prob >= 0.6)::INT AS agree FROM cn),
uc AS (SELECT *, CASE WHEN pm > 0.01 THEN prob_sd / pm ELSE 'Infinity'::DOUBLE END AS prob_cv FROM un)"""
PROBS = ", ".join(f"round({a}_prob, 6) + 0.0 AS {a}_prob, round({a}_weight, 6) + 0.0 AS {a}_weight" for a in A3)
add("j4_weighted_consensus", lambda s, d: scoring.weighted_consensus(scoring.standardised_hubs(scores(s, d), HUB_Z, *GRP), *GRP), f"WITH RECURSIVE {J4} SELECT grp, node, {PROBS}, {r6('score', 'low', 'high')}, confidence FROM cn")
UNC = f"{PROBS}, {r6('score', 'low', 'high', 'prob_sd', 'prob_cv')}, confidence, CASE WHEN prob_cv <= 0.2 THEN 'consistent' WHEN prob_cv <= 0.4 THEN 'moderate' ELSE 'variable' END AS uncertainty, agree = 3 AS all_three_agree, agree >= 2 AS two_agree"
add("j5_uncertainty", lambda s, d: scoring.uncertainty(scoring.weighted_consensus(scoring.standardised_hubs(scores(s, d), HUB_Z, *GRP), *GRP)), f"WITH RECURSIVE {J4} SELECT grp, node, {UNC} FROM uc")
TAUS = [round(1 + 0.1 * k, 1) for k in range(16)]
TAU = f"tau AS (SELECT CAST(k AS INTEGER) AS pos, round(1 + 0.1 * k, 1)::DOUBLE AS tau FROM (SELECT unnest(range(0, 16)) AS k))"
QUALITY = """nn AS (SELECT grp, count(DISTINCT round(z, 9)) / 3.0 AS nodes FROM hz GROUP BY grp),
tq AS (SELECT grp, pos, tau, count(DISTINCT round(z, 9)) FILTER (z >= tau) / 3.0 AS hubs, count(z) FILTER (z >= tau) AS n, avg(z) FILTER (z >= tau) AS m, stddev_samp(z) FILTER (z >= tau) AS sd, max(z) FILTER (z >= tau) - min(z) FILTER (z >= tau) AS rg FROM hz, tau GROUP BY ALL),
tp AS (SELECT grp, pos, tau, hubs, hubs / nodes AS p, CASE WHEN n > 3 THEN greatest(0, least(1, 1 - sd / m)) ELSE 0 END AS md, CASE WHEN n > 3 THEN 1 / (1 + rg) ELSE 0 END AS cl FROM tq JOIN nn USING (grp)),
tz AS (SELECT grp, pos, tau, CASE WHEN hubs < 2 THEN 0 ELSE p END AS share, CASE WHEN hubs < 2 THEN 0 ELSE md END AS hub_modularity, CASE WHEN hubs < 2 THEN 0 ELSE cl END AS hub_clustering, CASE WHEN hubs < 2 THEN 0 ELSE least(2 * p, 0.6) END AS hub_density,
       CASE WHEN hubs < 2 THEN 0 ELSE CASE WHEN p BETWEEN 0.05 AND 0.15 THEN 1 ELSE exp(-10 * abs(p - 0.1)) END + md + cl + CASE WHEN p >= 0.05 THEN 0.5 ELSE 0 END END AS score FROM tp),
bt AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, pos) = 1 AS best FROM tz)"""
J6 = f"WITH RECURSIVE {HUB}, {TAU}, {QUALITY} SELECT grp, {r6('tau', 'share', 'hub_modularity', 'hub_clustering', 'hub_density', 'score')}, best FROM bt"
SHARES = "ta AS (SELECT grp, pos, tau, node, sum(CASE WHEN z >= tau THEN 1 ELSE 0 END) / 15.0 AS share FROM hz, tau GROUP BY ALL), ts AS (SELECT grp, node, avg(share) AS mean_share, count(*) FILTER (share >= 0.5) AS n_taus_hub, count(*) FILTER (share >= 0.5) >= 13 AS stable FROM ta GROUP BY grp, node)"
AGREEMENTS = [0.4, 0.5, 0.6, 0.7, 0.8]


def hubs(s, d):
    return scoring.standardised_hubs(scores(s, d), HUB_Z, *GRP)


add("j6_threshold_calibration", lambda s, d: scoring.calibrate_threshold(hubs(s, d), TAUS, *GRP), J6)
add("j7_threshold_sensitivity", lambda s, d: scoring.threshold_sensitivity(hubs(s, d), TAUS, *GRP), f"WITH RECURSIVE {HUB}, {TAU}, {SHARES} SELECT grp, {r6('tau')}, count(*) FILTER (share >= 0.5) AS n_consensus_hubs, count(*) FILTER (share >= 0.6) AS n_three_way, {r6('avg(share) FILTER (share > 0) AS avg_score')}, count(*) FILTER (share >= 0.5 AND stable) AS stable_hubs FROM ta JOIN ts USING (grp, node) GROUP BY grp, tau")
add("j7_stable_hubs", lambda s, d: scoring.stable_hubs(hubs(s, d), TAUS, *GRP), f"WITH RECURSIVE {HUB}, {TAU}, {SHARES} SELECT grp, node, {r6('mean_share')}, n_taus_hub, stable FROM ts")
add("j7_agreement_sensitivity", lambda s, d: scoring.agreement_sensitivity(hubs(s, d), AGREEMENTS, 1.5, *GRP), f"WITH RECURSIVE {HUB}, tau AS (SELECT 1.5 AS tau, 1 AS pos), {SHARES} SELECT grp, {r6('agreement')}, count(*) FILTER (round(share - agreement, 9) >= 0) AS n_hubs, {r6('coalesce(avg(share) FILTER (round(share - agreement, 9) >= 0), 0) AS avg_confidence')} FROM ta, (SELECT unnest({AGREEMENTS}) AS agreement) GROUP BY grp, agreement")
add("j8_comprehensive_consensus", lambda s, d: scoring.comprehensive(scores(s, d), HUB_Z, *GRP), f"WITH RECURSIVE {J4} SELECT grp, node, {UNC}, CASE WHEN agree = 3 THEN 'all three' WHEN agree >= 2 THEN 'two' WHEN round(score, 9) >= 0.4 THEN 'consensus' ELSE 'none' END AS robustness FROM uc")
J4_AUTO = J4.replace(f"hz AS (SELECT *, coalesce(z >= {HUB_Z}, false) AS is_hub FROM hb)", f"hz AS (SELECT * FROM hb), {TAU}, {QUALITY}, ht AS (SELECT hb.*, coalesce(z >= b.tau, false) AS is_hub FROM hb LEFT JOIN (SELECT grp, tau FROM bt WHERE best) b USING (grp))").replace("FROM hz GROUP BY ALL),", "FROM ht GROUP BY ALL),", 1)
add("j8_calibrated_consensus", lambda s, d: scoring.comprehensive(scores(s, d), "auto", *GRP), f"WITH RECURSIVE {J4_AUTO} SELECT grp, node, {UNC}, CASE WHEN agree = 3 THEN 'all three' WHEN agree >= 2 THEN 'two' WHEN round(score, 9) >= 0.4 THEN 'consensus' ELSE 'none' END AS robustness FROM uc")

# K: tests
def two_sides(s, d):
    """Subjects of g0 and g1: (subject, side, node, value)."""
    from hubweave.sources.observations import to_long

    rows, nodes = B.obs(s, d)
    return to_long(rows.where("grp in ('g0', 'g1')"), nodes).select("subject", F.when(F.col("grp") == "g0", 1).otherwise(2).alias("side"), "node", "value")


SIDES = f"{B.OBS}, vals AS (SELECT subject, CASE WHEN grp = 'g0' THEN 1 ELSE 2 END AS side, node, value FROM obs WHERE grp IN ('g0', 'g1')), sub AS (SELECT DISTINCT subject, side FROM vals)"


def perm_sql(source: str, count: int) -> str:
    return f"prm AS (SELECT 0 AS perm, subject, CAST(side AS INTEGER) AS side FROM {source} UNION ALL SELECT perm, subject, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY md5('42|' || perm || '|' || subject), subject) <= (SELECT count(*) FROM {source} WHERE side = 1) THEN 1 ELSE 2 END FROM {source}, (SELECT unnest(range(1, {count + 1})) AS perm))"


add("k2_permutations", lambda s, d: permute.permutations(two_sides(s, d).select("subject", "side").distinct(), PERMS), f"WITH {SIDES}, {perm_sql('sub', PERMS)} SELECT CAST(perm AS INTEGER) AS perm, subject, CAST(side AS INTEGER) AS side FROM prm")
K2 = f"{SIDES}, {perm_sql('sub', PERMS)}, sm AS (SELECT perm, node, avg(value) FILTER (p.side = 1) AS m1, var_samp(value) FILTER (p.side = 1) AS v1, count(value) FILTER (p.side = 1) AS n1, avg(value) FILTER (p.side = 2) AS m2, var_samp(value) FILTER (p.side = 2) AS v2, count(value) FILTER (p.side = 2) AS n2 FROM prm p JOIN vals v USING (subject) GROUP BY perm, node), kt AS (SELECT o.node, o.m1 AS mean1, o.m2 AS mean2, o.m1 - o.m2 AS difference, (o.m1 - o.m2) / sqrt(((o.n1 - 1) * o.v1 + (o.n2 - 1) * o.v2) / (o.n1 + o.n2 - 2)) AS cohens_d, avg((abs(round(n.m1 - n.m2, 12)) >= abs(round(o.m1 - o.m2, 12)))::INT) AS p, quantile_cont(n.m1 - n.m2, 0.025) AS null_low, quantile_cont(n.m1 - n.m2, 0.975) AS null_high FROM sm o JOIN sm n ON o.node = n.node AND o.perm = 0 AND n.perm > 0 GROUP BY ALL)"
add("k2_two_sample_test", lambda s, d: permute.two_sample_test(two_sides(s, d), PERMS), f"WITH {K2} SELECT node, {r6('mean1', 'mean2', 'difference', 'cohens_d', 'p', 'null_low', 'null_high')} FROM kt")
BH = f"(SELECT min(least(1, u.p * {B.DIMS} / u.rk)) FROM rr u WHERE u.p >= rr.p)"
add("k7_region_tests", lambda s, d: permute.adjust(permute.two_sample_test(two_sides(s, d), PERMS)).withColumn("stars", permute.stars("p_adjusted")).select("node", "p", "p_adjusted", "stars"), f"WITH {K2}, rr AS (SELECT node, p, row_number() OVER (ORDER BY p) AS rk FROM kt), ad AS (SELECT node, p, {BH} AS pa FROM rr) SELECT node, {r6('p', 'pa AS p_adjusted')}, CASE WHEN pa < 0.001 THEN '***' WHEN pa < 0.01 THEN '**' WHEN pa < 0.05 THEN '*' ELSE '' END AS stars FROM ad")
add("k5_bonferroni", lambda s, d: permute.adjust(permute.two_sample_test(two_sides(s, d), PERMS), "p", "bonferroni").select("node", "p", "p_adjusted"), f"WITH {K2} SELECT node, {r6('p', 'least(1, p * 64) AS p_adjusted')} FROM kt")
add("k6_effect_sizes", lambda s, d: permute.effect_sizes(threshold_free.node_strength(B.pearson(s, d)[0]).select("grp", F.col("node_strength").alias("value"))), f"WITH {C.STRENGTH}, e AS (SELECT grp, avg(node_strength) AS m, var_samp(node_strength) AS v, count(*) AS n FROM st WHERE method = 'pearson' GROUP BY grp) SELECT a.grp AS g1, b.grp AS g2, {r6('(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS cohens_d')} FROM e a JOIN e b ON a.grp <> b.grp")


def stacks(s, d):
    """Pearson networks of even groups against odd ones."""
    corr, _ = B.pearson(s, d)
    odd = F.substring("grp", 2, 3).cast("int") % 2
    return corr.select(F.col("grp").alias("matrix"), (odd + 1).alias("side"), "i", "j", F.col("r").alias("w"))


STACK = f"{B.PEARSON}, sk AS (SELECT grp AS matrix, CAST(substr(grp, 2) AS INTEGER) % 2 + 1 AS side, i, j, r AS w FROM corr)"
WELCH = "wl AS (SELECT i, j, avg(w) FILTER (side = 1) AS m1, var_samp(w) FILTER (side = 1) / count(w) FILTER (side = 1) AS a, count(w) FILTER (side = 1) AS n1, avg(w) FILTER (side = 2) AS m2, var_samp(w) FILTER (side = 2) / count(w) FILTER (side = 2) AS b, count(w) FILTER (side = 2) AS n2 FROM sk GROUP BY i, j)"
add("k3_welch_t", lambda s, d: permute.welch_t(stacks(s, d)), f"WITH {STACK}, {WELCH} SELECT i, j, {r6('(m1 - m2) / sqrt(a + b) AS t', '(a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df')} FROM wl")
add("k3_welch_p", lambda s, d: permute.with_p_values(permute.welch_t(stacks(s, d))))
NBS_COUNT, NBS_T = 500, 3.0
NBS = f"""WITH {STACK}, sm AS (SELECT DISTINCT matrix AS subject, side FROM sk), {perm_sql('sm', NBS_COUNT)},
nw AS (SELECT perm, i, j, avg(w) FILTER (p.side = 1) AS m1, var_samp(w) FILTER (p.side = 1) / count(w) FILTER (p.side = 1) AS a, avg(w) FILTER (p.side = 2) AS m2, var_samp(w) FILTER (p.side = 2) / count(w) FILTER (p.side = 2) AS b
  FROM prm p JOIN sk ON sk.matrix = p.subject GROUP BY perm, i, j),
ne AS MATERIALIZED (SELECT perm, i, j FROM nw WHERE abs(round((m1 - m2) / sqrt(a + b), 9)) > {NBS_T}),
nn AS MATERIALIZED (SELECT perm AS net, i AS a, j AS b FROM ne UNION ALL SELECT perm, j, i FROM ne),
{B.labels_sql('n', 'nn')}, nz AS (SELECT net AS perm, comp, count(*) AS size FROM n_lab GROUP BY ALL),
nl AS (SELECT p.perm, coalesce(max(size), 1) AS largest FROM (SELECT unnest(range(0, {NBS_COUNT + 1})) AS perm) p LEFT JOIN nz USING (perm) GROUP BY p.perm)"""
add("k3_network_based_statistic", lambda s, d: permute.network_based_statistic(stacks(s, d), NBS_T, NBS_COUNT), f"{NBS} SELECT CAST(perm AS INTEGER) AS perm, largest FROM nl")
add("k3_family_wise_p", lambda s, d: permute.family_wise_p(permute.network_based_statistic(stacks(s, d), NBS_T, NBS_COUNT), "largest"), f"{NBS}, o AS (SELECT largest AS observed FROM nl WHERE perm = 0) SELECT observed, round(avg((largest >= observed)::INT), 6) + 0.0 AS p FROM nl, o WHERE perm > 0 GROUP BY observed")
add("k3_components", lambda s, d: permute.component_tests(stacks(s, d), NBS_T, NBS_COUNT), f"""{NBS}, bar AS (SELECT quantile_cont(largest, 0.95) AS bar FROM nl WHERE perm > 0),
o AS (SELECT comp, size, (SELECT count(*) FROM nl WHERE perm > 0 AND largest >= size) / {NBS_COUNT}.0 AS p FROM nz WHERE perm = 0)
SELECT l.comp AS component, l.node, o.size, {r6('o.p AS p')}, o.size > bar AS significant FROM n_lab l JOIN o USING (comp), bar WHERE l.net = 0""")
K4_COUNT = 500


def node_values(s, d):
    """(side, node, metric, value): strength, eigenvector, closeness and betweenness of g0's and g1's cut networks."""
    edges, nodes, _ = B.cut_edges(s, d)
    two = "grp in ('g0', 'g1')"
    edges, nodes = edges.where(two), nodes.where(two)
    tables = [
        graph_metrics.node_degrees(edges, nodes).select("method", "grp", "node", "strength"), spread.eigenvector(edges, nodes),
        spread.path_metrics(edges, nodes)[1], spread.betweenness(edges, nodes)[0],
    ]
    side = F.when(F.col("grp") == "g0", 1).otherwise(2).alias("side")
    long = [t.select(side, "node", F.lit(t.columns[-1]).alias("metric"), F.col(t.columns[-1]).alias("value")) for t in tables]
    return settled(long[0].unionByName(long[1]).unionByName(long[2]).unionByName(long[3]))


def group_hubs(values):
    z = F.try_divide(F.col("value") - F.avg("value").over(Window.partitionBy("side")), F.stddev_samp("value").over(Window.partitionBy("side")))
    return values.where("metric = 'eigenvector'").withColumn("z", z).where(F.round("z", 9) >= HUB_Z).select("side", "node")


def k4(s, d):
    values = node_values(s, d)
    return permute.compare_groups(values, group_hubs(values), K4_COUNT)


K4 = f"""WITH {core.BETWEEN}, en AS MATERIALIZED (SELECT grp AS net, node AS a, other AS b, w FROM dbl), ek AS (SELECT grp AS net, node FROM nodes), {B.eigen_sql('f', 'en', 'ek')},
nv AS MATERIALIZED (SELECT grp, node, 'strength' AS metric, coalesce(sum(w), 0) AS value FROM nodes LEFT JOIN dbl USING (grp, node) GROUP BY ALL
  UNION ALL SELECT net, node, 'eigenvector', eigenvector FROM f_eig
  UNION ALL SELECT fa.grp, fa.a, 'closeness', CASE WHEN connected THEN (n - 1) / far ELSE 0 END FROM (SELECT grp, a, sum(d) AS far FROM d6 GROUP BY ALL) fa JOIN pm USING (grp)
  UNION ALL SELECT n.grp, n.node, 'betweenness', coalesce(sum(beyond), 0) / 2 / {(B.DIMS - 1) * (B.DIMS - 2) // 2} FROM nodes n LEFT JOIN dp ON dp.grp = n.grp AND dp.v = n.node GROUP BY n.grp, n.node),
nw AS (SELECT CASE WHEN grp = 'g0' THEN 1 ELSE 2 END AS side, node, metric, value FROM nv WHERE grp IN ('g0', 'g1'))"""
K4T = f"""{K4}, vals AS (SELECT side || '/' || node AS subject, side, metric AS node, value FROM nw), sub AS (SELECT DISTINCT subject, side FROM vals), {perm_sql('sub', K4_COUNT)},
{K2[K2.index("sm AS ("):].replace("sm AS", "smx AS", 1).replace("FROM sm o JOIN sm n", "FROM smx o JOIN smx n")}
SELECT node AS metric, {r6('mean1', 'mean2', 'difference', 'cohens_d', 'p', 'null_low', 'null_high')} FROM kt"""
add("k4_node_metric_tests", lambda s, d: k4(s, d)[0], K4T)
add("k4_hub_overlap", lambda s, d: k4(s, d)[1], f"""{K4}, zz AS (SELECT *, (value - avg(value) OVER (PARTITION BY side)) / stddev_samp(value) OVER (PARTITION BY side) AS z FROM nw WHERE metric = 'eigenvector'),
hs AS (SELECT coalesce(list(node ORDER BY node) FILTER (side = 1), []) AS a, coalesce(list(node ORDER BY node) FILTER (side = 2), []) AS b FROM zz WHERE round(z, 9) >= {HUB_Z}),
hc AS (SELECT list_sort(list_intersect(a, b)) AS c, list_filter(a, lambda x: NOT list_contains(b, x)) AS o1, list_filter(b, lambda x: NOT list_contains(a, x)) AS o2 FROM hs)
SELECT CAST(len(c) AS INTEGER) AS n_common, CAST(len(o1) AS INTEGER) AS n_only_1, CAST(len(o2) AS INTEGER) AS n_only_2, {r6('len(c) / nullif(len(c) + len(o1) + len(o2), 0) AS jaccard')},
  array_to_string(c, ',') AS common, array_to_string(o1, ',') AS only_1, array_to_string(o2, ',') AS only_2 FROM hc""")


def global_rows(s, d):
    rows, nodes = B.obs(s, d)
    return rows.where("grp in ('g0', 'g1')").select("subject", F.when(F.col("grp") == "g0", 1).otherwise(2).alias("side"), "values"), nodes


K8 = f"WITH {SIDES}, {perm_sql('sub', 20)}, kv AS (SELECT perm, p.side, subject, node, value FROM prm p JOIN vals USING (subject)), kr AS (SELECT a.perm, a.side, a.node AS i, b.node AS j, abs(covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value))) > 0.1 AS hit FROM kv a JOIN kv b ON a.perm = b.perm AND a.subject = b.subject AND a.node < b.node GROUP BY a.perm, a.side, a.node, b.node), kd AS (SELECT perm, avg(hit::INT) FILTER (side = 1) AS d1, avg(hit::INT) FILTER (side = 2) AS d2 FROM kr GROUP BY perm) SELECT CAST(perm AS INTEGER) AS perm, {r6('d1 AS density1', 'd2 AS density2', 'abs(d1 - d2) AS difference')} FROM kd"
add("k8_global_density_test", lambda s, d: permute.global_density_test(*global_rows(s, d), 0.1, 20), K8)

GLOBAL_CUT, GLOBAL_COUNT = 0.3, 100


def global_sql(value: str = "value") -> str:
    return f"""WITH {SIDES}, {B.AREA_SQL}, {perm_sql('sub', GLOBAL_COUNT)}, kv AS (SELECT perm, side, subject, node, {value} AS value FROM (SELECT perm, p.side, subject, node, value FROM prm p JOIN vals USING (subject))),
kr AS (SELECT a.perm, a.side, a.node AS i, b.node AS j, abs(round(covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)), 12)) >= {GLOBAL_CUT} AS hit FROM kv a JOIN kv b ON a.perm = b.perm AND a.subject = b.subject AND a.node < b.node GROUP BY a.perm, a.side, a.node, b.node),
ke AS MATERIALIZED (SELECT perm * 2 + side - 1 AS net, i, j FROM kr WHERE hit), kd AS MATERIALIZED (SELECT net, i AS a, j AS b FROM ke UNION ALL SELECT net, j, i FROM ke),
kn AS (SELECT DISTINCT perm * 2 + side - 1 AS net FROM prm), kg AS MATERIALIZED (SELECT net, a, count(*) AS deg FROM kd GROUP BY ALL),
kt AS (SELECT x.net, x.i AS a, x.j AS b, y.j AS c FROM ke x JOIN ke y ON x.net = y.net AND x.j = y.i JOIN ke z ON z.net = x.net AND z.i = x.i AND z.j = y.j),
kc AS (SELECT net, sum(2.0 * t / (deg * (deg - 1))) / {B.DIMS} AS clustering FROM (SELECT net, a, count(*) AS t FROM (SELECT net, unnest([a, b, c]) AS a FROM kt) GROUP BY ALL) JOIN kg USING (net, a) GROUP BY net),
h0 AS (SELECT net, a, b, 1 AS d FROM kd), {", ".join(f"h{k + 1} AS MATERIALIZED (SELECT net, a, b, min(d) AS d FROM (SELECT * FROM h{k} UNION ALL SELECT x.net, x.a, y.b, x.d + y.d FROM h{k} x JOIN h{k} y ON x.net = y.net AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)" for k in range(5))},
kp AS (SELECT net, avg(d) AS path_length FROM h5 GROUP BY net HAVING count(*) = {B.DIMS * (B.DIMS - 1)}),
km AS (SELECT net, sum(inn / tot - (al / tot) * (al / tot)) AS modularity FROM (SELECT net, x.area, sum((x.area = y.area)::INT) AS inn, count(*) AS al, sum(count(*)) OVER (PARTITION BY net) AS tot FROM kd JOIN areas x ON x.node = kd.a JOIN areas y ON y.node = kd.b GROUP BY net, x.area) GROUP BY net),
kx AS (SELECT kn.net, coalesce(m, 0) / {B.PAIRS}.0 AS density, coalesce(clustering, 0) AS clustering, path_length, modularity FROM kn LEFT JOIN (SELECT net, count(*) AS m FROM ke GROUP BY net) USING (net) LEFT JOIN kc USING (net) LEFT JOIN kp USING (net) LEFT JOIN km USING (net)),
kl AS (SELECT net // 2 AS perm, net % 2 AS side, unnest(['density', 'clustering', 'path_length', 'modularity']) AS metric, unnest([density, clustering, path_length, modularity]) AS value FROM kx),
k2 AS (SELECT perm, metric, max(value) FILTER (side = 0) AS value1, max(value) FILTER (side = 1) AS value2, max(value) FILTER (side = 0) - max(value) FILTER (side = 1) AS difference FROM kl GROUP BY ALL)
SELECT o.metric, {r6('o.value1 AS value1', 'o.value2 AS value2', 'o.difference AS difference', 'avg((abs(n.difference) >= abs(o.difference) - 1e-12)::INT) AS p')}, count(n.perm) AS n_null
FROM k2 o LEFT JOIN k2 n ON n.metric = o.metric AND n.perm > 0 AND n.difference IS NOT NULL AND o.difference IS NOT NULL WHERE o.perm = 0 GROUP BY ALL"""
add("k8_global_test", lambda s, d: permute.global_test(*global_rows(s, d), GLOBAL_CUT, GLOBAL_COUNT, areas=B.areas(s).select("node", "area")), global_sql())
RANKS = "rank() OVER (PARTITION BY perm, side, node ORDER BY value) + (count(*) OVER (PARTITION BY perm, side, node, value) - 1) / 2.0"
add("k8_global_test_ranks", lambda s, d: permute.global_test(*global_rows(s, d), GLOBAL_CUT, GLOBAL_COUNT, areas=B.areas(s).select("node", "area"), method="spearman"), global_sql(RANKS))

# L: contribution and discovery
NP = f"{B.CORR2}, {core.NETS}, np AS (SELECT a.matrix_key, a.approach, a.i, a.j, a.w AS w1, b.w AS w2, least(a.w, b.w) AS lo, greatest(a.w, b.w) AS hi FROM nets a JOIN nets b ON a.matrix_key = b.matrix_key AND a.i = b.i AND a.j = b.j AND a.grp = 'g0' AND b.grp = 'g1')"
SETS2 = "nd AS (SELECT DISTINCT i AS node FROM np UNION SELECT DISTINCT j FROM np), sets AS (SELECT node AS combo_id, 1 AS size, [node] AS nodes FROM nd UNION ALL SELECT a.node || ',' || b.node, 2, [a.node, b.node] FROM nd a JOIN nd b ON a.node < b.node)"


def contrib_sql(averaging: str, source: str = "np", sets: str = "sets", key: str = "", name: str = "cb") -> str:
    k = f"{key}, " if key else ""
    direct = f"{name}_m AS (SELECT {k}matrix_key, approach, combo_id, size, sum(lo) / nullif(sum(hi), 0) AS ja, coalesce(sum(lo) FILTER (NOT list_contains(nodes, i) AND NOT list_contains(nodes, j)) / nullif(sum(hi) FILTER (NOT list_contains(nodes, i) AND NOT list_contains(nodes, j)), 0), 0) AS jw FROM {source}, {sets} GROUP BY ALL)"
    inner = f"{name}_a AS (SELECT {k}combo_id, size, approach, avg(coalesce(ja, 0)) AS ja, avg(jw) AS jw FROM {name}_m GROUP BY ALL)" if averaging == "balanced" else f"{name}_a AS (SELECT {k}combo_id, size, coalesce(ja, 0) AS ja, jw FROM {name}_m)"
    return f"{direct}, {inner}, {name} AS (SELECT {k}combo_id, CAST(any_value(size) AS INTEGER) AS size, avg(ja) AS j_all, avg(jw) AS j_without, avg(jw) - avg(ja) AS contribution FROM {name}_a GROUP BY {k}combo_id)"


def pairs01(s, d):
    nets, nodes = core.networks(s, d)
    pairs = discover.network_pairs(nets.where("grp in ('g0', 'g1')"), "g0", "g1")
    return pairs.cache(), nodes  # a few rows per pair of nodes, read many times


def area_sets(s):
    return discover.sets_from(s, B.AREAS)


add("l1_leave_one_out", lambda s, d: discover.leave_one_out(pairs01(s, d)[0], discover.candidates(s, pairs01(s, d)[1], 1).unionByName(area_sets(s))), f"WITH {NP}, {SETS2}, {B.AREA_SQL}, s1 AS (SELECT * FROM sets WHERE size = 1 UNION ALL SELECT area, count(*), list(node) FROM areas GROUP BY area), {contrib_sql('balanced', sets='s1')} SELECT combo_id, size, {r6('j_all', 'j_without', 'contribution', '100 * contribution / nullif(j_all, 0) AS pct_change')} FROM cb")
add("l13_candidates", lambda s, d: discover.candidate_sets(core.some_nodes(s, d), 2).select("combo_id", "size"), f"WITH {NP}, {SETS2} SELECT combo_id, CAST(size AS INTEGER) AS size FROM sets")
add("l15_batch_contributions", lambda s, d: discover.contributions(pairs01(s, d)[0], discover.candidates(s, pairs01(s, d)[1], 2), "flat"), f"WITH {NP}, {SETS2}, {contrib_sql('flat')} SELECT combo_id, size, {r6('j_all', 'j_without', 'contribution')} FROM cb")
add("l16_complement_contributions", lambda s, d: discover.contributions(pairs01(s, d)[0], discover.complement_sets(area_sets(s), pairs01(s, d)[1]), "flat").where(f"size = {B.DIMS - 4}"), f"WITH {NP}, {SETS2}, {B.AREA_SQL}, cs AS (SELECT string_agg(node, ',' ORDER BY node) AS combo_id, {B.DIMS - 4} AS size, list(node) AS nodes FROM nd, (SELECT DISTINCT area AS ar FROM areas) WHERE node NOT IN (SELECT node FROM areas WHERE area = ar) GROUP BY ar), {contrib_sql('flat', sets='cs')} SELECT combo_id, size, {r6('j_all', 'j_without', 'contribution')} FROM cb")
SYN = f"{contrib_sql('balanced')}, spx AS (SELECT c.combo_id, sum(o.contribution) AS expected_additive FROM cb c JOIN cb o ON o.size = 1 AND list_contains(string_split(c.combo_id, ','), o.combo_id) GROUP BY c.combo_id), sy AS (SELECT cb.*, expected_additive, CASE WHEN size = 1 THEN 0 ELSE contribution - expected_additive END AS synergy, CASE WHEN contribution > 0 THEN 'dissimilarity' ELSE 'similarity' END AS direction FROM cb JOIN spx USING (combo_id)), sr AS (SELECT *, CASE WHEN size > 1 AND abs(expected_additive) > 1e-10 THEN synergy / abs(expected_additive) END AS synergy_ratio FROM sy), sx AS (SELECT *, CASE WHEN size = 1 THEN abs(contribution) ELSE coalesce(abs(synergy_ratio), 0.01 * abs(contribution)) END AS rank_score FROM sr)"


def syn(s, d):
    pairs, nodes = pairs01(s, d)
    return discover.synergy(discover.contributions(pairs, discover.candidates(s, nodes, 2)))


add("l13_synergy", syn, f"WITH {NP}, {SETS2}, {SYN} SELECT combo_id, size, direction, {r6('j_all', 'j_without', 'contribution', 'expected_additive', 'synergy', 'synergy_ratio', 'rank_score')} FROM sx")
add("l13_filter_pct", lambda s, d: discover.filter_candidates(syn(s, d), "pct_20").select("combo_id", "direction"), f"WITH {NP}, {SETS2}, {SYN}, f AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY rank_score DESC, combo_id) AS pl, count(*) OVER (PARTITION BY direction) AS al FROM sx) SELECT combo_id, direction FROM f WHERE pl <= greatest(1, ceil(al * 20.0 / 100))")
add("l13_filter_sd", lambda s, d: discover.filter_candidates(syn(s, d), "sd_1").select("combo_id", "direction"), f"WITH {NP}, {SETS2}, {SYN}, f AS (SELECT *, (contribution - avg(contribution) OVER w) / stddev_samp(contribution) OVER w AS z FROM sx WINDOW w AS (PARTITION BY direction)) SELECT combo_id, direction FROM f WHERE abs(z) > 1")
add("l19_node_summary", lambda s, d: discover.node_summary(syn(s, d)), f"WITH {NP}, {SETS2}, {SYN}, e AS (SELECT unnest(string_split(combo_id, ',')) AS node, direction = 'dissimilarity' AS dis, abs(contribution) AS c FROM sx) SELECT node, count(*) FILTER (NOT dis) AS sim_count, count(*) FILTER (dis) AS dissim_count, {r6('coalesce(sum(c) FILTER (NOT dis), 0) AS sim_contribution', 'coalesce(sum(c) FILTER (dis), 0) AS dissim_contribution')}, count(*) FILTER (dis) - count(*) FILTER (NOT dis) AS net_count, count(*) AS total_count, {r6('(count(*) FILTER (dis) - count(*) FILTER (NOT dis)) / count(*) AS direction_ratio')} FROM e GROUP BY node")
add("l10_connectivity_difference", lambda s, d: discover.connectivity_difference(pairs01(s, d)[0]), f"WITH {NP} SELECT i, j, {r6('avg(abs(w1 - w2)) AS difference')} FROM np GROUP BY i, j")
LP = 200
PP = f"pl AS (SELECT perm, side, node, row_number() OVER (PARTITION BY perm, side ORDER BY md5('42|' || perm || '|' || side || '|' || node), node) AS seat_no FROM nd, (SELECT unnest(range(1, {LP + 1})) AS perm), (SELECT unnest([1, 2]) AS side)), nm AS (SELECT node AS seat, row_number() OVER (ORDER BY node) AS seat_no FROM nd), ps2 AS (SELECT perm, side, node, seat FROM pl JOIN nm USING (seat_no)), pw AS (SELECT a.perm, a.side, matrix_key, approach, least(a.seat, b.seat) AS i, greatest(a.seat, b.seat) AS j, CASE WHEN a.side = 1 THEN w1 ELSE w2 END AS w FROM np JOIN ps2 a ON a.node = np.i JOIN ps2 b ON b.node = np.j AND a.perm = b.perm AND a.side = b.side), pp AS (SELECT x.perm, x.matrix_key, x.approach, x.i, x.j, least(x.w, y.w) AS lo, greatest(x.w, y.w) AS hi FROM pw x JOIN pw y ON x.side = 1 AND y.side = 2 AND x.perm = y.perm AND x.matrix_key = y.matrix_key AND x.i = y.i AND x.j = y.j)"
L18 = f"WITH {NP}, {SETS2}, {B.AREA_SQL}, {PP}, s1 AS (SELECT * FROM sets WHERE size = 1 UNION ALL SELECT area, count(*), list(node) FROM areas GROUP BY area), {contrib_sql('flat', sets='s1')}, {contrib_sql('flat', 'pp', 's1', 'perm', 'nl')} SELECT combo_id, cb.size, {r6('cb.contribution AS observed', f'(count(*) FILTER (abs(nl.contribution) >= abs(cb.contribution) - 1e-12) + 1) / {LP + 1}.0 AS p', f'list_sort(list(nl.contribution))[{int(0.025 * LP) + 1}] AS ci_low', f'list_sort(list(nl.contribution))[{min(LP - 1, int(0.975 * LP)) + 1}] AS ci_high')} FROM cb JOIN nl USING (combo_id) GROUP BY combo_id, cb.size, cb.contribution"
add("l18_permutation_p", lambda s, d: discover.permutation_p(pairs01(s, d)[0], discover.candidates(s, pairs01(s, d)[1], 1).unionByName(area_sets(s)), LP), L18)
add("l5_hypothesis_tests", lambda s, d: permute.adjust(discover.permutation_p(pairs01(s, d)[0], area_sets(s), LP, "balanced"), "p", "fdr").withColumn("stars", permute.stars("p_adjusted")))
L13 = f"""WITH {NP}, {SETS2}, {SYN}, f AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY rank_score DESC, combo_id) AS pl, count(*) OVER (PARTITION BY direction) AS al FROM sx),
kp AS MATERIALIZED (SELECT * FROM f WHERE pl <= greatest(1, ceil(al * 10.0 / 100))), s1 AS MATERIALIZED (SELECT sets.* FROM sets JOIN kp USING (combo_id)), {PP},
{contrib_sql('flat', sets='s1', name='cf')}, {contrib_sql('flat', 'pp', 's1', 'perm', 'nl')},
pt AS (SELECT combo_id, (count(*) FILTER (abs(nl.contribution) >= abs(cf.contribution) - 1e-12) + 1) / {LP + 1}.0 AS p FROM cf JOIN nl USING (combo_id) GROUP BY combo_id),
rr AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM pt), ad AS (SELECT *, (SELECT min(least(1, u.p * u.m / u.rk)) FROM rr u WHERE u.p >= rr.p) AS pa FROM rr)
SELECT combo_id, kp.size, direction, {r6('j_all', 'j_without', 'contribution', 'expected_additive', 'synergy', 'synergy_ratio', 'rank_score', 'p', 'pa AS p_adjusted')}, pa < 0.05 AS significant FROM kp JOIN ad USING (combo_id)"""
add("l13_brute_force", lambda s, d: discover.brute_force(pairs01(s, d)[0], discover.candidate_sets(core.some_nodes(s, d), 2), "pct_10", LP), L13)


MOST_STEPS = 10


def greedy_sql() -> str:
    """The greedy sets by brute force: in each step every candidate's remaining pairs are summed anew."""
    out = ["g0 AS (SELECT direction, []::VARCHAR[] AS chosen, 0.0::DOUBLE AS reached, 0 AS step FROM (SELECT unnest(['dissimilarity', 'similarity']) AS direction))"]
    for k in range(MOST_STEPS):
        out.append(
            f"c{k} AS MATERIALIZED (SELECT direction, node, chosen, reached, matrix_key, approach, coalesce(sum(lo) FILTER (keep) / nullif(sum(hi) FILTER (keep), 0), 0) - sum(lo) / sum(hi) AS c "
            f"FROM (SELECT g.*, nd.node, np.matrix_key, np.approach, lo, hi, i <> nd.node AND j <> nd.node AND NOT list_contains(chosen, i) AND NOT list_contains(chosen, j) AS keep "
            f"FROM g{k} g, nd, np WHERE NOT list_contains(chosen, nd.node)) GROUP BY ALL), "
            f"v{k} AS (SELECT direction, node, chosen, reached, avg(c) AS c FROM (SELECT direction, node, chosen, reached, approach, avg(c) AS c FROM c{k} GROUP BY ALL) GROUP BY ALL), "
            f"g{k + 1} AS MATERIALIZED (SELECT direction, list_append(chosen, node) AS chosen, c AS reached, {k + 1} AS step FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY direction ORDER BY round(CASE WHEN direction = 'similarity' THEN c ELSE -c END, 12), node) AS place FROM v{k}) "
            f"WHERE place = 1 AND CASE WHEN direction = 'similarity' THEN reached - c ELSE c - reached END > 1e-12)"
        )
    rows = " UNION ALL ".join(f"SELECT direction, step, chosen[step] AS node, reached AS contribution FROM g{k + 1}" for k in range(MOST_STEPS))
    return f"WITH {NP}, nd AS (SELECT DISTINCT i AS node FROM np UNION SELECT DISTINCT j FROM np), {', '.join(out)}, gs AS ({rows})"


ELBOW = """ge AS (SELECT *, coalesce((abs(contribution) - min(abs(contribution)) OVER d) / nullif(max(abs(contribution)) OVER d - min(abs(contribution)) OVER d, 0), 0) AS y, count(*) OVER d AS n FROM gs WINDOW d AS (PARTITION BY direction)),
gf AS (SELECT *, first(y) OVER w AS y1, last(y) OVER w AS y2, coalesce((step - 1) / nullif(n - 1, 0), 0) AS x FROM ge WINDOW w AS (PARTITION BY direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gd AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY round(abs((y2 - y1) * x - y + y1), 12) DESC, step) AS place FROM gf),
gc AS (SELECT direction, CASE WHEN any_value(n) < 3 THEN any_value(n) ELSE max(step) FILTER (place = 1) END AS cut FROM gd GROUP BY direction)"""
GREEDY = greedy_sql()
add("l6_greedy_selection", lambda s, d: discover.greedy(pairs01(s, d)[0], MOST_STEPS), f"{GREEDY} SELECT direction, CAST(step AS INTEGER) AS step, node, {r6('contribution')} FROM gs")
add("l7_elbow", lambda s, d: discover.to_elbow(discover.greedy(pairs01(s, d)[0], MOST_STEPS)), f"{GREEDY}, {ELBOW} SELECT direction, CAST(step AS INTEGER) AS step, node, {r6('contribution')} FROM gs JOIN gc USING (direction) WHERE step <= cut")
L9 = f"""{GREEDY}, {ELBOW}, {PP}, s1 AS MATERIALIZED (SELECT direction AS combo_id, count(*) AS size, list(node ORDER BY node) AS nodes FROM gs JOIN gc USING (direction) WHERE step <= cut GROUP BY direction),
{contrib_sql('balanced', sets='s1')}, {contrib_sql('balanced', 'pp', 's1', 'perm', 'nl')}
SELECT combo_id AS direction, array_to_string(any_value(s1.nodes), ',') AS nodes, cb.size, {r6('cb.contribution AS contribution', f'least(1, 2 * (count(*) FILTER (abs(nl.contribution) >= abs(cb.contribution) - 1e-12) + 1) / {LP + 1}.0) AS p')}
FROM cb JOIN nl USING (combo_id) JOIN s1 USING (combo_id) GROUP BY combo_id, cb.size, cb.contribution"""
add("l9_both_directions", lambda s, d: discover.greedy_discovery(pairs01(s, d)[0], MOST_STEPS, LP), L9)
add("l12_cluster_discovery", lambda s, d: discover.cluster_discovery(*pairs01(s, d), count=20))


_FITTED: dict[tuple[str, str], tuple] = {}


def fitted01(s, d):
    """(rows, nodes, prepared subjects, path): a session fits a folder's path once."""
    key = s.sparkContext.applicationId, d
    if key not in _FITTED:
        rows, nodes = global_rows(s, d)
        rows = rows.select("side", "values")
        _FITTED[key] = (rows, nodes, *discover.lasso_fit(rows, nodes))
    return _FITTED[key]


def lasso01(s, d, choice="min"):
    rows, nodes, _, fitted = fitted01(s, d)
    return discover.lasso(rows, nodes, choice=choice, fitted=fitted)


def lasso_confusion01(s, d):
    _, _, data, fitted = fitted01(s, d)
    return penalised.confusion(data, fitted.coefficients[0, fitted.least])


add("l20_lasso", lasso01)
add("l20_lasso_1se", lambda s, d: lasso01(s, d, "1se"))
add("l20_lasso_path", lambda s, d: fitted01(s, d)[3].table(s))
add("l20_lasso_confusion", lasso_confusion01)
add("l21_lasso_agreement", lambda s, d: discover.lasso_agreement(lasso01(s, d), discover.node_summary(syn(s, d))))
L2COMBOS = [",".join(c) for c in combinations(["d00", "d01", "d02"], 2)]
add("l3_set_test", lambda s, d: discover.permutation_p(pairs01(s, d)[0], discover.sets_from(s, {c: c.split(",") for c in L2COMBOS}), LP, "balanced"), f"WITH {NP}, {SETS2}, {PP}, s1 AS (SELECT * FROM sets WHERE combo_id IN ({', '.join(repr(c) for c in L2COMBOS)})), {contrib_sql('balanced', sets='s1')}, {contrib_sql('balanced', 'pp', 's1', 'perm', 'nl')} SELECT combo_id, cb.size, {r6('cb.contribution AS observed', f'(count(*) FILTER (abs(nl.contribution) >= abs(cb.contribution) - 1e-12) + 1) / {LP + 1}.0 AS p', f'list_sort(list(nl.contribution))[{int(0.025 * LP) + 1}] AS ci_low', f'list_sort(list(nl.contribution))[{min(LP - 1, int(0.975 * LP)) + 1}] AS ci_high')} FROM cb JOIN nl USING (combo_id) GROUP BY combo_id, cb.size, cb.contribution")
