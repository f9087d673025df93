"""Queries over export tables, drivers and the plot data that have no query elsewhere, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hubweave.operators import discover, exports, permute
from hubweave.plans import binding as B
from hubweave.plans import comparisons as C
from hubweave.plans import core
from hubweave.plans import scores as SC
from hubweave.plans.binding import q, r6
from hubweave.sources.scratch import shared_folder

Q, S = {}, {}
METHODS = list(B.FIVE)
HUB = SC.HUB


def add(name, build, sql=None):
    Q[name] = q(build)
    if sql:
        S[name] = sql


FLAGS = ", ".join(f"max(CASE WHEN method = '{m}' AND is_hub THEN 1 ELSE 0 END) AS {m}" for m in METHODS)
add("a7_method_agreement", lambda s, d: exports.method_agreement(SC.hubs(s, d).where("approach = 'percolation'"), METHODS, "grp"), f"WITH RECURSIVE {HUB} SELECT grp, node, {FLAGS} FROM hz WHERE approach = 'percolation' GROUP BY grp, node")
add("a7_consensus_hubs", lambda s, d: exports.consensus_hubs(SC.hubs(s, d), "grp"), f"WITH RECURSIVE {HUB} SELECT grp, node, count(*) FILTER (is_hub) AS n_hub, {r6('avg(is_hub::INT) AS share')} FROM hz GROUP BY grp, node")
add("a8_hub_lists", lambda s, d: exports.hub_lists(SC.hubs(s, d), "grp", "approach", "method"), f"WITH RECURSIVE {HUB} SELECT grp, approach, method, count(*) FILTER (is_hub) AS n_hubs, coalesce(string_agg(node, ',' ORDER BY node) FILTER (is_hub), '') AS hubs FROM hz GROUP BY ALL")
add("o_safe_filenames", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", exports.safe_filename(F.col("p_name")).alias("safe")), "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS safe FROM part")


def conserved(name):
    """Half of the groups have a threshold of their own, the others take the default."""

    def build(s, d):
        corr, _ = B.corr2(s, d)
        own = corr.where("grp < 'g5'").select("method", "grp").distinct().withColumn("threshold", F.lit(0.21))
        return exports.conservation(corr, own)[name]

    return build


add("h4_conservation", conserved("similarity"), f"""WITH {B.CORR2},
e AS (SELECT method, grp, i, j, CASE WHEN abs(r) > CASE WHEN grp < 'g5' THEN 0.21 ELSE 0.5 END THEN 1 ELSE 0 END AS w FROM corr),
x AS (SELECT a.method, a.grp AS g1, b.grp AS g2, sum(a.w * b.w) AS shared, sum(greatest(a.w, b.w)) AS either, sum(a.w) AS edges1, sum(b.w) AS edges2 FROM e a JOIN e b USING (method, i, j) WHERE a.grp < b.grp GROUP BY ALL)
SELECT *, {r6('coalesce(shared / nullif(either, 0), 0) AS jaccard', 'coalesce(shared / nullif(least(edges1, edges2), 0), 0) AS overlap', 'coalesce(shared / nullif(edges1, 0), 0) AS preserved_1_2', 'coalesce(shared / nullif(edges2, 0), 0) AS preserved_2_1')} FROM x""")

SETS1 = "s1 AS (SELECT * FROM sets WHERE size = 1 UNION ALL SELECT area, count(*), list(node) FROM areas GROUP BY area)"


def tested(sets_sql: str, adjusted: str = "") -> str:
    """Permutation p of each set's balanced contribution, adjusted by Benjamini and Hochberg."""
    return f"""WITH {SC.NP}, {SC.SETS2}, {B.AREA_SQL}, {SC.PP}, {sets_sql}, {SC.contrib_sql('balanced', sets='s1')}, {SC.contrib_sql('balanced', 'pp', 's1', 'perm', 'nl')},
pt AS (SELECT combo_id, cb.size, cb.contribution AS observed, (count(*) FILTER (abs(nl.contribution) >= abs(cb.contribution) - 1e-12) + 1) / {SC.LP + 1}.0 AS p FROM cb JOIN nl USING (combo_id) GROUP BY combo_id, cb.size, cb.contribution),
rr AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM pt),
ad AS (SELECT *, (SELECT min(least(1, u.p * u.m / u.rk)) FROM rr u WHERE u.p >= rr.p) AS pa FROM rr)
SELECT combo_id, size, {r6('observed', 'p', 'pa AS p_adjusted')}, CASE WHEN pa < 0.001 THEN '***' WHEN pa < 0.01 THEN '**' WHEN pa < 0.05 THEN '*' ELSE '' END AS stars FROM ad"""


def set_tests(pairs, sets):
    found = permute.adjust(discover.permutation_p(pairs, sets, SC.LP, "balanced"), "p", "fdr")
    return found.withColumn("stars", permute.stars("p_adjusted")).select("combo_id", "size", "observed", "p", "p_adjusted", "stars")


def leave_one_out_tests(s, d):
    pairs, nodes = SC.pairs01(s, d)
    return set_tests(pairs, discover.candidates(s, nodes, 1).unionByName(SC.area_sets(s)))


add("l2_leave_one_out_test", leave_one_out_tests, tested(SETS1))
add("l5_area_tests", lambda s, d: set_tests(SC.pairs01(s, d)[0], SC.area_sets(s)), tested("s1 AS (SELECT area AS combo_id, count(*) AS size, list(node) AS nodes FROM areas GROUP BY area)"))


def persistence_pairs(s, d):
    nets, nodes = core.networks(s, d)
    return discover.network_pairs(nets.where("approach = 'persistence' and grp in ('g0', 'g1')"), "g0", "g1"), nodes


def persistence_batch(s, d):
    pairs, nodes = persistence_pairs(s, d)
    return discover.contributions(pairs, discover.candidates(s, nodes, 1).unionByName(SC.area_sets(s)), "flat")


add("l17_persistence_contributions", persistence_batch, f"WITH {SC.NP}, {SC.SETS2}, {B.AREA_SQL}, {SETS1}, np2 AS (SELECT * FROM np WHERE approach = 'persistence'), {SC.contrib_sql('flat', 'np2', 's1')} SELECT combo_id, size, {r6('j_all', 'j_without', 'contribution')} FROM cb")

STEPS = 8
STEP_COLS = ", ".join(f"coalesce(max(strength) FILTER (step = {k}), 0) AS s{k}" for k in range(STEPS))
ABOVE = " + ".join(f"(s{k} > 0.1)::INT" for k in range(STEPS))
add("r_persistence_heatmap", lambda s, d: exports.persistence_heatmap(C.sweep(s, d)[3], "strength", STEPS), f"WITH {C.SWEEP}, wd AS (SELECT method, grp, node, {STEP_COLS} FROM sw GROUP BY ALL), sc AS (SELECT *, ({ABOVE}) / {STEPS}.0 AS score FROM wd), pl AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY round(score, 9) DESC, node) AS place FROM sc) SELECT method, grp, node, {r6('score', *[f's{k}' for k in range(STEPS)])} FROM pl WHERE place <= 10")
add("r_persistent_nodes", lambda s, d: exports.top_per_network(Q_I2(s, d), "score", 5, "method", "grp").select("method", "grp", "node", "score", "place"), C.S["i2_hub_persistence"].replace("WITH ", "WITH RECURSIVE i2 AS (WITH ", 1) + "), pl AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY round(score, 9) DESC, node) AS place FROM i2) SELECT method, grp, node, score, place FROM pl WHERE place <= 5")
add("r_hub_venn_pairs", lambda s, d: exports.top_overlaps(C.Q["h20_hub_overlap"](s, d)), f"SELECT * FROM ({C.H20}) ORDER BY round(jaccard, 9) DESC, g1, g2 LIMIT 6")
add("r_metric_variance", lambda s, d: exports.metric_variance(C.Q["h10_metric_aggregation"](s, d), 2), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(cv, 9), metric) AS place FROM ({C.H10}) WHERE cv IS NOT NULL) WHERE place <= 2")


def Q_I2(s, d):
    return C.Q["i2_hub_persistence"](s, d)


def regional(s, d):
    values = SC.scores(s, d, ("pearson",)).drop("strength")
    return exports.regional_summary(values.where("approach = 'weighted'"), values.where("approach = 'persistence'"), B.areas(s))


QUARTILES = ", ".join(r6(f"quantile_cont({v}, {x}) AS {n}_{v}") for v in "ab" for n, x in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
add("r_regional_summary", regional, f"WITH RECURSIVE {SC.SCORES}, {B.AREA_SQL}, wa AS (SELECT grp, node, value AS a FROM sc WHERE method = 'pearson' AND approach = 'weighted'), pb AS (SELECT grp, node, value AS b FROM sc WHERE method = 'pearson' AND approach = 'persistence'), fu AS (SELECT * FROM wa FULL OUTER JOIN pb USING (grp, node)) SELECT grp, coalesce(area, 'Other') AS area, count(*) AS n, {QUARTILES} FROM fu LEFT JOIN areas ar USING (node) GROUP BY grp, coalesce(area, 'Other')")


# A: sinks: tables written as CSV, one folder for each method and group, and read back
def sunk(name, *by):
    def build(s, d):
        table = known()[name](s, d)
        path = f"{shared_folder(s)}/results/{uuid.uuid4().hex}"
        exports.write_results({name: table}, path, *by)
        return exports.read_results(s, path, table.schema, name)

    return build


def known():
    return {k: v for m in (core, C, SC) for k, v in m.Q.items()}


def known_sql():
    return {k: v for m in (core, C, SC) for k, v in m.S.items()}


SINKS = {
    "a4_threshold_sink": ("d1_percolation_threshold", "method"), "a4_node_sink": ("f10_degree_strength", "method", "grp"), "a4_global_sink": ("f1_density", "method"),
    "a5_strength_sink": ("g5_node_strength", "method", "grp"), "a6_hub_persistence_sink": ("i2_hub_persistence", "method", "grp"), "a6_auc_sink": ("i6_node_auc", "method", "grp"),
    "a9_similarity_sink": ("h9_network_similarity", "method"), "a10_aggregated_sink": ("i5_aggregated_metrics", "method", "grp"), "a10_raw_sink": ("a1_observations", "grp"), "a10_imputed_sink": ("b1_mean_fill", "grp"),
}
for sink, (source, *by) in SINKS.items():
    add(sink, sunk(source, *by), known_sql()[source])
