"""Queries against their SQL twins, kernels against plain definitions, and hand-made cases of the rules."""

import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from conftest import DATA

import __spark_entry__ as entry
from hubweave.functions.stats import incomplete_beta, t_two_sided
from hubweave.operators import discover, graph_metrics, impute, kernels, network, permute, plotdata, similarity
from hubweave.plans import catalog
from hubweave.sources.observations import region_columns


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", ["b1_mean_fill", "c1_pearson", "c2_spearman", "c3_kendall", "c5_shrinkage", "e1_consensus", "d1_percolation_threshold", "f4_local_clustering", "f18_area_metrics", "hub_query", "h3_conserved_edges", "h5_weighted_similarity", "i1_persistence_sweep", "k2_two_sample_test", "l15_batch_contributions", "r_similarity_matrix", "r_strength_stability", "r_dual_network", "r_area_edges", "r_rank_agreement", "r_conservation_summary", "r_test_log_p"])
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in got.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert rows == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def random_graph(seed, n=7, p=0.5):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.random((n, n)) * (rng.random((n, n)) < p), 1)
    return m + m.T


@pytest.mark.parametrize("seed", range(5))
def test_betweenness_by_enumeration(seed):
    m = random_graph(seed)
    n = len(m)
    expect = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        paths = [(sum(m[a, b] for a, b in itertools.pairwise((s, *mid, t))), mid) for k in range(n - 1) for mid in itertools.permutations([x for x in range(n) if x not in (s, t)], k) if all(m[a, b] > 0 for a, b in itertools.pairwise((s, *mid, t)))]
        if paths:
            best = min(p[0] for p in paths)
            short = [mid for length, mid in paths if abs(length - best) < 1e-10]
            for mid in short:
                for v in mid:
                    expect[v] += 1 / len(short)
    assert np.allclose(kernels.betweenness(m)[0], expect)


def test_kernel_properties():
    m = random_graph(11, 9, 0.7)
    v = kernels.eigenvector(m)
    assert v.max() == pytest.approx(1)
    lam = (m @ v)[v.argmax()]
    assert np.allclose(m @ v, lam * v, atol=1e-8)
    assert kernels.pagerank(m).sum() == pytest.approx(1)
    labels, q = kernels.louvain(m)
    assert q == pytest.approx(kernels.modularity(m, labels))
    assert kernels.mean_distance(np.zeros((3, 3))) == np.inf


def test_spanning_tree_is_smallest():
    m = random_graph(3, 5, 1.0)
    i, j = np.triu_indices(5, 1)
    w = m[i, j]
    kept = kernels.spanning_tree(5, i, j, w)

    def spans(edges):
        return len(np.unique(kernels.component_labels(kernels.adjacency(5, i[list(edges)], j[list(edges)], np.ones(4))))) == 1

    assert w[kept].sum() == pytest.approx(min(w[list(e)].sum() for e in itertools.combinations(range(10), 4) if spans(e)))


def test_percolation_counts_whole_graphs(spark):
    rows = [("m", "g", i, j, w) for i, j, w in (("0", "1", 0.5), ("1", "2", 0.3), ("0", "2", 0.1))]
    curve = {r["step"]: r for r in network.percolation_curve(spark.createDataFrame(rows, "method string, grp string, i string, j string, r double")).collect()}
    assert [(round(3 * curve[t]["giant"]), curve[t]["n_components"], round(3 * curve[t]["density"])) for t in (10, 30, 50, 60)] == [(3, 1, 3), (3, 1, 2), (2, 2, 1), (1, 3, 0)]


def test_inequality_rules(spark):
    corr = spark.createDataFrame([("m", "g", "a", "b", 0.5), ("m", "g", "a", "c", -0.5), ("m", "g", "b", "c", 0.0)], "method string, grp string, i string, j string, r double")
    assert network.threshold_network(corr, 0.5).count() == 2
    assert network.binary_edges(corr, 0.5).count() == 0
    assert network.threshold_network(corr, 0.0).count() == 2
    with pytest.raises(ValueError):
        network.threshold_network(corr, None)
    nodes = graph_metrics.nodes_of(corr)
    assert {r["node"]: r["degree"] for r in graph_metrics.node_degrees(network.threshold_network(corr, 0.5), nodes).collect()} == {"a": 2, "b": 1, "c": 1}


def test_imputation_keeps_what_was_seen(spark):
    rows = spark.createDataFrame([("g", k, [float(k), None if k % 4 == 0 else float(k * k)]) for k in range(20)], "grp string, subject long, values array<double>")
    out = {r["subject"]: r["values"] for r in impute.predictive_mean_matching(rows, ["x", "y"]).collect()}
    seen = {float(k * k) for k in range(20) if k % 4}
    assert all(out[k][1] == k * k for k in range(20) if k % 4) and all(out[k][1] in seen for k in range(0, 20, 4))


def test_contribution_equals_direct_sums(spark):
    rng = np.random.default_rng(5)
    nodes = list("abcdef")
    rows = [("k", "weighted", i, j, float(x), float(y)) for (i, j), x, y in zip(itertools.combinations(nodes, 2), rng.random(15), rng.random(15), strict=True)]
    nets = spark.createDataFrame([(k, a, g, i, j, w) for k, a, i, j, x, y in rows for g, w in (("g1", x), ("g2", y))], "matrix_key string, approach string, grp string, i string, j string, w double")
    pairs = discover.network_pairs(nets, "g1", "g2").cache()
    found = {r["combo_id"]: r["contribution"] for r in discover.contributions(pairs, discover.candidates(spark, nodes, 3)).collect()}

    def jac(skip):
        own = [(x, y) for _, _, i, j, x, y in rows if i not in skip and j not in skip]
        return sum(map(min, own)) / sum(map(max, own))

    assert len(found) == 6 + 15 + 20
    for combo, value in found.items():
        assert value == pytest.approx(jac(combo.split(",")) - jac([]))
    steps = {(r["direction"], r["step"]): r["contribution"] for r in discover.greedy(pairs, 2).collect()}
    assert steps["dissimilarity", 1] == pytest.approx(max(v for k, v in found.items() if len(k) == 1))


def test_clustering_and_elbow(spark):
    x = np.array([0, 0.1, 5, 5.1, 9, 9.2])
    d = np.abs(x[:, None] - x[None])
    k, labels = discover.best_clusters(d, 4)
    assert k == 3 and list(labels) == [0, 0, 1, 1, 2, 2]
    values = [("a", v) for v in (1, 2)] + [("b", v) for v in (0, 9, 9.5, 9.8, 10)]
    steps = spark.createDataFrame([(n, 1 + sum(m == n for m, _ in values[:at]), f"n{at}", float(v)) for at, (n, v) in enumerate(values)], "direction string, step int, node string, contribution double")
    assert sorted((r["direction"], r["step"]) for r in discover.to_elbow(steps).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_scalars():
    assert permute.required_permutations(1)["permutations"] == 1000
    assert permute.required_permutations(100)["permutations"] == 4000
    assert permute.count_combinations(5, 2) == 15
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert t_two_sided(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-4)


def test_adjust_keeps_nulls(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "id int, p double")
    got = {r["id"]: r["p_adjusted"] for r in permute.adjust(t).collect()}
    assert got[3] is None and got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.04) and got[4] == pytest.approx(0.04)


def test_region_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3.0, "x")], "Group string, Idle int, age_x double, ctx double, note string")
    assert region_columns(df) == ["ctx"]


def test_hub_overlap_of_empty_sets(spark):
    hubs = spark.createDataFrame([("g1", "a")], "grp string, node string")
    groups = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "grp string")
    rows = {(r["g1"], r["g2"]): r["jaccard"] for r in similarity.hub_overlap(hubs, groups).collect()}
    assert rows == {("g1", "g2"): 0.0, ("g1", "g3"): 0.0, ("g2", "g3"): 0.0}
    with pytest.raises(ValueError):
        similarity.hub_overlap(hubs, groups.limit(1))


def test_minus_log_p_of_zero(spark):
    tests = spark.createDataFrame([("a", 0.0), ("b", 0.01), ("c", 1.0)], "node string, p double")
    got = {r["node"]: r["minus_log10"] for r in plotdata.minus_log_p(tests, "p").collect()}
    assert got["a"] == pytest.approx(2.4) and got["b"] == pytest.approx(2.0) and got["c"] == 0


def test_dual_network_sides(spark):
    rows = [("m", g, i, j, r) for g, rs in (("x", (0.9, -0.8, 0.1, 0.2)), ("y", (0.9, 0.1, 0.8, 0.2))) for (i, j), r in zip((("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")), rs, strict=True)]
    corr = spark.createDataFrame(rows, "method string, grp string, i string, j string, r double")
    got = {(r["i"], r["j"]): r["found"] for r in plotdata.dual_network(corr, "x", "y").collect()}
    assert got == {("a", "b"): "both", ("a", "c"): "first", ("b", "c"): "second"}


def test_area_edges_and_scaling(spark):
    edges = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c")], "net string, src string, dst string")
    areas = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "node string, area string")
    assert {(r["area"], r["internal"], r["external"]) for r in plotdata.area_edges(edges, areas, "net").collect()} == {("p", 1, 1), ("q", 0, 1)}
    values = spark.createDataFrame([("k", "a", 1.0, 5.0), ("k", "b", 3.0, 5.0)], "net string, node string, v double, w double")
    assert {(r["node"], r["v"], r["w"]) for r in plotdata.scaled(values, ["v", "w"], "net").collect()} == {("a", 0.0, 0.0), ("b", 1.0, 0.0)}
