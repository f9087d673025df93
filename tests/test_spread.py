"""Iterations over networks by joins against plain numpy."""

import itertools

import numpy as np
import pytest

from hubweave.operators import correlate, discover, network, permute, spread, threshold_free
from hubweave.operators.graph_metrics import nodes_of


def random_networks(seed=3):
    """(method, grp, src, dst, w): a dense one, a sparse one in pieces, a path, a two-sided star, two equal pieces."""
    rng = np.random.default_rng(seed)
    names = [f"n{k:02d}" for k in range(14)]
    rows = []
    for grp, share in (("dense", 1.0), ("sparse", 0.12)):
        for a, b in itertools.combinations(names, 2):
            if rng.random() < share:
                rows.append(("m", grp, a, b, float(np.round(rng.random() + 0.05, 6))))
    rows += [("m", "path", a, b, 0.5) for a, b in itertools.pairwise(names)]
    rows += [("m", "star", names[0], b, 0.3) for b in names[1:]]
    rows += [("m", "equal", "n00", "n01", 0.7), ("m", "equal", "n05", "n09", 0.7), ("m", "equal", "n03", "n04", 0.2)]
    return names, rows


@pytest.fixture(scope="module")
def nets(spark):
    names, rows = random_networks()
    edges = spark.createDataFrame(rows, "method string, grp string, src string, dst string, w double")
    groups = sorted({r[1] for r in rows})
    nodes = spark.createDataFrame([("m", g, n) for g in groups for n in names], "method string, grp string, node string")
    return names, rows, edges, nodes, groups


def matrix(names, rows, grp):
    m = np.zeros((len(names), len(names)))
    for _, g, a, b, w in rows:
        if g == grp:
            m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w
    return m


def labels(m):
    out = list(range(len(m)))
    for _ in m:
        for i, j in zip(*np.nonzero(m)):
            out[i] = out[j] = min(out[i], out[j])
    return out


def test_components(nets):
    names, rows, edges, nodes, groups = nets
    got = {(r["grp"], r["node"]): r["component"] for r in spread.all_components(edges, nodes).collect()}
    assert got == {(g, n): names[labels(matrix(names, rows, g))[k]] for g in groups for k, n in enumerate(names)}


def test_components_of_a_long_chain(spark):
    names = [f"{k:04d}" for k in np.random.default_rng(1).permutation(500)]
    chain = [("x", min(a, b), max(a, b), 1.0) for a, b in itertools.pairwise(names)]
    got = spread.components(spark.createDataFrame(chain, "net string, src string, dst string, w double"), ("net",)).collect()
    assert len(got) == 500 and {r["component"] for r in got} == {"0000"}


def test_nothing_from_nothing(spark, nets):
    _, _, edges, nodes, _ = nets
    none = edges.where("false")
    assert spread.components(none).count() == 0
    assert spread.spanning_forest(none).count() == 0
    assert {r["eigenvector"] for r in spread.eigenvector(none, nodes).collect()} == {0.0}
    assert {r["component"] == r["node"] for r in spread.all_components(none, nodes).collect()} == {True}


def test_spanning_forest(nets):
    names, rows, edges, _, groups = nets
    for largest in (False, True):
        got = {(r["grp"], r["src"], r["dst"]) for r in spread.spanning_forest(edges, largest=largest).collect()}
        expect = set()
        for g in groups:
            root = {n: n for n in names}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for _, _, a, b, w in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[4] if largest else r[4], r[2], r[3])):
                if find(a) != find(b):
                    root[find(a)] = find(b)
                    expect.add((g, a, b))
        assert got == expect


def test_paths(nets):
    names, rows, edges, nodes, groups = nets
    whole, close = spread.path_metrics(edges, nodes)
    whole, close = {r["grp"]: r for r in whole.collect()}, {(r["grp"], r["node"]): r["closeness"] for r in close.collect()}
    for g in groups:
        m = matrix(names, rows, g)
        d = np.where(m > 0, m, np.inf)
        np.fill_diagonal(d, 0)
        for k in range(len(d)):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
        connected = np.isfinite(d).all()
        assert whole[g]["connected"] == connected
        upper = d[np.triu_indices(len(d), 1)]
        assert whole[g]["path_length"] == pytest.approx(upper.mean() if connected else np.inf)
        assert whole[g]["diameter"] == pytest.approx(d.max() if connected else 0)
        for k, n in enumerate(names):
            assert close[g, n] == pytest.approx((len(names) - 1) / d[k].sum() if connected else 0)


def test_eigenvector(nets):
    names, rows, edges, nodes, groups = nets
    got = {(r["grp"], r["node"]): r["eigenvector"] for r in spread.eigenvector(edges, nodes).collect()}
    for g in groups:
        m = matrix(names, rows, g)
        label = np.array(labels(m))
        best, expect = -1.0, np.zeros(len(names))
        for c in sorted(set(label)):
            own = np.flatnonzero(label == c)
            values, vectors = np.linalg.eigh(m[np.ix_(own, own)])
            if values[-1] > best + 1e-9 and len(own) > 1:
                best, v = values[-1], np.abs(vectors[:, -1])
                expect = np.zeros(len(names))
                expect[own] = v / v.max()
        assert np.allclose([got[g, n] for n in names], expect, atol=1e-8), g


def test_percolation_falls_apart_at_the_weakest_tree_edge(spark):
    """One network in a piece down to 0.3 exactly; one whose largest piece has 3 of 4 nodes."""
    rows = [("m", "a", "x", "y", 0.9), ("m", "a", "x", "z", -0.3), ("m", "a", "y", "z", 0.1), ("m", "b", "x", "y", 0.5), ("m", "b", "x", "z", 0.4), ("m", "b", "y", "z", 0.2), ("m", "b", "x", "u", 0.0)]
    corr = spark.createDataFrame(rows, "method string, grp string, i string, j string, r double")
    assert {r["grp"]: r["threshold"] for r in network.percolation_thresholds(corr).collect()} == {"a": 0.3, "b": 0.4}
    curve = {(r["grp"], r["step"]): (r["giant"], r["n_components"], r["density"]) for r in network.percolation_curve(corr).collect()}
    assert curve["a", 30] == (1.0, 1, pytest.approx(2 / 3)) and curve["a", 31] == (pytest.approx(2 / 3), 2, pytest.approx(1 / 3))
    assert curve["b", 95] == (0.25, 4, 0.0) and len(curve) == 190


def test_correlations_on_a_threshold_do_not_depend_on_partitions(spark):
    """Rank correlations of -0.2 exactly stay on the threshold with 1, 3 and 16 partitions."""
    rng = np.random.default_rng(8)
    rows = [("g", k, [float(a), float(b), float(c)]) for k, (a, b, c) in enumerate(zip(range(5), [1, 4, 0, 3, 2], rng.permutation(5).tolist()))]
    seen = set()
    for parts in (1, 3, 16):
        frame = spark.createDataFrame(rows, "grp string, subject long, values array<double>").repartition(parts)
        corr = correlate.spearman(frame, ["a", "b", "c"])
        r = {(x["i"], x["j"]): x["r"] for x in corr.collect()}
        edges = network.threshold_network(corr, abs(r["a", "b"])).count()
        seen.add((tuple(sorted(r.items())), edges))
    assert len(seen) == 1


def test_permutations_keep_sizes_and_follow_the_digest(spark):
    import hashlib

    subjects = spark.range(300).selectExpr("id as subject", "if(id % 3 = 0, 1, 2) as side")
    got = permute.permutations(subjects, 3).collect()
    for perm in (1, 2, 3):
        order = sorted(range(300), key=lambda s: (hashlib.md5(f"42|{perm}|{s}".encode()).hexdigest(), s))
        assert {r["subject"] for r in got if r["perm"] == perm and r["side"] == 1} == set(order[:100])


def test_component_tests(spark):
    """Three matrices a side; x-y-z differ strongly, u-v weakly."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(8):
        side = 1 + (k >= 4)
        for i, j in itertools.combinations("uvxyz", 2):
            shift = 5.0 * (side == 1) if {i, j} <= set("xyz") else 0.0
            rows.append((f"m{k}", side, i, j, float(rng.normal() * 0.1 + shift)))
    stacks = spark.createDataFrame(rows, "matrix string, side int, i string, j string, w double")
    found = {r["node"]: r for r in permute.component_tests(stacks, 8.0, 60).collect()}
    assert set(found) == {"x", "y", "z"} and {r["component"] for r in found.values()} == {"x"} and {r["size"] for r in found.values()} == {3}
    null = {r["perm"]: r["largest"] for r in permute.network_based_statistic(stacks, 8.0, 60).collect()}
    assert null[0] == 3 and len(null) == 61 and min(null.values()) == 1
    assert found["x"]["p"] == pytest.approx(np.mean([v >= 3 for p, v in null.items() if p]))


def pair_table(spark, seed=5, n=6, matrices=3):
    rng = np.random.default_rng(seed)
    names = [f"d{k}" for k in range(n)]
    rows = []
    for m in range(matrices):
        for i, j in itertools.combinations(names, 2):
            a, b = rng.random(2).round(4).tolist()
            rows.append((f"m{m}", "x" if m < 2 else "y", i, j, min(a, b), max(a, b), a, b))
    return names, rows, spark.createDataFrame(rows, "matrix_key string, approach string, i string, j string, lo double, hi double, w1 double, w2 double")


def contribution(rows, chosen):
    per = {}
    for key in sorted({(r[0], r[1]) for r in rows}):
        own = [r for r in rows if r[0] == key[0]]
        left = [r for r in own if r[2] not in chosen and r[3] not in chosen]
        high = sum(r[5] for r in left)
        per.setdefault(key[1], []).append((sum(r[4] for r in left) / high if high else 0) - sum(r[4] for r in own) / sum(r[5] for r in own))
    return np.mean([np.mean(v) for v in per.values()])


def test_greedy_grows_as_by_brute_force(spark):
    names, rows, pairs = pair_table(spark)
    expect = []
    for direction, sign in (("dissimilarity", 1), ("similarity", -1)):
        chosen, reached = [], 0.0
        while len(chosen) < len(names) - 2:
            best = min((n for n in names if n not in chosen), key=lambda n: (-sign * round(contribution(rows, [*chosen, n]), 12), n))
            value = contribution(rows, [*chosen, best])
            if sign * (value - reached) <= 1e-12:
                break
            chosen.append(best)
            reached = value
            expect.append((direction, len(chosen), best, value))
    got = sorted(map(tuple, discover.greedy(pairs, 10).collect()))
    assert [g[:3] for g in got] == [e[:3] for e in expect] and np.allclose([g[3] for g in got], [e[3] for e in expect])


def test_elbow(spark):
    rows = [("a", k + 1, f"n{k}", v) for k, v in enumerate([0.1, 0.6, 0.7, 0.72, 0.73])] + [("b", 1, "n0", 0.2), ("b", 2, "n1", 0.3)]
    got = sorted(map(tuple, discover.to_elbow(spark.createDataFrame(rows, "direction string, step int, node string, contribution double")).collect()))
    assert [g[:2] for g in got] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_set_permutations_agree_with_relabelling_by_hand(spark):
    import hashlib

    names, rows, pairs = pair_table(spark, 9, 5, 2)
    sets = spark.createDataFrame([("d0", 1, ["d0"]), ("d1,d2", 2, ["d1", "d2"])], "combo_id string, size int, nodes array<string>")
    got = {r["combo_id"]: r for r in discover.permutation_p(pairs, sets, 12, "balanced").collect()}
    null = {"d0": [], "d1,d2": []}
    for perm in range(1, 13):
        seat = {}
        for side in (1, 2):
            order = sorted(names, key=lambda n: (hashlib.md5(f"42|{perm}|{side}|{n}".encode()).hexdigest(), n))
            seat[side] = dict(zip(order, names))
        moved = {}
        for m, approach, i, j, _, _, w1, w2 in rows:
            for side, w in ((1, w1), (2, w2)):
                a, b = sorted((seat[side][i], seat[side][j]))
                moved.setdefault((m, approach, a, b), {})[side] = w
        shuffled = [(*k, min(v.values()), max(v.values())) for k, v in moved.items()]
        for combo in null:
            null[combo].append(contribution(shuffled, combo.split(",")))
    for combo, values in null.items():
        seen = contribution(rows, combo.split(","))
        assert got[combo]["observed"] == pytest.approx(seen)
        assert got[combo]["p"] == pytest.approx((1 + sum(abs(v) >= abs(seen) - 1e-12 for v in values)) / 13)
        assert got[combo]["ci_low"] == pytest.approx(sorted(values)[0]) and got[combo]["ci_high"] == pytest.approx(sorted(values)[11])


def test_tree_tables(spark):
    rows = [("m", "g", "a", "b", 0.9), ("m", "g", "a", "c", 0.8), ("m", "g", "b", "c", 0.1), ("m", "g", "a", "d", 0.7), ("m", "g", "c", "d", 0.2), ("m", "g", "b", "d", 0.3)]
    corr = spark.createDataFrame(rows, "method string, grp string, i string, j string, r double")
    trees = threshold_free.spanning_trees(corr)
    assert {(r["src"], r["dst"]) for r in trees.collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    top = {r["place"]: (r["node"], r["degree"]) for r in threshold_free.tree_central_nodes(trees, 2).collect()}
    assert top == {1: ("a", 3), 2: ("b", 1)}
    row = threshold_free.tree_summary(trees, nodes_of(corr)).first()
    assert (row["n_edges"], row["max_degree"]) == (3, 3) and row["diameter"] == pytest.approx(0.5) and row["total_weight"] == pytest.approx(0.6)


def plain_betweenness(m):
    """Shares of shortest paths by listing them all, for small networks."""
    n = len(m)
    d = np.where(m > 0, m, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])

    def paths(s, t):
        if s == t:
            return [[t]]
        return [[s, *p] for u in range(n) if m[s, u] > 0 and abs(m[s, u] + d[u, t] - d[s, t]) < 1e-9 for p in paths(u, t)]

    node, edge = np.zeros(n), np.zeros((n, n))
    for s, t in itertools.combinations(range(n), 2):
        if np.isfinite(d[s, t]):
            found = paths(s, t)
            for p in found:
                for v in p[1:-1]:
                    node[v] += 1 / len(found)
                for a, b in itertools.pairwise(p):
                    edge[a, b] += 1 / len(found)
                    edge[b, a] += 1 / len(found)
    return node / ((n - 1) * (n - 2) / 2), edge


def test_betweenness(spark):
    """Ties between paths (equal weights), pieces, weights as lengths and hops."""
    rng = np.random.default_rng(12)
    names = [f"n{k}" for k in range(9)]
    rows = [("m", g, a, b, float(rng.choice([0.2, 0.4, 0.6]))) for g, share in (("x", 0.5), ("y", 0.25)) for a, b in itertools.combinations(names, 2) if rng.random() < share]
    edges = spark.createDataFrame(rows, "method string, grp string, src string, dst string, w double")
    nodes = spark.createDataFrame([("m", g, n) for g in "xy" for n in names], "method string, grp string, node string")
    for hops in (False, True):
        per_node, per_edge = spread.betweenness(edges, nodes, hops=hops)
        got, used = {(r["grp"], r["node"]): r["betweenness"] for r in per_node.collect()}, {(r["grp"], r["src"], r["dst"]): r["betweenness"] for r in per_edge.collect()}
        for g in "xy":
            m = matrix(names, rows, g)
            node, edge = plain_betweenness((m > 0) * 1.0 if hops else m)
            assert np.allclose([got[g, n] for n in names], node)
            assert all(np.isclose(used[g, a, b], edge[names.index(a), names.index(b)]) for _, x, a, b, _ in rows if x == g)


def test_partial_correlations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    rows = [("g", k, v.tolist()) for k, v in enumerate(x)] + [("few", 100 + k, v.tolist()) for k, v in enumerate(x[:10])]
    got = {(r["i"], r["j"]): r["r"] for r in correlate.partial(spark.createDataFrame(rows, "grp string, subject long, values array<double>"), list("abcde")).collect() if r["grp"] == "g"}
    inverse = np.linalg.inv(np.corrcoef(x.T))
    scale = np.sqrt(np.diag(inverse))
    for (i, a), (j, b) in itertools.combinations(enumerate("abcde"), 2):
        assert got[a, b] == pytest.approx(-inverse[i, j] / (scale[i] * scale[j]), abs=1e-9)
    assert len(got) == 10


def test_compare_groups(spark):
    values = [(side, f"n{k}", m, float(k * side + (m == "b"))) for side in (1, 2) for k in range(8) for m in "ab"]
    hubs = spark.createDataFrame([(1, "n1"), (1, "n2"), (2, "n2"), (2, "n3")], "side int, node string")
    tests, overlap = permute.compare_groups(spark.createDataFrame(values, "side int, node string, metric string, value double"), hubs, 40)
    got = {r["metric"]: r for r in tests.collect()}
    assert set(got) == {"a", "b"} and got["a"]["difference"] == pytest.approx(-3.5) and 0 <= got["b"]["p"] <= 1
    assert tuple(overlap.first()) == (1, 1, 1, pytest.approx(1 / 3), "n2", "n1", "n3")
    assert permute.compare_groups(spark.createDataFrame(values, "side int, node string, metric string, value double"), hubs.where("false"), 5)[1].first()["jaccard"] is None


def test_results_are_read_back_as_they_were_written(spark, tmp_path):
    from hubweave.operators import exports

    table = spark.createDataFrame([("m", "g 1", 'a,"b', 0.25, 3, True), ("m", "g/2", "", None, -1, False)], "method string, grp string, node string, value double, n int, flag boolean")
    exports.write_results({"t": table}, str(tmp_path), "method", "grp")
    got = exports.read_results(spark, str(tmp_path), table.schema, "t").collect()
    assert sorted((r["grp"], r["value"], r["n"], r["flag"]) for r in got) == [("g 1", 0.25, 3, True), ("g/2", None, -1, False)]
    assert {r["node"] for r in got if r["grp"] == "g 1"} == {'a,"b'}
