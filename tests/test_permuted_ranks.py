"""Spearman correlations of reshuffled sides against ranks of each side on its own."""

import numpy as np
import pytest

from hubweave.operators import permute

NODES = ["a", "b", "c"]


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("digits", [0, 6])
def test_permuted_ranks_in_runs_and_blocks(spark, monkeypatch, digits):
    monkeypatch.setattr(permute, "RANK_RUN", 7)
    monkeypatch.setattr(permute, "RANK_BLOCK", 16)
    x = np.round(np.random.default_rng(2).normal(size=(90, 3)), digits) + 0.0
    rows = [(k, 1 + (k > 39), [float(v) for v in row]) for k, row in enumerate(x)] + [(99, 1, [None, 1.0, 2.0])]
    table = spark.createDataFrame(rows, "subject long, side int, values array<double>").repartition(3)
    df = permute.permuted_correlations(table, NODES, "spearman", 4, 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no permutation is sorted
    side = {(r.perm, r.subject): r.side for r in permute.permutations(table.select("subject", "side"), 4, 7).collect()}
    found = {(r.perm, r.side, r.i, r.j): r.r for r in df.collect()}
    assert len(found) == 5 * 2 * 3
    for (perm, s, i, j), r in found.items():
        own = x[[k for k in range(90) if side[perm, k] == s]]
        assert r == pytest.approx(np.corrcoef(ranks(own[:, NODES.index(i)]), ranks(own[:, NODES.index(j)]))[0, 1], abs=1e-11)


def test_a_metric_the_observed_networks_lack_has_no_permutations(spark, monkeypatch):
    # side 1 has no edges as observed: it has no modularity, though reshuffled sides have
    table = spark.createDataFrame([(k, 1 + (k > 3), [1.0]) for k in range(8)], "subject long, side int, values array<double>")
    rows = [(perm, side, 0.5, 0.5, 1.0, None if (perm, side) == (0, 1) else 0.1 * perm) for perm in range(4) for side in (1, 2)]
    nets = spark.createDataFrame(rows, "perm int, side int, density double, clustering double, path_length double, modularity double")
    monkeypatch.setattr(permute, "global_networks", lambda *a, **k: nets)
    found = {r.metric: (r.p, r.n_null) for r in permute.global_test(table, ["a"], count=3).collect()}
    assert found["modularity"] == (None, 0) and found["density"] == (1.0, 3)
