"""Hand-worked cases of calibration, sensitivity and aggregation; export tables written and read again."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from hubweave.operators import exports, persistence, scoring


def hubs(spark, z):
    """z of each (approach, node); one method."""
    rows = [("g", a, "m", f"n{i}", 0.0, v, v is not None and v >= 1.5) for a, values in z.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "grp string, approach string, method string, node string, value double, z double, is_hub boolean")


def test_calibration_by_hand(spark):
    z = {a: [k + 0.01 * i for i in range(10)] for k, a in ((-1.0, "weighted"), (0.0, "percolation"))}
    z["persistence"] = [2.0 + 0.1 * i for i in range(10)]
    got = {r["tau"]: r for r in scoring.calibrate_threshold(hubs(spark, z), [1.0, 2.35, 2.75, 5.0], "grp").collect()}
    for tau in (1.0, 2.35, 2.75, 5.0):
        over = [v for values in z.values() for v in values if v >= tau]
        n = len(set(over)) / 3
        if n < 2:
            assert got[tau]["score"] == 0 and got[tau]["share"] == 0
            continue
        p = n / 10
        fair = 1 if 0.05 <= p <= 0.15 else math.exp(-10 * abs(p - 0.1))
        modularity = max(0, min(1, 1 - statistics.stdev(over) / statistics.mean(over)))
        clustering = 1 / (1 + max(over) - min(over))
        assert got[tau]["share"] == pytest.approx(p)
        assert got[tau]["score"] == pytest.approx(fair + modularity + clustering + 0.5)
    assert [t for t, r in got.items() if r["best"]] == [max((t for t in got), key=lambda t: (got[t]["score"], -t))]


def test_sensitivity_counts_networks_of_fifteen(spark):
    rows = [("g", a, f"m{k}", n, 0.0, z, False) for a in ("weighted", "percolation", "persistence") for k in range(5) for n, z in (("x", 3.0), ("y", 1.2 if a == "weighted" else -1.0), ("z", 2.0 if a != "persistence" else 0.0))]
    table = spark.createDataFrame(rows, "grp string, approach string, method string, node string, value double, z double, is_hub boolean")
    got = {r["tau"]: r for r in scoring.threshold_sensitivity(table, [1.0, 1.5, 2.5], "grp").collect()}
    # x: 15 of 15 everywhere; z: 10 of 15 up to 2.0, a three-way hub though one approach never calls it; y: 5 of 15 at 1.0
    assert [(got[t]["n_consensus_hubs"], got[t]["n_three_way"]) for t in (1.0, 1.5, 2.5)] == [(2, 2), (2, 2), (1, 1)]
    assert got[1.0]["avg_score"] == pytest.approx((1 + 2 / 3 + 1 / 3) / 3) and got[2.5]["avg_score"] == 1
    assert [got[t]["stable_hubs"] for t in (1.0, 1.5, 2.5)] == [1, 1, 1]
    agree = {round(r["agreement"], 1): (r["n_hubs"], r["avg_confidence"]) for r in scoring.agreement_sensitivity(table, [0.4, 0.7, 1.0], 1.5, "grp").collect()}
    assert agree[0.4] == (2, pytest.approx(5 / 6)) and agree[0.7] == (1, 1.0) and agree[1.0] == (1, 1.0)


def test_aggregated_metrics_keep_small_weights(spark):
    swept = spark.createDataFrame([("m", "g", s, 0.1 * s, n, v) for s, n, v in ((0, "a", 1.0), (1, "a", 3.0), (2, "a", 0.0), (0, "b", 2.0))], "method string, grp string, step int, threshold double, node string, strength double")
    globals_ = spark.createDataFrame([("m", "g", s, 0.1 * s, c, d) for s, c, d in ((0, 0.05, 0.1), (1, 0.5, 0.4), (2, 0.0, 0.3))], "method string, grp string, step int, threshold double, clustering double, density double")
    got = {r["node"]: r for r in persistence.aggregated_metrics(swept, globals_).collect()}
    weights = [0.005, 0.2, 0.01]
    assert got["a"]["mean_strength"] == pytest.approx((0.005 * 1 + 0.2 * 3) / sum(weights))
    assert got["a"]["stability"] == pytest.approx(sum(weights) / 3) and got["a"]["appearance_rate"] == 1
    assert got["b"]["mean_strength"] == 2 and got["b"]["appearance_rate"] == pytest.approx(1 / 3)


def test_results_are_written_and_read_again(spark, tmp_path):
    hub = hubs(spark, {"weighted": [2.0, 1.0, 1.6], "percolation": [0.0, 1.7, None]})
    tables = {"hubs": hub.select("method", "grp", "approach", "node", "z"), "lists": exports.hub_lists(hub, "grp", "approach", "method"), "share": exports.consensus_hubs(hub, "grp").drop("grp")}
    exports.write_results(tables, str(tmp_path), "method", "grp")
    for name, table in tables.items():
        back = spark.read.option("header", True).csv(f"{tmp_path}/{name}")
        assert sorted(back.columns) == sorted(table.columns)
        as_text = table.select([F.col(c).cast("string") for c in table.columns])
        assert sorted(map(str, back.select(table.columns).collect())) == sorted(map(str, as_text.collect()))
    lists = {r["approach"]: (r["n_hubs"], r["hubs"]) for r in tables["lists"].collect()}
    assert lists == {"weighted": (2, "n0,n2"), "percolation": (1, "n1")}


def test_drivers(spark):
    corr = spark.createDataFrame([("pearson", g, i, j, r) for g, r0 in (("g0", 0.3), ("g1", 0.6)) for i, j, r in (("a", "b", r0), ("a", "c", -0.9), ("b", "c", 0.1))], "method string, grp string, i string, j string, r double")
    own = spark.createDataFrame([("pearson", "g0", 0.2)], "method string, grp string, threshold double")
    alone, cut = exports.conservation(corr)["similarity"].first(), exports.conservation(corr, own)["similarity"].first()
    assert (alone["shared"], alone["either"]) == (1, 2) and (cut["shared"], cut["either"]) == (2, 2)
    assert set(exports.threshold_free_analysis(corr, ["a", "b", "c"], "node_strength")) == {"node_strength"}
    assert set(exports.weighted_conservation(corr)) == {"similarity", "hubs", "edge_weights"}
    with pytest.raises(ValueError):
        exports.threshold_free_analysis(corr, ["a"], "other")
    assert spark.range(1).select(exports.safe_filename(F.lit("a b/c.1"))).first()[0] == "a_b_c_1"
