"""Ranks, medians and moments of whole columns against the same by rows of single values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubweave.operators import correlate, impute
from hubweave.sources.observations import to_long, to_vectors

NODES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(g, k, [float(x) for x in np.round(rng.normal(size=3), 1)]) for g, n in (("g0", 40), ("g1", 7), ("g2", 2), ("g3", 5)) for k in range(n)]
    data[3] = ("g0", 3, [None, 1.0, 2.0])
    data += [("g4", 0, [float("nan"), 1.0, 0.0]), ("g4", 1, [float("nan"), 2.0, -0.0]), ("g4", 2, [1.0, float("inf"), 3.0]), ("g4", 3, [2.0, float("-inf"), 5.0])]
    data += [("g5", k, [1.0, float(k), float(k % 2)]) for k in range(6)]
    return spark.createDataFrame(data, "grp string, subject long, values array<double>").repartition(5)


def ended(df):
    """Rows as text, so that NaN equals itself."""
    return sorted(map(str, df.collect()))


def test_ranks_follow_the_window(rows, monkeypatch):
    monkeypatch.setattr(correlate, "CELL_ROWS", 4)
    old = correlate.pair_sums(to_vectors(impute.rank_in_group(to_long(impute.complete_cases(rows), NODES)), NODES), NODES)
    assert ended(correlate.spearman(rows, NODES)) == ended(correlate._named("spearman", old.withColumn("r", correlate.pair_corr())))


def test_medians_follow_spark(rows):
    whole = impute.complete_cases(rows)
    long = to_long(whole, NODES)
    med = long.groupBy("grp", "node").agg(F.median("value").alias("med"))
    old = long.join(med, ["grp", "node"]).groupBy("grp", "node").agg((F.first("med") + F.lit(0.0)).alias("med"), F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    found = correlate.node_columns(whole, NODES).groupBy("grp", "node").applyInArrow(correlate._medians, "grp string, node int, med double, mad double")
    names = F.array(*[F.lit(n) for n in NODES])
    assert ended(found.select("grp", F.get(names, F.col("node")).alias("node"), (F.col("med") + F.lit(0.0)).alias("med"), "mad")) == ended(old)


def test_moments_follow_spark(rows):
    per = to_long(rows, NODES).where("value is not null and not isnan(value) and abs(value) < double('inf')").groupBy("grp", "node").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    old = {(r["grp"], r["node"]): r for r in per.collect()}
    bad = {r["grp"]: r["admissible"] for r in impute.shrinkage_admissible(to_long(rows, NODES)).collect()}
    found = correlate.node_moments(rows, NODES).collect()
    assert {r["grp"] for r in found} == {f"g{k}" for k in range(6)}
    for r in found:
        for node, mean, variance in zip(NODES, r["mean"], r["variance"], strict=True):
            assert mean == pytest.approx(old[r["grp"], node]["mean"], abs=1e-12)
            assert variance == (None if old[r["grp"], node]["variance"] is None else pytest.approx(old[r["grp"], node]["variance"], abs=1e-12))
    used = {r["grp"] for r in correlate.shrinkage_pairs(rows, NODES).select("grp").distinct().collect()}
    assert used == {g for g, fit in bad.items() if fit}


@pytest.mark.parametrize("method", ["spearman", "bicor", "shrinkage"])
def test_no_value_becomes_a_row(rows, method):
    plan = getattr(correlate, method)(rows, NODES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
