"""The penalty path against conditions that only the optimum meets, and its cross-validation against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubweave.operators import discover, penalised


def _rows(spark, n=90, p=8, seed=3, slices=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 4
    side = np.where(x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=n) > 3, 2, 1)
    values = [[float(v) if rng.random() > 0.02 else None for v in row] for row in x]
    frame = spark.createDataFrame([(int(s), v) for s, v in zip(side, values, strict=True)], "side int, values array<double>")
    return frame.repartition(slices), [f"n{k}" for k in range(p)]


def _held(data):
    rows = data.collect()
    return np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows]), np.array([r["x"] for r in rows])


@pytest.mark.parametrize("alpha", [1.0, 0.5])
def test_every_model_of_the_path_is_optimal(spark, alpha):
    rows, nodes = _rows(spark)
    data, fitted = discover.lasso_fit(rows, nodes, alpha, folds=4)
    y, fold, x = _held(data)
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0, ddof=1), 1)
    assert fitted.penalties[-1] == pytest.approx(fitted.penalties[0] * 1e-4)
    for f in range(-1, 4):
        own = fold != f
        sd = x[own].std(0)
        for k, penalty in enumerate(fitted.penalties):
            b = fitted.coefficients[f + 1, k]
            gap = y[own] - 1 / (1 + np.exp(-(b[0] + x[own] @ b[1:])))
            slope = x[own].T @ gap / own.sum() - (1 - alpha) * penalty * sd**2 * b[1:]
            assert abs(gap.mean()) < 1e-6
            bound = alpha * penalty * sd
            assert (np.abs(slope) <= bound + 1e-6).all()
            on = b[1:] != 0
            assert np.allclose(slope[on], bound[on] * np.sign(b[1:][on]), atol=1e-6)
    assert (fitted.coefficients[0, 0, 1:] == 0).all() and (fitted.coefficients[0, 3, 1:] != 0).any()


def test_choice_of_the_penalty(spark):
    rows, nodes = _rows(spark)
    data, fitted = discover.lasso_fit(rows, nodes, folds=4)
    y, fold, x = _held(data)
    means, sizes = [], []
    for f in range(4):
        own = fold == f
        chance = 1 / (1 + np.exp(-(fitted.coefficients[f + 1, :, 0] + x[own] @ fitted.coefficients[f + 1, :, 1:].T)))
        right = np.clip(np.where(y[own, None] == 1, chance, 1 - chance), 1e-5, 1 - 1e-5)
        means.append(-2 * np.log(right).mean(0))
        sizes.append(own.sum())
    deviance = np.average(means, axis=0, weights=sizes)
    error = np.sqrt(np.average((means - deviance) ** 2, axis=0, weights=sizes) / 3)
    assert np.allclose(fitted.deviance, deviance) and np.allclose(fitted.error, error)
    table = {r["step"]: r for r in fitted.table(spark).collect()}
    least, within = fitted.step("min"), fitted.step("1se")
    assert table[least]["is_min"] and table[within]["is_1se"] and within <= least
    assert all(table[k]["deviance"] > table[least]["deviance"] + table[least]["error"] for k in range(within))
    with pytest.raises(ValueError):
        fitted.step("best")
    chosen = {r["node"]: r for r in discover.lasso(rows, nodes, fitted=fitted, choice="1se").collect()}
    assert chosen["n0"]["selected"] and chosen["n0"]["direction"] == "higher in 2" and chosen["n0"]["difference"] > 0
    assert {r["selected"] for r in chosen.values()} <= {True, False} and len(chosen) == 8
    counts = {(r["actual"], r["predicted"]): r["n"] for r in penalised.confusion(data, fitted.coefficients[0, least]).collect()}
    plain = (fitted.coefficients[0, least, 0] + x @ fitted.coefficients[0, least, 1:] > 0).astype(int)
    assert counts == {(a, b): n for a in (0, 1) for b in (0, 1) if (n := int(((y == a) & (plain == b)).sum()))}


def test_stretches_and_partitions_do_not_change_the_path(spark, monkeypatch):
    rows, nodes = _rows(spark, n=40, p=4)
    whole = discover.lasso_fit(rows, nodes, folds=3)[1]
    monkeypatch.setattr(penalised, "CELLS", 40 * 25 * 4)
    cut = discover.lasso_fit(rows.repartition(2), nodes, folds=3)[1]
    assert np.allclose(whole.coefficients[:, :40], cut.coefficients[:, :40], atol=1e-4)
    assert np.allclose(whole.deviance[:60], cut.deviance[:60], rtol=1e-3)


def test_odd_tables(spark):
    rows, nodes = _rows(spark, n=30, p=3)
    wide = rows.withColumn("values", F.concat("values", F.array(F.lit(None).cast("double"), F.lit(7.0))))
    fitted = discover.lasso_fit(wide, [*nodes, "void", "same"], folds=3)[1]
    assert fitted.nodes == [*nodes, "same"] and (fitted.coefficients[:, :, 4] == 0).all()
    flat = rows.withColumn("values", F.array(F.lit(1.0), F.lit(2.0)))
    nothing = discover.lasso_fit(flat, nodes[:2], folds=3)[1]
    assert (nothing.penalties == 0).all() and (nothing.coefficients[:, :, 1:] == 0).all()
    with pytest.raises(ValueError):
        discover.lasso_fit(rows.where("side = 1"), nodes)
    with pytest.raises(ValueError):
        discover.lasso_fit(rows.limit(0), nodes)
    with pytest.raises(ValueError):
        discover.lasso_fit(rows.withColumn("values", F.slice("values", 1, 1)), nodes[:1])
