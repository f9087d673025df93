"""Donors of imputation and the decomposition of PCA."""

import numpy as np
import pytest

from hubweave.operators import impute, kernels


@pytest.mark.parametrize("digits", [0, 1, 12])
def test_nearest_donors_equal_those_of_a_full_sort(digits):
    rng = np.random.default_rng(digits)
    for n in (1, 3, 5, 40, 400):
        known, wanted = np.round(rng.normal(size=n) * 3, digits), np.round(rng.normal(size=60) * 4, digits)
        found = impute.nearest(known, wanted, 5)
        assert [list(f) for f in found] == [list(np.argsort(np.abs(known - w), kind="stable")[:5]) for w in wanted]


def test_pca_goes_on_where_the_iteration_fails(monkeypatch):
    x = np.corrcoef(np.random.default_rng(1).normal(size=(8, 30)))
    x = x - x.mean(0)
    u, s, vt = np.linalg.svd(x)

    def fail(*a, **k):
        raise np.linalg.LinAlgError("SVD did not converge")

    monkeypatch.setattr(np.linalg, "svd", fail)
    u2, s2, vt2 = kernels.singular(x)
    assert s2 == pytest.approx(s, abs=1e-7)
    assert np.abs((vt * vt2).sum(1))[:-1] == pytest.approx(np.ones(7), abs=1e-6)
    assert (u2 * s2) @ vt2 == pytest.approx(x, abs=1e-9)


def test_pca_takes_correlations_that_are_no_number_as_none(spark):
    inf = float("inf")
    rows = [("m", "g", "a", "b", inf), ("m", "g", "a", "c", float("nan")), ("m", "g", "b", "c", 0.5)]
    corr = spark.createDataFrame(rows, "method string, grp string, i string, j string, r double")
    zeros = spark.createDataFrame([("m", "g", "a", "b", 0.0), ("m", "g", "a", "c", None), ("m", "g", "b", "c", 0.5)], corr.schema)
    assert sorted(kernels.pca(corr, ["a", "b", "c"]).collect()) == sorted(kernels.pca(zeros, ["a", "b", "c"]).collect())
