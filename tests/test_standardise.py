"""Blocks of covariates against numpy's decomposition of the whole matrix."""

from __future__ import annotations

import numpy as np
import pytest

from spindrift.operators import standardise

GROUPS = [2, 0, 1, 2, 1, 0, 2]


@pytest.fixture(scope="module")
def matrix():
    x = np.random.default_rng(13).normal(size=(500, 7)) @ np.random.default_rng(14).normal(size=(7, 7)) + 1e4
    x[200:370] = x[200]  # a third of the rows alike
    return x


def plain(x):
    x = x - x.mean(axis=0)
    z = np.empty_like(x)
    for g in set(GROUPS):
        own = [i for i, k in enumerate(GROUPS) if k == g]
        if g == 0:
            z[:, own] = x[:, own] / np.sqrt((x[:, own] ** 2).mean(axis=0))
        else:
            q, r = np.linalg.qr(x[:, own])
            z[:, own] = q * np.sign(np.diag(r)) * np.sqrt(len(x))
    return z


@pytest.mark.parametrize("parts, fan", [(1, 32), (40, 3)])
def test_blocks_equal_one_decomposition(spark, matrix, monkeypatch, parts, fan):
    monkeypatch.setattr(standardise, "FAN_IN", fan)
    rows = [(i, [float(v) for v in x], "k") for i, x in enumerate(matrix)]
    odd = [(-1, None, "k"), (-2, [None] * 7, "k"), (-3, [float("nan")] * 7, "k"), (None, rows[5][1], None)]
    df = spark.createDataFrame(rows[:-1] + odd[:3] + [(499, rows[-1][1], None)], "id int, x array<double>, part string").repartition(parts)
    found, standard = standardise.standardised_blocks(df, "x", GROUPS)
    got = {r.id: r.z for r in found.collect()}
    assert found.columns == ["id", "x", "part", "z"] and standard.n == 500
    assert [got[i] for i in (-1, -2, -3)] == [None] * 3
    z = np.array([got[i] for i in range(500)])
    assert np.allclose(z, plain(matrix), atol=1e-8)
    beta = np.arange(1.0, 8.0)
    intercept, back = standard.original(3.0, beta)
    assert np.allclose(intercept + matrix @ back, 3.0 + z @ beta, atol=1e-6)


def test_what_cannot_be_standardised(spark, matrix):
    same = [([float(v) for v in x[:6]] + [float(x[0] + 2 * x[3])],) for x in matrix]
    with pytest.raises(ValueError, match="block 2 has not full rank"):
        standardise.standardised_blocks(spark.createDataFrame(same, "x array<double>"), "x", GROUPS)
    with pytest.raises(ValueError, match="entries"):
        standardise.standardised_blocks(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), "x", [1, 1])
    found, standard = standardise.standardised_blocks(spark.createDataFrame([], "x array<double>"), "x", [1, 1])
    assert found.count() == 0 and standard.n == 0
