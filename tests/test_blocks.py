"""Operators that compare all with all in blocks, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import decoding, joins, pairs, resampling
from spindrift.plans import pairs as pair_plans


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_all_pairs_of_few_and_many_units(spark, n):
    units = spark.createDataFrame([(3 * i,) for i in range(n)], "unit long")
    wanted = [(3 * i, 3 * j) for i in range(n) for j in range(i + 1, n)]
    for first, last in ((1, None), (1, 1), (3, 7), (100, 105)):
        got = sorted(joins.numbered_pairs(units, "unit", first, last).collect(), key=lambda r: r.nth)
        assert [(r.unit1, r.unit2) for r in got] == wanted[first - 1 : last] and [r.nth for r in got] == list(range(first, first + len(got)))


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id * 7 AS k", "id")
    assert all(r.i == r.id and r.n == 5000 for r in joins.numbered_rows(rows, "k", 7).collect())


@pytest.mark.parametrize("lags", [0, 3, 9])
def test_correlograms_over_blocks_and_stretches(spark, monkeypatch, lags):
    monkeypatch.setattr(pairs, "BLOCK_UNITS", 3)
    monkeypatch.setattr(pairs, "STRETCH_BINS", 7)
    rng = np.random.default_rng(lags)
    trains = {u: sorted(set(rng.integers(0, 60, 15).tolist())) for u in range(10, 20)}
    wanted = {}
    for u, a in trains.items():
        for v, b in trains.items():
            for x in a if u < v else ():
                for y in b:
                    if abs(x - y) <= lags:
                        wanted[u, v, x - y] = wanted.get((u, v, x - y), 0) + 1
    bins = spark.createDataFrame([(u, b) for u, t in trains.items() for b in t], "unit long, bin long")
    assert {(r.unit1, r.unit2, r.lag): r["count"] for r in pairs.correlogram(bins, lags).collect()} == wanted
    assert pairs.correlogram(bins.limit(0), lags).count() == 0


def test_correlations_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_UNITS", 3)
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 4, (9, 6))
    dense[4] = 2
    counts = spark.createDataFrame([(u, b, int(dense[u, b])) for u in range(9) for b in range(6) if dense[u, b]], "unit long, bin long, n long")
    units = spark.range(9).withColumnRenamed("id", "unit")
    got = {(r.unit1, r.unit2): r.r for r in pairs.correlation_matrix(counts, units, 6).collect()}
    assert set(got) == {(i, j) for i in range(9) for j in range(i + 1, 9)}
    for (i, j), r in got.items():
        assert r is None if 4 in (i, j) else abs(r - np.corrcoef(dense[i], dense[j])[0, 1]) < 1e-12


@pytest.mark.parametrize("measure", ["pearson", "euclid"])
def test_nearest_over_blocks(spark, monkeypatch, measure):
    monkeypatch.setattr(decoding, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 4))
    v[7], v[3] = v[9], 1.0
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, label int")
    got = {r.id: (r.nearest, r.label) for r in decoding.nearest(rows.where("id < 28"), rows.where("id >= 28"), measure).collect()}
    for i in range(28, 40):
        with np.errstate(invalid="ignore"):
            scores = [np.linalg.norm(v[i] - x) if measure == "euclid" else -np.nan_to_num(np.corrcoef(v[i], x)[0, 1], nan=-1.0) for x in v[:28]]
        assert got[i] == (int(np.argmin(scores)), int(np.argmin(scores)) % 3)
    assert decoding.nearest(rows.limit(0), rows, measure).count() == decoding.nearest(rows, rows.limit(0), measure).count() == 0


def test_a_permutation_test_takes_any_number_of_shuffles(spark, sf_dir):
    few, many = (pair_plans.permutation_swap(spark, sf_dir, n).collect() for n in (40, 1000))
    assert {r.c_mktsegment: r.true_diff for r in few} == {r.c_mktsegment: r.true_diff for r in many} and len(many) > 0


@pytest.mark.parametrize("n, quotas", [(40, {"near": 4, "far": 6}), (6, {"near": 5, "far": 10}), (5, {"near": 50, "far": 50}), (1, {"near": 1}), (0, {"near": 1})])
def test_drawn_pairs_fill_their_quotas(spark, n, quotas):
    units = spark.createDataFrame([(10 * i, i) for i in range(n)], "unit long, at int")
    kind = lambda one, two: F.when(F.abs(F.col(f"{one}at") - F.col(f"{two}at")) <= 1, "near").otherwise("far")
    rows = resampling.drawn_pairs(units, "unit", kind, quotas, 3).collect()
    assert len({tuple(r) for r in rows}) == len(rows) and all(r.a < r.b and r.kind == ("near" if r.b - r.a <= 10 else "far") for r in rows)
    there = {"near": max(n - 1, 0), "far": n * (n - 1) // 2 - max(n - 1, 0)}
    for shuffle in range(3):
        assert {k: sum(r.kind == k and r.shuffle_id == shuffle for r in rows) for k in quotas} == {k: min(q, there[k]) for k, q in quotas.items()}
    assert n < 40 or len({tuple(sorted((r.a, r.b) for r in rows if r.shuffle_id == s)) for s in range(3)}) == 3
