"""Odd rows and larger jobs that queries once cut, refused or did otherwise than their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from compare import difference, oracle
from pyspark.sql import functions as F

from spindrift.functions.bins import rounded
from spindrift.operators import glm, joins, pairs, regression, snippets, windows
from spindrift.plans import catalogue
from spindrift.plans import pairs as pair_plans
from spindrift.sources import arrays


@pytest.fixture(scope="module")
def flat_vectors(spark, tmp_path_factory):
    """Vectors whose first two entries are short, or all three."""
    folder = str(tmp_path_factory.mktemp("flat"))
    v = np.random.default_rng(4).normal(size=(12, 64)).astype(np.float32)
    v[3, :2], v[7, :3] = (2e-4, -5e-4), (1e-4, 3e-4, -2e-4)
    rows = [(i, v[i].tolist(), i % 2) for i in range(12)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").toPandas().to_parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["rotations", "derived_tracking"])
def test_short_vectors_have_angles(spark, flat_vectors, name):
    assert difference(catalogue.QUERIES[name](spark, flat_vectors), oracle(flat_vectors), catalogue.ORACLE_SQL[name]) is None


def _rows_of_units(spark, units, frames=720, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(u, int(f), int(rng.integers(1, 3))) for u in range(units) for f in np.sort(rng.choice(frames, 12, replace=False))], "unit bigint, frame bigint, y int")


GRID = pd.DataFrame({"frame": np.arange(720), "a": np.arange(720) % 24 // 8, "b": np.arange(720) // 24 % 7})


def _on_all_frames(spark, rows):
    grid = rows.select("unit").distinct().crossJoin(spark.createDataFrame(GRID))
    return grid.join(rows, ["unit", "frame"], "left").fillna(0, ["y"])


def test_units_are_fitted_in_batches(spark):
    """Batches hold whole units, whatever their number, and their fits reach the optimum of each unit's own fit."""
    rows = _rows_of_units(spark, 600)
    found = {(r.unit, r.family): r for r in glm.fit_units(rows, ["a", "b"], list(glm.FAMILIES), laid=glm.grid_rows(GRID, ["a", "b"])).collect()}
    assert len(found) == 600 * 4 and {r.n for r in found.values()} == {720}
    counted = {(r.unit, r.family): r for r in glm.fit_units(glm.design_rows(_on_all_frames(spark, rows.where("unit < 20")), ["a", "b"]), ["a", "b"], list(glm.FAMILIES)).collect()}
    assert all(abs(found[key].loglik - r.loglik) < 1e-4 for key, r in counted.items()) and len(counted) == 80
    x = glm.one_hot(GRID[["a", "b"]].to_numpy())[0]
    fired = {(r.unit, r.frame): r.y for r in rows.collect()}
    for unit in (0, 255, 256, 599):
        y = np.array([fired.get((unit, f), 0) for f in range(720)], float)
        for family in glm.FAMILIES:
            own, one = (y > 0) * 1.0 if family == "bernoulli" else y, np.ones(720)
            z = glm.standardised(x, one)
            beta = glm.fit(z, own, one, family)
            wanted = glm.log_likelihood(family, own, glm.mean_of(family, beta[0] + z @ beta[1:]), one)
            assert abs(found[unit, family].loglik - wanted) < 0.002, (unit, family, found[unit, family].loglik, wanted)


def test_backward_scores_of_many_units(spark):
    rows = _rows_of_units(spark, 300)
    found = {(r.unit, r.left_out): r for r in glm.backward_scores(rows, ["a", "b"], laid=glm.grid_rows(GRID, ["a", "b"])).collect()}
    counted = glm.backward_scores(glm.design_rows(_on_all_frames(spark, rows), ["a", "b"]), ["a", "b"]).collect()
    assert len(found) == len(counted) == 900
    assert all(abs(found[r.unit, r.left_out].loglik - r.loglik) < 1e-4 and found[r.unit, r.left_out].adjusted_r2 == pytest.approx(r.adjusted_r2, abs=1e-6) for r in counted)


def test_folds_in_tasks_are_those_of_assign_folds(spark):
    rows = _rows_of_units(spark, 40).unionByName(spark.createDataFrame([(40, 900, 1)], "unit bigint, frame bigint, y int"))
    models = [("a",), ("a", "b")]
    found = {(r.unit, r.model, r.fold): r for r in regression.cross_validate(rows, models, ["a", "b"], laid=regression.folded_grid(GRID, ["a", "b"])).collect()}
    counts = regression.design_counts(regression.assign_folds(_on_all_frames(spark, rows)), ["a", "b"])
    wanted = {(r.unit, r.model, r.fold): r for r in regression.cross_validate(counts, models, ["a", "b"]).collect()}
    assert set(found) == set(wanted) and len(found) == 40 * 2 * 10
    assert all((r.n, r.n_spikes) == (wanted[key].n, wanted[key].n_spikes) for key, r in found.items())
    assert max(abs(r.llr - wanted[key].llr) for key, r in found.items()) < 5e-4


def test_held_out_scores_come_from_the_optimum(spark):
    """Accelerated steps that stopped at 1e-10 missed some folds' scores by half a unit of log-likelihood."""
    rng = np.random.default_rng(8)
    n = rng.integers(1, 9, (1, 10, 36)).astype(float)
    dense = np.array([(i // 6, i % 6) for i in range(36)]), n, np.minimum(n, rng.poisson(0.05 + 0.4 * (np.arange(36) % 6 == 2), n.shape))
    found = regression.model_scores(dense, [0, 1])
    for k in range(10):
        train, s = n[0].sum(axis=0) - n[0, k], dense[2][0].sum(axis=0) - dense[2][0, k]
        x = np.repeat(glm.one_hot(dense[0])[0], 2, axis=0)
        y, weight = np.tile([1.0, 0.0], 36), np.column_stack((s, train - s)).ravel()
        spread = np.sqrt(np.maximum(weight @ x**2 / weight.sum() - (weight @ x / weight.sum()) ** 2, 0))
        z = (x - weight @ x / weight.sum()) / spread
        beta = glm.fit(z, y, weight, close=1e-15, steps=20000)
        mu, base = glm.mean_of("bernoulli", beta[0] + z[::2] @ beta[1:]), s.sum() / train.sum()
        held = dense[2][0, k]
        wanted = 2 * (held * np.log(mu / base) + (n[0, k] - held) * np.log((1 - mu) / (1 - base))).sum()
        assert abs(found["llr"][0, k] - wanted) < 5e-4


@pytest.mark.parametrize("stretch, counted, share", [(8, 16, 0.02), (8, 1 << 20, 0.9), (64, 5, 0.2)])
def test_sparse_and_dense_trains_have_the_same_counts(stretch, counted, share, monkeypatch):
    monkeypatch.setattr(pairs, "STRETCH_BINS", stretch)
    monkeypatch.setattr(pairs, "COUNTED", counted)
    rng = np.random.default_rng(3)
    one, two = (rng.random((n, 100)) < share for n in (4, 3))
    sides = [(place[order := np.argsort(at, kind="stable")], at[order]) for place, at in (side.nonzero() for side in (one, two))]
    found = pairs._coincidences(*sides, 4, 3, 5)
    for lag in range(-5, 6):
        wanted = [[sum(one[a, b + lag] and two[c, b] for b in range(100) if 0 <= b + lag < 100) for c in range(3)] for a in range(4)]
        assert (found[:, :, lag + 5] == wanted).all()


def test_blocks_are_bounded_by_entries_too(spark, monkeypatch):
    """Five blocks of few entries instead of one of few units, and names in place of numbers."""
    trains = {f"u{u}": list(range(u % 3, 40, 2 + u)) for u in range(5)}
    bins = spark.createDataFrame([(u, b) for u, t in trains.items() for b in t], "unit string, bin long")
    counts = {(u, v, lag): sum(b + lag in trains[u] for b in trains[v]) for u in trains for v in trains if u < v for lag in range(-2, 3)}
    monkeypatch.setattr(pairs, "BLOCK_ENTRIES", 10)
    assert {(r.unit1, r.unit2, r.lag): r["count"] for r in pairs.correlogram(bins, 2).collect()} == {k: n for k, n in counts.items() if n}


@pytest.mark.parametrize("name", ["cch_counts", "cch_baseline_p", "connection_class", "corr_matrix"])
def test_pairs_are_never_shuffled(spark, sf_dir, name):
    """No counts of pairs, and no copies of units for the blocks that they meet, are dealt out by keys."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_rounding_by_whole_numbers(spark):
    values = [0.1234565, -0.1234565, 0.9999995, -1.0, 1e-9, -1e-9, 0.5, 123456.7891235, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x"), 6).alias("y"), F.round("x", 6).alias("z")).collect()
    assert all(r.y is None if r.x is None else abs(r.y - r.z) < 1.5e-6 and abs(r.y - r.x) < 5.1e-7 and str(r.y) != "-0.0" for r in rows)


def test_keys_of_negative_units_and_blocks_of_units(spark, monkeypatch):
    """Cutting a key apart at its dash lost the sign; pairs come from blocks, which may be smaller than the units."""
    monkeypatch.setattr(joins, "PAIRED", 4)
    units = [-30, -7, 0, 1, 5, 11, 12, 13, 40, 41, 90]
    wanted = [(k, f"{a}-{b}", a, b) for k, (a, b) in enumerate(((a, b) for a in units for b in units if a < b), 1)]
    rows = spark.createDataFrame([(u,) for u in units], "unit bigint")
    assert sorted(map(tuple, pair_plans.keyed_pairs(rows).collect())) == wanted
    assert sorted(map(tuple, pair_plans.keyed_pairs(rows, 9, 33).collect())) == wanted[8:33]


def test_rasters_of_repeated_onsets(spark, monkeypatch):
    """Many stretches of time; onsets at one instant, ids that come again and ids that are missing."""
    monkeypatch.setattr(windows, "STRETCH_ROWS", 3)
    monkeypatch.setattr(windows, "ONSETS_AT_ONCE", 2)
    rng = np.random.default_rng(6)
    events = [*rng.integers(-300, 3000, 80).tolist(), 100, 100, 90, 110, 109, None]
    onsets = [(int(i), int(us)) for i, us in enumerate(rng.integers(0, 2500, 30))] + [(2, 100), (2, 105), (3, 2400), (None, 100), (50, 100), (51, None)]
    found = windows.raster_counts(spark.createDataFrame([(e,) for e in events], "us bigint"), spark.createDataFrame(onsets, "onset_id bigint, us bigint"), 10, 5)
    met = [((e - us) // 10, i) for e in events if e is not None for i, us in onsets if us is not None and us - 50 <= e < us + 50]
    assert sorted(map(tuple, found.collect())) == sorted((k, sum(r == k for r, _ in met), len({i for r, i in met if r == k and i is not None})) for k in {r for r, _ in met})
    assert windows.raster_counts(spark.createDataFrame([], "us bigint"), spark.createDataFrame(onsets, "onset_id bigint, us bigint"), 10, 5).count() == 0


def test_a_raster_makes_no_pairs(spark, sf_dir):
    plan = catalogue.QUERIES["raster_interval_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("sums, pieces", [(8_192, 10_000), (4, 7)])
def test_drawn_means_are_those_of_the_snippets(spark, tmp_path, monkeypatch, sums, pieces):
    """Files and stretches that cut windows, units on several channels, and sums and pieces that don't fit at once."""
    monkeypatch.setattr(snippets, "SUMS", sums)
    monkeypatch.setattr(snippets, "PIECES", pieces)
    monkeypatch.setattr(snippets, "STRETCH", 97)
    rng = np.random.default_rng(9)
    rows = [(s, rng.integers(-900, 900, 6).tolist()) for s in range(700)]
    files = arrays.write_recording(spark.createDataFrame(rows, "sample bigint, values array<int>"), str(tmp_path / "recording"), 150)
    fired = [(0, f"u{int(u)}", int(s), int(c)) for u, s, c in zip(rng.integers(0, 30, 400), rng.integers(0, 700, 400), rng.integers(0, 6, 400), strict=True)]
    fired = list({(r[1], r[2]): r for r in fired}.values()) + [(1, "u1", 100, 0), (0, None, 300, 2)]
    spikes = spark.createDataFrame(fired, "session int, unit string, sample bigint, channel int")
    found, wanted = snippets.drawn_means(spikes, files, 6, picks=8, scale=0.5), snippets.mean_snippets(snippets.snippets(spikes, files, 6, picks=8), 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.count() > 82 * 30
    assert "values" not in found._jdf.queryExecution().executedPlan().toString()
    assert snippets.drawn_means(spikes.limit(0), files, 6).count() == 0
