"""Queries that SQL can't say, against independent versions over all their rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from spindrift.operators import glm, maps
from spindrift.plans import events, maps as map_plans, models, pairs

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def spikes(sf_dir):
    return duckdb.sql(f"SELECT user_id, event_type, epoch_us(ts) - 1704067200000000 FROM '{sf_dir}/events.parquet'").fetchall()


@pytest.fixture(scope="module")
def vectors(sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def correlograms(spikes, lags=5, width=600_000_000):
    trains = defaultdict(set)
    for unit, _, us in spikes:
        trains[unit].add(us // width)
    found = {}
    for u, v in combinations(sorted(trains), 2):
        counts = [sum(b + lag in trains[u] for b in trains[v]) for lag in range(-lags, lags + 1)]
        if any(counts):
            found[u, v] = counts
    return found


def baseline(counts, sigma=3.0, hollow=0.6):
    n = len(counts)
    mirrored = counts[::-1] + counts + counts[::-1]
    means = []
    for i in range(n):
        weights = [math.exp(-0.5 * ((j - n - i) / sigma) ** 2) for j in range(3 * n)]
        weights[3 * n // 2] *= 1 - hollow
        means.append(sum(w * c for w, c in zip(weights, mirrored, strict=True)) / sum(weights))
    return means


def tail(count, mean):
    """P(X >= count) less half of P(X = count)."""
    term = lambda k: math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
    return abs(1 - sum(term(k) for k in range(count)) - 0.5 * term(count))


def test_correlograms_with_their_baseline(spark, sf_dir, spikes):
    wanted = {}
    for pair, counts in correlograms(spikes).items():
        for k, (count, mean) in enumerate(zip(counts, baseline(counts), strict=True)):
            wanted[*pair, k - 5] = count, mean, tail(count, mean)
    rows = pairs.cch_baseline_p(spark, sf_dir).collect()
    assert len(rows) == len(wanted) > 500
    for r in rows:
        count, mean, p = wanted[r.unit1, r.unit2, r.lag]
        assert r["count"] == count and abs(r.baseline - mean) < 2e-6
        assert abs(r.p - p) < 2e-6


def test_connections(spark, sf_dir, spikes):
    alpha, wanted = 0.1, {}
    for pair, counts in correlograms(spikes).items():
        means = baseline(counts)
        p = [tail(c, m) for c, m in zip(counts, means, strict=True)]
        sizes = [abs(c - m) for c, m in zip(counts, means, strict=True)]
        at = max(range(11), key=lambda k: (round(sizes[k], 12), -k))
        lag = at - 5
        near = [p[k] for k in (at - 1, at + 1) if 0 <= k < 11]
        up, down = p[at] < alpha and any(x < alpha for x in near), 1 - p[at] < alpha and any(1 - x < alpha for x in near)
        quiet_up, quiet_down = all(p[k] > alpha for k in range(3, 8)), all(1 - p[k] > alpha for k in range(3, 8))
        kind = None
        if 3 <= abs(lag) <= 5 and (up or down):
            kind = "synaptic" if (quiet_up if up else quiet_down) else "common_input"
        elif -3 <= lag < 3 and (up or down):
            kind = "common_input"
        wanted[pair] = lag, sizes[at], kind, up if kind else None, sorted(sizes)[-2]
    rows = pairs.connection_class(spark, sf_dir).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        lag, size, kind, up, second = wanted[r.unit1, r.unit2]
        assert abs(r.size - size) < 2e-6
        if size - second > 1e-9:  # else rounding decides between two peaks
            assert (r.peak_lag, r.kind, r.excitatory) == (lag, kind, up)


def test_components(spark, sf_dir, vectors):
    _, v = vectors
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1]
    rows = sorted(models.pca(spark, sf_dir).collect(), key=lambda r: r.component)
    assert np.allclose([r.share for r in rows], values[:10] / values.sum(), atol=1e-9)
    curve = np.cumsum([r.share for r in rows])
    chord = np.linspace(curve[0], curve[-1], 10)
    assert [r.kept for r in rows] == [k <= int(np.argmax(curve - chord)) for k in range(10)]


def test_clusters_are_settled_and_ranked(spark, sf_dir, vectors):
    ids, v = vectors
    of = {r.id: r.cluster for r in models.kmeans_profile(spark, sf_dir).collect()}
    cluster = np.array([of[i] for i in ids])
    sizes = [int((cluster == k).sum()) for k in range(2)]
    assert sizes[0] >= sizes[1] > 0 and set(of) == set(ids)
    centres = np.array([v[cluster == k].mean(axis=0) for k in range(2)])
    nearest = ((v[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == cluster).mean() > 0.97  # the library stops when the centres move less than its tolerance


def test_thinned_starts(spark, sf_dir, spikes):
    counts = Counter((kind, us // HOUR) for _, kind, us in spikes)
    wanted = set()
    for kind in {k for k, _ in counts}:
        frames = sorted(f for k, f in counts if k == kind and 1 <= counts[k, f] <= 4)
        runs, taken = [], None
        for f in frames:
            if runs and f == runs[-1][-1] + 1:
                runs[-1].append(f)
            else:
                runs.append([f])
        for run in (r for r in runs if len(r) >= 3):
            for f in run[: len(run) - 2]:
                if taken is None or f - taken > 6:
                    wanted.add((kind, f))
                    taken = f
    assert {tuple(r) for r in events.runs_thinned(spark, sf_dir).select("event_type", "start").collect()} == wanted and wanted


def test_adaptive_bounds_are_the_first_that_suffice(spark, sf_dir):
    prices = [p for (p,) in duckdb.sql(f"SELECT o_totalprice FROM '{sf_dir}/orders.parquet'").fetchall()]
    counts = Counter(int(p // 500) for p in prices)
    value = {b: b * 500.0 + 250 for b in counts}
    lo, hi, least = min(counts) * 500.0, max(counts) * 500.0 + 500, len(prices) / 200
    while True:
        width = (hi - lo) / 36
        low = sum(n for b, n in counts.items() if lo < value[b] <= lo + width) >= least
        high = sum(n for b, n in counts.items() if hi - width < value[b] <= hi) >= least
        if low and high:
            break
        lo, hi = lo + 0.05 * width * (not low), hi - 0.05 * width * (not high)
    (row,) = map_plans.adaptive_bounds(spark, sf_dir).collect()
    assert abs(row.lo - lo) < 1e-6 and abs(row.hi - hi) < 1e-6
    assert maps.adaptive_bounds([], 0.0, 1.0, 4, 1.0, steps=5)[0] >= 0


def test_wavelet_power_equals_a_convolution(spark, sf_dir, spikes):
    counts = Counter((kind, us // HOUR) for _, kind, us in spikes)
    wanted = {}
    for kind in sorted({k for k, _ in counts})[:2]:
        x = np.array([counts[kind, f] for f in range(720)], float)
        x -= x.mean()
        for scale in (6.0, 12.0, 24.0):
            t = np.arange(-719, 720)
            daughter = np.pi**-0.25 / np.sqrt(scale) * np.exp(1j * 6 * t / scale) * np.exp(-0.5 * (t / scale) ** 2)
            power = np.abs(np.array([np.sum(x * np.conj(daughter[719 - f : 1439 - f])) for f in range(720)])) ** 2
            for day in range(30):
                wanted[kind, scale, day] = power[24 * day : 24 * day + 24].mean()
    got = {(r.event_type, r.scale, r.day): r.power for r in models.wavelet_power(spark, sf_dir).collect()}
    assert len(got) == len({k for k, _ in counts}) * 3 * 30
    for key, power in wanted.items():
        assert abs(got[key] - power) < 0.02 * power + 0.02, (key, got[key], power)


def test_time_frequency_by_its_definition(spark, sf_dir, spikes):
    counts = Counter((kind, us // HOUR) for _, kind, us in spikes)
    got = {(r.event_type, r.scale, r.day): r for r in models.wavelet_significance(spark, sf_dir).collect()}
    kinds = sorted({k for k, _ in counts})
    assert len(got) == len(kinds) * 90
    t = np.arange(720)
    for kind in kinds[:2]:
        x = np.array([counts[kind, f] for f in range(720)], float)
        # a cubic spline in another basis: third differences jump at the knots only
        u, knots = t / 719, np.arange(120, 719, 120) / 719
        basis = np.column_stack([np.ones(720), u, u**2, u**3] + [np.where(u > k, (u - k) ** 3, 0) for k in knots])
        x = x - basis @ np.linalg.pinv(basis) @ x
        x = (x - x.mean()) / x.std()
        power = []
        for scale in (6.0, 12.0, 24.0):
            s = np.arange(-719, 720)
            daughter = np.pi**-0.25 / np.sqrt(scale) * np.exp(1j * 6 * s / scale) * np.exp(-0.5 * (s / scale) ** 2)
            power.append(np.abs(np.array([np.sum(x * np.conj(daughter[719 - f : 1439 - f])) for f in range(720)])) ** 2)
        alpha = np.sum(x[1:] * x[:-1]) / np.sum(x * x)
        averaged = sum(p / s for p, s in zip(power, (6, 12, 24), strict=True)) / 0.776
        for scale, p in zip((6.0, 12.0, 24.0), power, strict=True):
            frequency = (6 + np.sqrt(38)) / (4 * np.pi * scale)
            level = (1 - alpha**2) / abs(1 - alpha * np.exp(-2j * np.pi * frequency)) ** 2 * 5.991464547107979 / 2
            for day in range(30):
                part = slice(24 * day, 24 * day + 24)
                r = got[kind, scale, day]
                assert abs(r.amplitude - np.sqrt(p[part]).mean()) < 0.02 and abs(r.averaged - averaged[part].mean()) < 0.02 + 0.02 * averaged[part].mean()
                assert (p[part] > 1.02 * level + 0.02).sum() <= r.significant <= (p[part] > 0.98 * level - 0.02).sum()


def hours(spikes):
    """Each unit's response and covariates, hour by hour."""
    units, total = sorted({u for u, _, _ in spikes}), Counter(us // HOUR for _, _, us in spikes)
    fired = Counter((u, us // HOUR) for u, _, us in spikes)
    x = np.array([((f % 24) // 4, min(total[f] // 5, 5), (f // 24) % 7) for f in range(720)])
    return {u: np.array([min(fired[u, f], 4) for f in range(720)]) for u in units}, dict(zip(("hour", "level", "weekday"), x.T, strict=True))


def folds_of(y, folds=10):
    seeds = np.flatnonzero(y)[:folds]
    fold = np.full(len(y), -1)
    fold[seeds] = np.arange(len(seeds))
    for k, part in enumerate(np.array_split(np.flatnonzero(fold < 0), folds * folds)):
        fold[part] = k % folds
    return fold


def dense_fit(columns, y, train, test):
    x = np.concatenate([c[:, None] == np.unique(c) for c in columns], axis=1).astype(float)
    x = x[:, x[train].std(axis=0) > 1e-12]
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    beta = glm.fit(z[train], y[train], np.ones(train.sum()), "bernoulli", 1e-4)
    mu = np.clip(1 / (1 + np.exp(-(beta[0] + z[test] @ beta[1:]))), 1e-10, 1 - 1e-10)
    null = y[train].mean()
    one = (y[test] * np.log(mu) + (1 - y[test]) * np.log(1 - mu)).sum()
    none = (y[test] * np.log(null) + (1 - y[test]) * np.log(1 - null)).sum()
    return 2 * (one - none), one, none, ((mu >= 0.5) == y[test]).mean()


def test_cross_validated_models_of_all_units(spark, sf_dir, spikes):
    responses, x = hours(spikes)
    cv = {(r.unit, r.model, r.fold): r for r in models.glm_cv(spark, sf_dir).collect()}
    left = {(r.unit, r.model): r for r in models.ablation(spark, sf_dir).collect()}
    seen = set()
    for unit, count in responses.items():
        y, fold = (count > 0).astype(float), folds_of(count)
        for model in ("hour", "level", "hour+level", "hour+level+weekday", "level+weekday", "hour+weekday"):
            per_spike = []
            for k in range(10):
                train, test = fold != k, fold == k
                if not 0 < y[train].sum() < train.sum() or not test.any():
                    continue
                llr, _, _, accuracy = dense_fit([x[c] for c in model.split("+")], y, train, test)
                if y[test].sum():
                    per_spike.append(llr / y[test].sum())
                if model in ("hour", "level", "hour+level"):
                    r = cv[unit, model, k]
                    assert (r.n, r.n_spikes) == (test.sum(), y[test].sum()) and abs(r.llr - llr) < 0.02 + 0.002 * abs(llr) and abs(r.accuracy - accuracy) < 0.011
                    seen.add((unit, model, k))
            if (unit, model) in left and per_spike:
                assert abs(left[unit, model].llr_per_spike - np.mean(per_spike)) < 0.005 + 0.002 * abs(np.mean(per_spike))
                seen.add((unit, model))
    assert seen == set(cv) | set(left)


def test_selection_of_all_units_follows_from_its_scores(spark, sf_dir, spikes):
    responses, x = hours(spikes)
    rows = defaultdict(list)
    for r in models.forward_selection(spark, sf_dir).collect():
        rows[r.unit].append(r)
    assert set(rows) == set(responses)
    for unit, tried in rows.items():
        y, fold = (responses[unit] > 0).astype(float), folds_of(responses[unit])
        best, before = (), 0.0
        for layer in range(1, max(r.layer for r in tried) + 1):
            now = [r for r in tried if r.layer == layer]
            assert {r.model for r in now} == {"+".join(sorted((*best, f))) for f in x if f not in best}
            for r in now:
                per_spike = [dense_fit([x[c] for c in r.model.split("+")], y, fold != k, fold == k)[0] / y[fold == k].sum() for k in range(10) if y[fold == k].sum() and 0 < y[fold != k].sum()]
                assert (r.mean_score is None and not per_spike) or abs(r.mean_score - np.mean(per_spike)) < 0.005 + 0.002 * abs(np.mean(per_spike))
            good = [r for r in now if r.p < 0.01 and r.mean_score is not None and r.mean_score > before]
            chosen = [r for r in now if r.chosen]
            assert len(chosen) == bool(good) and (not good or chosen[0].mean_score == max(r.mean_score for r in good))
            if chosen:
                best, before = tuple(chosen[0].model.split("+")), chosen[0].mean_score


@pytest.mark.parametrize("family", glm.FAMILIES)
@pytest.mark.parametrize("alpha, grouped, tikhonov", [(1.0, False, False), (0.5, False, True), (0.7, True, False), (0.0, False, False)])
def test_fits_meet_the_optimum_conditions(family, alpha, grouped, tikhonov):
    """At the minimum the slope of the smooth part balances a subgradient of the penalty, coefficient by coefficient."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 5))
    eta = 0.3 + x @ [0.8, 0, 0, -0.5, 0]
    y = {"bernoulli": lambda: (rng.random(150) < 1 / (1 + np.exp(-eta))) * 1.0, "poisson": lambda: rng.poisson(np.exp(eta)) * 1.0, "gaussian": lambda: eta + rng.normal(size=150), "neg-binomial": lambda: rng.poisson(np.logaddexp(0, eta) * rng.gamma(1, 1, 150)) * 1.0}[family]()
    weight, lam = rng.integers(1, 4, 150).astype(float), 0.05
    groups, tau = np.array([0, 1, 1, 2, 2, 0]) if grouped else None, np.diag([0, 1, 2, 1, 1, 3.0]) if tikhonov else None
    beta = glm.fit(x, y, weight, family, lam, alpha, groups, tau)
    a = np.column_stack((np.ones(150), x))
    square = np.eye(6) if tau is None else tau.T @ tau

    def smooth(b):
        return -glm.log_likelihood(family, y, glm.mean_of(family, a @ b), weight) / weight.sum() + 0.5 * lam * (1 - alpha) * b @ square @ b

    slope = np.array([(smooth(beta + d) - smooth(beta - d)) / 2e-5 for d in 1e-5 * np.eye(6)])
    for g in [None] if groups is None else np.unique(groups):
        if g:
            at = groups == g
            size = np.linalg.norm(beta[at])
            assert np.linalg.norm(slope[at]) <= lam * alpha + 1e-4 if size < 1e-9 else np.allclose(slope[at], -lam * alpha * beta[at] / size, atol=2e-4)
            continue
        for s, b in zip(slope if groups is None else slope[groups == 0], beta if groups is None else beta[groups == 0], strict=True):
            assert abs(s) <= lam * alpha + 1e-4 if abs(b) < 1e-9 else abs(s + lam * alpha * np.sign(b)) < 2e-4
    assert abs(glm.penalty(beta, lam, alpha, groups, tau) - lam * (alpha * (np.abs(beta).sum() if groups is None else abs(beta[0]) + abs(beta[5]) + np.linalg.norm(beta[1:3]) + np.linalg.norm(beta[3:5])) + 0.5 * (1 - alpha) * beta @ square @ beta)) < 1e-12


def test_families_of_all_units(spark, sf_dir, spikes):
    responses, x = hours(spikes)
    rows = {(r.unit, r.family): r for r in models.glm_families(spark, sf_dir).collect()}
    assert set(rows) == {(u, f) for u in responses for f in glm.FAMILIES}
    z = np.concatenate([c[:, None] == np.unique(c) for c in (x["hour"], x["weekday"])], axis=1).astype(float)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    for (unit, family), r in rows.items():
        y = (responses[unit] > 0) * 1.0 if family == "bernoulli" else responses[unit] * 1.0
        beta = glm.fit(z, y, np.ones(720), family)
        assert abs(r.loglik - glm.log_likelihood(family, y, glm.mean_of(family, beta[0] + z @ beta[1:]), np.ones(720))) < 0.02
        assert abs(r.null_loglik - glm.log_likelihood(family, y, np.full(720, y.mean()), np.ones(720))) < 1e-3 and r.n == 720


def test_backward_scores_by_their_definitions(spark, sf_dir, spikes):
    responses, x = hours(spikes)
    rows = {(r.unit, r.left_out): r for r in models.backward_scores(spark, sf_dir).collect()}
    assert set(rows) == {(u, f) for u in responses for f in (None, "hour", "level", "weekday")}
    for unit, count in responses.items():
        y = (count > 0) * 1.0
        for left_out in (None, "hour", "level", "weekday"):
            z = np.concatenate([c[:, None] == np.unique(c) for name, c in x.items() if name != left_out], axis=1).astype(float)
            z = z[:, z.std(axis=0) > 0]
            z = (z - z.mean(axis=0)) / z.std(axis=0)
            beta = glm.fit(z, y, np.ones(720), "bernoulli")
            mu, n, null = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:]))), 720, y.mean()
            one, none = (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum(), (y * np.log(null) + (1 - y) * np.log(1 - null)).sum()
            r, r2 = rows[unit, left_out], 1 - one / none
            at = np.linspace(0, 1, 100)
            tpr, fpr = (np.array([(mu[y == k] >= t).mean() for t in at]) for k in (1, 0))
            cox = 1 - np.exp(-2 / n * (one - none))
            wanted = {
                "loglik": one, "cox_snell": cox, "nagelkerke": cox / (1 - np.exp(2 * none / n)), "nagelkerke_ref": cox / (1 - np.exp(none / (2 * n))), "pearson2": np.corrcoef(y, mu)[0, 1] ** 2, "adjusted_r2": 1 - (n - 1) / (n - z.shape[1]) * (1 - r2),
                "tjur": mu[y == 1].mean() - mu[y == 0].mean(), "accuracy": ((mu > 0.5) == y).mean(), "pseudo_r2": r2, "llr": 2 * (one - none),
            }
            for name, value in wanted.items():
                assert abs(r[name] - value) < 2e-3 + 2e-3 * abs(value), (unit, left_out, name, r[name], value)
            assert abs(r.auc - np.sum((tpr[:-1] + tpr[1:]) / 2 * (fpr[:-1] - fpr[1:]))) < 0.02


def test_watershed_labels_follow_the_steepest_ascent(spark, sf_dir, vectors):
    """Every occupied cell has a label, and a cell whose label differs from all its neighbours' would be a basin of its own."""
    _, v = vectors
    rows = {(r.gx, r.gy): r.label for r in models.watershed_labels(spark, sf_dir).collect()}
    x, y = v[:, 0], v[:, 1]
    cell = lambda c: np.minimum(np.floor((c - (c.min() - 0.05 * np.ptp(c))) * 60 / (np.ptp(c) * 1.1)), 59).astype(int)
    assert set(rows) == set(zip(cell(x).tolist(), cell(y).tolist(), strict=True))
    assert all(label > 0 for label in rows.values())
    image = np.zeros((60, 60))
    np.add.at(image, (cell(x), cell(y)), 1)
    radius = 8
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 2.0) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(image, radius, mode="symmetric")
    smooth = np.apply_along_axis(lambda c: np.convolve(c, kernel, "valid"), 0, np.apply_along_axis(lambda c: np.convolve(c, kernel, "valid"), 1, padded))
    tops = {}
    for cell_of, label in rows.items():
        i, j = cell_of
        while True:  # climb to a maximum
            near = [(smooth[a, b], a, b) for a in range(max(0, i - 1), min(60, i + 2)) for b in range(max(0, j - 1), min(60, j + 2))]
            top = max(near)
            if top[0] <= smooth[i, j]:
                break
            _, i, j = top
        tops.setdefault((i, j), Counter())[label] += 1
    # cells that climb to one maximum have one label, but for those on the ridges between basins
    same = sum(c.most_common(1)[0][1] for c in tops.values())
    assert same >= 0.9 * len(rows)
