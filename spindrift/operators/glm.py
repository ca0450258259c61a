"""Generalised linear models with penalties, fitted by proximal gradient on weighted rows.

Families: ``bernoulli`` (logit), ``poisson`` (exponential up to ``KAPPA``, linear beyond),
``gaussian`` (identity) and ``neg-binomial`` (softplus). The penalty is ``lam`` times
``alpha * |beta|_1 + (1 - alpha) / 2 * |tau beta|_2^2``; groups make the first part a sum of
their Euclidean norms (group 0 stays a lasso). The intercept is penalised like the others.
Rows are weighted, so that frames with equal covariates and responses count as one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.batches import unit_batches

KAPPA, THETA, LAM, ALPHA = 2.0, 1.0, 1e-4, 1.0
FAMILIES = ("bernoulli", "poisson", "gaussian", "neg-binomial")


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * eta))


def mean_of(family: str, eta: np.ndarray) -> np.ndarray:
    """Expected response at a linear predictor."""
    if family == "bernoulli":
        return _sigmoid(eta)
    if family == "gaussian":
        return eta
    if family == "neg-binomial":
        return np.logaddexp(0, eta)
    return np.where(eta > KAPPA, math.exp(KAPPA) * (1 + eta - KAPPA), np.exp(np.minimum(eta, KAPPA)))


def slope_of(family: str, eta: np.ndarray) -> np.ndarray:
    """Derivative of ``mean_of``."""
    if family == "bernoulli":
        return _sigmoid(eta) * _sigmoid(-eta)
    if family == "gaussian":
        return np.ones_like(eta)
    return _sigmoid(eta) if family == "neg-binomial" else np.exp(np.minimum(eta, KAPPA))


def log_likelihood(family: str, y: np.ndarray, mu: np.ndarray, weight: np.ndarray, theta: float = THETA) -> float:
    if family == "bernoulli":
        mu = np.clip(mu, 1e-10, 1 - 1e-10)
        terms = y * np.log(mu) + (1 - y) * np.log(1 - mu)
    elif family == "gaussian":
        terms = -0.5 * (y - mu) ** 2
    elif family == "poisson":
        terms = y * np.log(mu + np.spacing(1)) - mu
    else:
        levels, place = np.unique(y, return_inverse=True)  # responses are few
        gamma = np.array([math.lgamma(v + theta) - math.lgamma(v + 1) for v in levels])[place.reshape(y.shape)]
        terms = gamma - math.lgamma(theta) + theta * math.log(theta) + y * np.log(mu) - (theta + y) * np.log(mu + theta)
    return float((weight * terms).sum())


def _pull(family: str, y: np.ndarray, eta: np.ndarray, theta: float) -> np.ndarray:
    """Derivative of each row's negative log-likelihood by its linear predictor."""
    mu = mean_of(family, eta)
    if family in ("bernoulli", "gaussian"):
        return mu - y
    if family == "poisson":
        return slope_of(family, eta) * (1 - y / (mu + np.spacing(1)))
    return slope_of(family, eta) * ((y + theta) / (mu + theta) - y / mu)


def _shrunk(beta: np.ndarray, by: float, groups: np.ndarray | None) -> np.ndarray:
    soft = np.sign(beta) * np.maximum(np.abs(beta) - by, 0)
    if groups is None:
        return soft
    for g in np.unique(groups[groups != 0]):
        at = groups == g
        size = np.linalg.norm(beta[at])
        soft[at] = beta[at] * max(0.0, 1 - by / size) if size else 0.0
    return soft


def penalty(beta: np.ndarray, lam: float = LAM, alpha: float = ALPHA, groups: np.ndarray | None = None, tau: np.ndarray | None = None) -> float:
    one = np.abs(beta[groups == 0]).sum() + sum(np.linalg.norm(beta[groups == g]) for g in np.unique(groups[groups != 0])) if groups is not None else np.abs(beta).sum()
    two = beta if tau is None else tau @ beta
    return lam * (alpha * float(one) + 0.5 * (1 - alpha) * float(two @ two))


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, family: str = "bernoulli", lam: float = LAM, alpha: float = ALPHA, groups: np.ndarray | None = None, tau: np.ndarray | None = None,
    theta: float = THETA, steps: int = 3000, close: float = 1e-12,
) -> np.ndarray:
    """Coefficients, the intercept first, that minimise the mean negative log-likelihood plus the penalty.

    ``groups`` and ``tau`` cover the intercept too. Accelerated steps with backtracking; when a
    step doesn't descend, acceleration starts anew.
    """
    total = weight.sum()
    a = np.column_stack((np.ones(len(x)), x))
    ridge = lam * (1 - alpha)
    square = np.eye(a.shape[1]) if tau is None else tau.T @ tau

    def smooth(beta: np.ndarray) -> float:
        return -log_likelihood(family, y, mean_of(family, a @ beta), weight, theta) / total + 0.5 * ridge * float(beta @ square @ beta)

    beta = np.zeros(a.shape[1])
    level = float((weight * y).sum() / total)
    beta[0] = {"bernoulli": lambda m: math.log(m / (1 - m)), "poisson": math.log, "gaussian": lambda m: m, "neg-binomial": lambda m: math.log(math.expm1(m))}[family](
        min(max(level, 1e-6), 1 - 1e-6) if family == "bernoulli" else level if family == "gaussian" else max(level, 1e-6)
    )
    whole = lambda b: smooth(b) + lam * alpha * penalty(b, 1.0, 1.0, groups)
    ahead, t, step, last, still = beta, 1.0, 1.0, whole(beta), 0
    for _ in range(steps):
        here, slope = smooth(ahead), a.T @ (weight * _pull(family, y, a @ ahead, theta)) / total + ridge * (square @ ahead)
        while True:
            new = _shrunk(ahead - step * slope, step * lam * alpha, groups)
            move = new - ahead
            if smooth(new) <= here + slope @ move + (move @ move) / (2 * step) + 1e-15 or step < 1e-12:
                break
            step /= 2
        cost = whole(new)
        if cost > last:
            if t == 1.0:
                break
            ahead, t = beta, 1.0
            continue
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, t = new + (t - 1) / t_new * (new - beta), t_new
        still = still + 1 if last - cost < close * (1 + abs(last)) else 0
        beta, last, step = new, cost, step * 1.1
        if still >= 5:
            break
    return beta


def _cell_terms(family: str, n: np.ndarray, s: np.ndarray, eta: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell's negative log-likelihood but for a constant, its derivative by the predictor, and its expected curvature."""
    mu = mean_of(family, eta)
    if family == "bernoulli":
        return n * np.logaddexp(0, eta) - s * eta, n * mu - s, n * mu * (1 - mu)
    if family == "gaussian":
        return (0.5 * n * eta - s) * eta, n * eta - s, n
    slope = slope_of(family, eta)
    if family == "poisson":
        mu = mu + np.spacing(1)
        return n * mu - s * np.log(mu), slope * (n - s / mu), n * slope * slope / mu
    mu = mu + 1e-300
    return (n * theta + s) * np.log(mu + theta) - s * np.log(mu), slope * ((s + n * theta) / (mu + theta) - s / mu), n * slope * slope * theta / (mu * (mu + theta))


def _descended(square: np.ndarray, slope: np.ndarray, beta: np.ndarray, l1: float, spread: np.ndarray, of: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Where quadratics plus ``l1`` times the absolute sum are least: coordinate descent; the last axis tells problems apart.

    A feature's columns, weighted by their ``spread``, add up to nothing, so its coefficients may
    be shifted together: after each sweep to where a weighted median of them is 0, the least sum.
    """
    alike = [np.flatnonzero(of == f) for f in np.unique(of)]
    new, pull = beta.copy(), slope.copy()
    width = [np.where(square[j, j] > 1e-14, square[j, j], 0) for j in range(len(beta))]
    over = [np.divide(1, w, out=np.zeros_like(w), where=w > 0) for w in width]
    for _ in range(sweeps):
        moved = 0.0
        for j, (w, o) in enumerate(zip(width, over, strict=True)):
            raw = new[j] * w - pull[j]
            step = (raw - np.clip(raw, -l1, l1)) * o - new[j] * (w > 0)
            new[j] += step
            pull += square[j] * step
            moved = max(moved, float((step * step * w).max()))
        for j in alike:
            weight = spread[j]
            level = np.divide(new[j + 1], weight, out=np.zeros_like(weight), where=weight > 0)
            order = np.argsort(level, axis=0)
            heavy = np.cumsum(np.take_along_axis(weight, order, 0), axis=0)
            middle = np.take_along_axis(order, (heavy < heavy[-1] / 2).sum(axis=0)[None], 0)
            new[j + 1] -= weight * np.take_along_axis(level, middle, 0)
        if moved < 1e-16:
            break
    return new


def fit_cells(x: np.ndarray, of: np.ndarray, n: np.ndarray, s: np.ndarray, family: str = "bernoulli", l1: float = LAM, theta: float = THETA, steps: int = 100, close: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Many fits on the same cells: expected responses (problems, cells) and coefficients, the intercept first.

    ``x`` (cells, columns) and ``of`` are those of ``one_hot``, ``n`` and ``s`` (problems, cells) each problem's
    rows and the sum of their responses, on which all of these likelihoods depend alone. Columns
    are standardised by each problem's own rows; constant ones get no coefficient. Minimised is
    ``fit``'s target with a lasso: quadratic models with expected curvature, each solved by
    coordinate descent, and steps halved until they descend.
    """
    most = max(1, 1_000_000 // max(1, x.shape[0]))
    if len(n) > most:
        parts = [fit_cells(x, of, n[i : i + most], s[i : i + most], family, l1, theta, steps, close) for i in range(0, len(n), most)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    k, total, ones = x.shape[1], n.sum(axis=1), n @ x
    mean = ones / total[:, None]
    varies = (ones > 0) & (ones < total[:, None])
    spread = np.sqrt(np.where(varies, mean * (1 - mean), 0))
    scale = np.divide(1, spread, out=np.zeros_like(spread), where=varies)
    level = s.sum(axis=1) / total
    start = {
        "bernoulli": lambda m: (lambda p: np.log(p / (1 - p)))(np.clip(m, 1e-6, 1 - 1e-6)), "poisson": lambda m: np.log(np.maximum(m, 1e-6)),
        "gaussian": lambda m: m, "neg-binomial": lambda m: np.log(np.expm1(np.maximum(m, 1e-6))),
    }[family]
    beta = np.zeros((len(n), k + 1))
    beta[:, 0] = start(level)
    # products of two columns in each cell, where they are few; else a problem's at a time
    both = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k) if x.size * k <= 4_000_000 else None

    def predictor(beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        by = beta[:, 1:] * scale[at]
        return (beta[:, 0] - (by * mean[at]).sum(axis=1))[:, None] + by @ x.T

    def target(terms: np.ndarray, beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        return terms.sum(axis=1) / total[at] + l1 * np.abs(beta).sum(axis=1)

    at = np.arange(len(n))
    for _ in range(steps):
        b, m, c = beta[at], mean[at], scale[at]
        terms, pull, curve = _cell_terms(family, n[at], s[at], predictor(b, at), theta)
        here = target(terms, b, at)
        sums, v, pulls = curve.sum(axis=1), curve @ x, pull.sum(axis=1)
        square = (curve @ both).reshape(-1, k, k) if both is not None else np.stack([(x * row[:, None]).T @ x for row in curve])
        square = (square - m[:, :, None] * v[:, None, :] - v[:, :, None] * m[:, None, :] + (m[:, :, None] * m[:, None, :]) * sums[:, None, None]) * c[:, :, None] * c[:, None, :]
        whole = np.empty((k + 1, k + 1, len(at)))
        whole[1:, 1:], whole[0, 0] = square.transpose(1, 2, 0), sums
        whole[0, 1:] = whole[1:, 0] = ((v - m * sums[:, None]) * c).T
        slope = np.concatenate((pulls[:, None], (pull @ x - m * pulls[:, None]) * c), axis=1) / total[at, None]
        move = _descended(whole / total[at], slope.T.copy(), b.T.copy(), l1, spread[at].T.copy(), of).T - b
        gain = (slope * move).sum(axis=1) + l1 * (np.abs(b + move).sum(axis=1) - np.abs(b).sum(axis=1))
        size, open_ = np.ones(len(at)), np.flatnonzero(gain < -close * (1 + np.abs(here)))
        going = open_
        while len(open_):
            tried = b[open_] + size[open_, None] * move[open_]
            reached = target(_cell_terms(family, n[at[open_]], s[at[open_]], predictor(tried, at[open_]), theta)[0], tried, at[open_])
            fine = reached <= here[open_] + 1e-4 * size[open_] * gain[open_] + 1e-15
            beta[at[open_[fine]]] = tried[fine]
            open_ = open_[~fine]
            size[open_] /= 2
            going = going[~np.isin(going, open_[size[open_] < 1e-9])]
            open_ = open_[size[open_] >= 1e-9]
        at = at[going]
        if not len(at):
            break
    everyone = np.arange(len(n))
    return mean_of(family, predictor(beta, everyone)), beta


def standardised(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Columns of mean 0 and spread 1; constant ones are left out."""
    w = weight / weight.sum()
    mean = w @ x
    spread = np.sqrt(np.maximum(w @ (x - mean) ** 2, 0))
    return ((x - mean) / np.where(spread > 1e-12, spread, 1))[:, spread > 1e-12]


def roc_area(y: np.ndarray, mu: np.ndarray, weight: np.ndarray, thresholds: int = 100) -> float | None:
    """Area under the curve of ``thresholds`` even steps in [0, 1], by trapezoids."""
    at = mu[None, :] >= np.linspace(0, 1, thresholds)[:, None]
    up, down = (weight * (y > 0)).sum(), (weight * (y <= 0)).sum()
    if not up or not down:
        return None
    tpr, fpr = at @ (weight * (y > 0)) / up, at @ (weight * (y <= 0)) / down
    return float(-((tpr[1:] + tpr[:-1]) / 2 * np.diff(fpr)).sum())


def scores(family: str, y: np.ndarray, mu: np.ndarray, null_mu: np.ndarray | float, weight: np.ndarray, columns: int) -> dict:
    """Scores of a fit with ``columns`` covariates against the null model, each from the fit's own likelihood.

    ``nagelkerke`` divides Cox-Snell by its largest value, ``1 - exp(2 null / n)``, and
    ``nagelkerke_ref`` by ``1 - exp(null / (2 n))``.
    """
    n = float(weight.sum())
    one, none = log_likelihood(family, y, mu, weight), log_likelihood(family, y, np.broadcast_to(np.asarray(null_mu, float), y.shape), weight)
    best = {"bernoulli": 0.0, "gaussian": 0.0}.get(family)
    if best is None:
        best = log_likelihood(family, y, np.maximum(y, np.spacing(1)), weight)
    cox = 1 - math.exp(min(-2 / n * (one - none), 700))
    spikes, r2 = float((weight * y).sum()), 1 - one / none if none else None
    w = weight / n
    dy, dm = y - w @ y, mu - w @ mu
    low = math.sqrt((w @ dy**2) * (w @ dm**2))
    up = y > 0
    tjur = float(np.average(mu[up], weights=weight[up]) - np.average(mu[~up], weights=weight[~up])) if up.any() and not up.all() else None
    most, most_ref = (1 - math.exp(min(power * none / n, 700)) for power in (2, 0.5))
    return {
        "n": int(n), "loglik": one, "null_loglik": none, "deviance": 2 * (best - one), "pseudo_r2": r2, "llr": 2 * (one - none), "llr_per_spike": 2 * (one - none) / spikes if spikes else None,
        "accuracy": float((weight * ((mu > 0.5) == up)).sum() / n) if family == "bernoulli" else None, "auc": roc_area(y, mu, weight) if family == "bernoulli" else None,
        "cox_snell": cox, "nagelkerke": cox / most if most else None, "nagelkerke_ref": cox / most_ref if most_ref else None, "pearson2": float((w @ (dy * dm)) / low) ** 2 if low > 1e-12 else None,
        "adjusted_r2": 1 - (n - 1) / (n - columns) * (1 - r2) if r2 is not None and n > columns else None, "tjur": tjur,
    }


SCORES = ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in "n loglik null_loglik deviance pseudo_r2 llr llr_per_spike accuracy auc cox_snell nagelkerke nagelkerke_ref pearson2 adjusted_r2 tjur".split())


def design_rows(frames: DataFrame, features: list[str], unit: str = "unit", y: str = "y") -> DataFrame:
    """(unit, features, y, weight): frames without a bin in some feature don't count."""
    return frames.dropna(subset=[*features, y]).groupBy(unit, *features, F.col(y).cast("double").alias("y")).agg(F.count("*").alias("weight"))


def one_hot(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each value of each feature; and which feature, from 1, each column belongs to."""
    parts = [(column[:, None] == np.unique(column)).astype(float) for column in bins.T]
    return np.concatenate(parts, axis=1), np.repeat(np.arange(len(parts)) + 1, [p.shape[1] for p in parts])


def cell_rows(features: list[str]) -> Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, ...]]:
    """A batch's rows (``design_rows``) as they are: each one's unit, bins, response and weight."""
    return lambda units, rows: (units, np.column_stack([rows[f] for f in features]), rows["y"].astype(float), rows["weight"].astype(float))


def grid_rows(grid: pd.DataFrame, features: list[str], frame: str = "frame") -> Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, ...]]:
    """The same from a batch's frames with a response (unit, frame, y): all frames of ``grid`` count, those without a row as 0."""
    frames, bins = grid[frame].to_numpy(), grid[features].to_numpy()

    def rows(units: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        y = on_grid(units, found, frames, frame)
        cells, cell = np.unique(bins, axis=0, return_inverse=True)
        levels, level = np.unique(y, return_inverse=True)
        unit = np.repeat(np.arange(len(y)), len(frames))
        key = (unit * len(cells) + np.tile(cell.ravel(), len(y))) * len(levels) + level.ravel()
        key, weight = np.unique(key, return_counts=True)
        return key // (len(cells) * len(levels)), cells[key // len(levels) % len(cells)], levels[key % len(levels)].astype(float), weight.astype(float)

    return rows


def on_grid(units: np.ndarray, found: dict[str, np.ndarray], frames: np.ndarray, frame: str = "frame") -> np.ndarray:
    """Responses (units, frames) on the sorted ``frames``, 0 where a unit has no row."""
    y = np.zeros((units[-1] + 1, len(frames)), found["y"].dtype)
    place = np.minimum(np.searchsorted(frames, found[frame]), len(frames) - 1)
    known = frames[place] == found[frame]
    y[units[known], place[known]] = found["y"][known]
    return y


def _fits(unit: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, family: str, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fits of a batch's units: expected response of each row, coefficients, whether a column varies in a unit, and null models."""
    cells, cell = np.unique(bins, axis=0, return_inverse=True)
    cell, units = cell.ravel(), int(unit.max()) + 1
    n, s = np.zeros((units, len(cells))), np.zeros((units, len(cells)))
    np.add.at(n, (unit, cell), weight)
    np.add.at(s, (unit, cell), weight * y)
    x, of = one_hot(cells)
    mu, beta = fit_cells(x, of, n, s, family, lam)
    ones = n @ x
    return mu[unit, cell], beta, (ones > 0) & (ones < n.sum(axis=1, keepdims=True)), s.sum(axis=1) / n.sum(axis=1)


def _columns(found: list[dict]) -> dict:
    return {c: [f[c] for f in found] for c in found[0]}


def fit_units(rows: DataFrame, features: list[str], families: list[str], lam: float = LAM, alpha: float = ALPHA, grouped: bool = False, laid: Callable | None = None) -> DataFrame:
    """Scores of one model for each unit and family of ``rows`` (``design_rows``); a batch's units are fitted together.

    ``grouped`` penalises each feature's columns together. With ``laid`` (``grid_rows``) ``rows`` are frames with a response.
    """
    laid = laid or cell_rows(features)

    def each(unit: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, family: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int]]:
        """Rows, their expected response, coefficients and number of columns, unit by unit."""
        edges = np.searchsorted(unit, np.arange(unit[-1] + 2))
        together = not grouped and alpha == 1.0
        mus, betas, varies, _ = _fits(unit, bins, y, weight, family, lam) if together else (None,) * 4
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if together:
                yield slice(a, b), mus[a:b], betas[i][np.append(True, varies[i])], int(varies[i].sum())
                continue
            x, of = one_hot(bins[a:b])
            w = weight[a:b] / weight[a:b].sum()
            kept = w @ (x - w @ x) ** 2 > 1e-24
            x, groups = standardised(x, weight[a:b]), np.append(0, of[kept]) if grouped else None
            beta = fit(x, y[a:b], weight[a:b], family, lam, alpha, groups)
            yield slice(a, b), mean_of(family, beta[0] + x @ beta[1:]), beta, x.shape[1]

    def work(units: np.ndarray, batch: dict[str, np.ndarray]) -> dict:
        unit, bins, response, weight = laid(units, batch)
        found = []
        for family in families:
            y = (response > 0.5).astype(float) if family == "bernoulli" else response
            for at, mu, beta, columns in each(unit, bins, y, weight, family):
                null = float(weight[at] @ y[at] / weight[at].sum())
                found.append({"unit": unit[at.start], "family": family} | scores(family, y[at], mu, null, weight[at], columns) | {"zeros": int((np.abs(beta) < 1e-12).sum())})
        return _columns(found)

    return unit_batches(rows, work, f"unit bigint, family string, {SCORES}, zeros int")


def backward_scores(rows: DataFrame, final: list[str], family: str = "bernoulli", lam: float = LAM, laid: Callable | None = None) -> DataFrame:
    """Scores of the final model, and of each sub-model that lacks one covariate, on all frames of each unit.

    ``left_out`` is null for the final model. Null model: the mean response. ``laid`` as in ``fit_units``.
    """
    laid = laid or cell_rows(final)

    def work(units: np.ndarray, batch: dict[str, np.ndarray]) -> dict:
        unit, bins, y, weight = laid(units, batch)
        y = (y > 0.5).astype(float) if family == "bernoulli" else y
        edges = np.searchsorted(unit, np.arange(unit[-1] + 2))
        found = []
        for left_out in [None, *(final if len(final) > 1 else [])]:
            mu, _, varies, null = _fits(unit, bins[:, [i for i, f in enumerate(final) if f != left_out]], y, weight, family, lam)
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                found.append({"unit": i, "left_out": left_out} | scores(family, y[a:b], mu[a:b], float(null[i]), weight[a:b], int(varies[i].sum())))
        return _columns(found)

    return unit_batches(rows, work, f"unit bigint, left_out string, {SCORES}")
