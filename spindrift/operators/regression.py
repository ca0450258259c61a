"""Regularised logistic models of spiking on binned covariates: folds, fits, selection, ablation.

Covariates are binned, so a unit's frames reduce to counts for each combination of bins and fold:
one shuffle of small counts. The fits run on these, however long the recording is.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.batches import unit_batches
from spindrift.functions.bins import md5_uniform
from spindrift.operators.glm import fit_cells, on_grid, one_hot
from spindrift.operators.resampling import signed_rank_exact_greater

FOLDS, L1, ALPHA = 10, 1e-4, 0.01


def assign_folds(frames: DataFrame, unit: str = "unit", frame: str = "frame", y: str = "y", folds: int = FOLDS) -> DataFrame:
    """Folds of a unit's frames: its first ``folds`` frames with y <> 0 get one each; the rest is cut into
    folds * folds consecutive blocks, the first ones one longer, dealt to the folds in turn."""
    by = Window.partitionBy(unit)
    seed = F.when(F.col(y) != 0, F.row_number().over(Window.partitionBy(unit, (F.col(y) != 0)).orderBy(frame)) - 1)
    rows = frames.withColumn("seed", F.when(seed < folds, seed))
    rows = rows.withColumn("rest", F.when(F.col("seed").isNull(), F.row_number().over(Window.partitionBy(unit, F.col("seed").isNull()).orderBy(frame)) - 1))
    rows = rows.withColumn("left", F.count("rest").over(by))
    blocks = folds * folds
    size, more = F.floor(F.col("left") / blocks), F.col("left") % blocks
    long = more * (size + 1)
    block = F.when(F.col("rest") < long, F.floor(F.col("rest") / (size + 1))).otherwise(more + F.floor(F.try_divide(F.col("rest") - long, size)))
    return rows.withColumn("fold", F.coalesce("seed", block % folds).cast("int")).drop("seed", "rest", "left")


def plain_folds(frames: DataFrame, method: str, unit: str = "unit", frame: str = "frame", folds: int = FOLDS, repeat: int = 0) -> DataFrame:
    """Folds of a unit's frames: ``block``, consecutive ones together; or ``random``, by a hash, anew for each ``repeat``."""
    order = [F.col(frame)] if method == "block" else [md5_uniform(F.lit("fold"), F.lit(repeat), unit, frame), F.col(frame)]
    place, n = F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1, F.count("*").over(Window.partitionBy(unit))
    return frames.withColumns({"place": place, "n": n}).withColumn("fold", (F.floor(F.col("place") * folds / F.col("n")) if method == "block" else F.col("place") % folds).cast("int")).drop("place", "n")


def design_counts(frames: DataFrame, features: list[str], unit: str = "unit", y: str = "y") -> DataFrame:
    """Frames and spikes for each unit, fold and combination of bins; frames without a bin in some feature don't count."""
    return frames.dropna(subset=features).groupBy(unit, "fold", *features).agg(F.count("*").alias("n"), F.sum((F.col(y) > 0).cast("int")).alias("spikes"))


def fit_logistic(x: np.ndarray, spikes: np.ndarray, n: np.ndarray, l1: float = L1, steps: int = 400) -> np.ndarray:
    """Coefficients (intercept first) of the mean Bernoulli log-likelihood less ``l1`` times their absolute sum.

    Accelerated proximal gradient with restarts; the intercept is penalised like the others.
    """
    total = n.sum()
    a = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(a.shape[1])
    share = np.clip(spikes.sum() / total, 1e-6, 1 - 1e-6)
    beta[0] = np.log(share / (1 - share))
    step = 4.0 / max(1e-12, np.linalg.eigvalsh((a * n[:, None]).T @ a / total)[-1])
    ahead, t, last = beta.copy(), 1.0, np.inf
    for _ in range(steps):
        eta = a @ ahead
        new = ahead - step * (a.T @ (n / (1 + np.exp(-eta)) - spikes)) / total
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        eta = a @ new
        cost = (n * np.logaddexp(0, eta) - spikes * eta).sum() / total + l1 * np.abs(new).sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, t = (new + (t - 1) / t_new * (new - beta), t_new) if cost <= last else (new, 1.0)
        done = abs(last - cost) < 1e-10
        beta, last = new, cost
        if done:
            break
    return beta


#: What models are fitted on: cells (cells, features), and frames and spikes (units, folds, cells).
Dense = tuple[np.ndarray, np.ndarray, np.ndarray]


def dense_counts(features: list[str], folds: int = FOLDS) -> Callable[[np.ndarray, dict[str, np.ndarray]], Dense]:
    """Lays a batch's counts (``design_counts``) out densely."""

    def laid(units: np.ndarray, rows: dict[str, np.ndarray]) -> Dense:
        cells, place = np.unique(np.column_stack([rows[f] for f in features]), axis=0, return_inverse=True)
        shape, at = (units[-1] + 1, folds, len(cells)), (units, rows["fold"], place.ravel())
        n, spikes = np.zeros(shape), np.zeros(shape)
        np.add.at(n, at, rows["n"].astype(float))
        np.add.at(spikes, at, rows["spikes"].astype(float))
        return cells, n, spikes

    return laid


def folded_grid(grid: pd.DataFrame, features: list[str], folds: int = FOLDS, frame: str = "frame") -> Callable[[np.ndarray, dict[str, np.ndarray]], Dense]:
    """The same from a batch's frames with a response (unit, frame, y): all frames of ``grid``, in the folds of ``assign_folds``."""
    grid = grid.dropna(subset=features)
    frames = grid[frame].to_numpy()
    cells, cell = np.unique(grid[features].to_numpy(), axis=0, return_inverse=True)
    cell = cell.ravel()

    def laid(units: np.ndarray, found: dict[str, np.ndarray]) -> Dense:
        fired = on_grid(units, found, frames, frame) > 0
        nth = np.cumsum(fired, axis=1) - 1
        seed = fired & (nth < folds)
        rest, left = np.cumsum(~seed, axis=1) - 1, (~seed).sum(axis=1, keepdims=True)
        size, more = left // (folds * folds), left % (folds * folds)
        block = np.where(rest < more * (size + 1), rest // (size + 1), more + (rest - more * (size + 1)) // np.maximum(size, 1))
        fold = np.where(seed, nth, block % folds)
        shape = (len(fired), folds, len(cells))
        key = ((np.arange(len(fired))[:, None] * folds + fold) * len(cells) + cell).ravel()
        n, spikes = (np.bincount(key, w, minlength=shape[0] * shape[1] * shape[2]).reshape(shape).astype(float) for w in (None, fired.ravel().astype(float)))
        return cells, n, spikes

    return laid


def model_scores(dense: Dense, used: list[int], l1: float = L1) -> dict[str, np.ndarray]:
    """Held-out scores (units, folds) of the model of the features ``used``; NaN in folds that can't be fitted.

    Columns are standardised by the training part, constant ones count for nothing. Units and
    folds are fitted together on the model's own cells.
    """
    cells, place = np.unique(dense[0][:, used], axis=0, return_inverse=True)
    merge = (place.ravel()[:, None] == np.arange(len(cells))).astype(float)
    n, spikes = dense[1] @ merge, dense[2] @ merge
    n_train, s_train = n.sum(axis=1, keepdims=True) - n, spikes.sum(axis=1, keepdims=True) - spikes
    all_n, all_s, frames, fired = (v.sum(axis=2) for v in (n_train, s_train, n, spikes))
    ok = (frames > 0) & (all_n > 0) & (all_s > 0) & (all_s < all_n)
    found = {"n": frames, "n_spikes": fired} | {c: np.full(ok.shape, np.nan) for c in ("deviance", "pseudo_r2", "llr", "accuracy", "llr_per_spike")}
    if ok.any():
        mu = np.clip(fit_cells(*one_hot(cells), n_train[ok], s_train[ok], "bernoulli", l1)[0], 1e-10, 1 - 1e-10)
        s, m, base = spikes[ok], n[ok], np.clip(all_s[ok] / all_n[ok], 1e-10, 1 - 1e-10)
        one = (s * np.log(mu) + (m - s) * np.log(1 - mu)).sum(axis=1)
        none = fired[ok] * np.log(base) + (frames[ok] - fired[ok]) * np.log(1 - base)
        found["deviance"][ok], found["llr"][ok] = -2 * one, 2 * (one - none)
        found["pseudo_r2"][ok] = 1 - np.divide(one, none, out=np.full(len(one), np.nan), where=none != 0)
        found["accuracy"][ok] = np.where(mu >= 0.5, s, m - s).sum(axis=1) / frames[ok]
        found["llr_per_spike"][ok] = np.divide(2 * (one - none), fired[ok], out=np.full(len(one), np.nan), where=fired[ok] > 0)
    return found


SCORES = "unit bigint, model string, fold int, n bigint, n_spikes bigint, deviance double, pseudo_r2 double, llr double, accuracy double, llr_per_spike double"


def cross_validate(counts: DataFrame, models: list[tuple[str, ...]], features: list[str], l1: float = L1, folds: int = FOLDS, laid: Callable | None = None) -> DataFrame:
    """Fold scores of all ``models`` (tuples of features) for all units; a batch's units are fitted together.

    With ``laid`` (``folded_grid``) ``counts`` are frames with a response, in no folds yet.
    """
    laid = laid or dense_counts(features, folds)

    def work(units: np.ndarray, rows: dict[str, np.ndarray]) -> dict:
        dense, parts = laid(units, rows), []
        for model in models:
            found = model_scores(dense, [features.index(f) for f in model], l1)
            unit, fold = np.nonzero(~np.isnan(found["llr"]))
            parts.append({"unit": unit, "model": np.full(len(unit), "+".join(model), object), "fold": fold} | {c: v[unit, fold] for c, v in found.items()})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return unit_batches(counts, work, SCORES)


def forward_selection(counts: DataFrame, features: list[str], alpha: float = ALPHA, exclusive: list[set[str]] | None = None, start: tuple[str, ...] = (), l1: float = L1, folds: int = FOLDS, laid: Callable | None = None) -> DataFrame:
    """(unit, layer, model, mean_score, p, chosen): each layer adds the covariate that improves a unit's model most.

    A unit's counts are bounded by the bins, so one task does its whole selection; a batch's units
    are fitted together and nothing passes the driver. A candidate must beat the model before
    it over the folds (signed-rank, one-sided, exact) at ``alpha`` and have the largest mean
    score, which must grow; ties take the first. ``exclusive`` names sets of which a model holds
    one member at most; ``start`` is a model that all units begin with, scored in layer 0.
    ``laid`` as in ``cross_validate``.
    """
    laid = laid or dense_counts(features, folds)
    columns = ("unit", "layer", "model", "mean_score", "p", "chosen")

    def work(units: np.ndarray, rows: dict[str, np.ndarray]) -> dict:
        cells, n, spikes = laid(units, rows)

        def scored(model: tuple[str, ...], which: list[int]) -> dict[int, dict[int, float]]:
            found = model_scores((cells, n[which], spikes[which]), [features.index(f) for f in model], l1)["llr_per_spike"]
            return {u: {k: v for k, v in enumerate(row.tolist()) if v == v} for u, row in zip(which, found, strict=True)}

        average = lambda scores: float(np.mean(list(scores.values())))
        first, running, found = tuple(sorted(start)), list(range(len(n))), []
        best, scores, mean = dict.fromkeys(running, first), dict.fromkeys(running, {}), dict.fromkeys(running, 0.0)
        if first:
            scores |= scored(first, running)
            mean |= {u: average(scores[u]) for u in running if scores[u]}
            found += [(u, 0, "+".join(first), mean[u] if scores[u] else None, None, True) for u in running]
        for layer in range(1, len(features) - len(first) + 1):
            wanted = {u: [tuple(sorted((*best[u], f))) for f in features if f not in best[u] and not any(f in g and g & set(best[u]) for g in exclusive or [])] for u in running}
            now = {model: scored(model, [u for u in running if model in wanted[u]]) for model in dict.fromkeys(m for u in running for m in wanted[u])}
            on = []
            for u in running:
                tried = []
                for model in wanted[u]:
                    one = now[model][u]
                    p = signed_rank_exact_greater([v - scores[u].get(k, 0.0) for k, v in one.items() if not scores[u] or k in scores[u]])
                    tried.append((average(one) if one else float("-inf"), p, model, one))
                good = [x for x in tried if x[1] < alpha and x[0] > mean[u]]
                top = max(good, key=lambda x: x[0]) if good else None
                found += [(u, layer, "+".join(m), x if np.isfinite(x) else None, p, top is not None and m == top[2]) for x, p, m, _ in tried]
                if top is not None:
                    mean[u], _, best[u], scores[u] = top
                    on.append(u)
            running = on
        return dict(zip(columns, zip(*found, strict=True), strict=True)) if found else {c: [] for c in columns}

    return unit_batches(counts, work, "unit bigint, layer int, model string, mean_score double, p double, chosen boolean")


def ablation(counts: DataFrame, final: list[str], **fit: float | Callable) -> DataFrame:
    """Mean held-out scores of the final model and of each sub-model that lacks one covariate."""
    models = [tuple(final), *combinations(final, len(final) - 1)] if len(final) > 1 else [tuple(final)]
    scores = cross_validate(counts, models, final, **fit)
    return scores.groupBy("unit", "model").agg(F.avg("llr_per_spike").alias("llr_per_spike"), F.avg("pseudo_r2").alias("pseudo_r2"), F.avg("accuracy").alias("accuracy"), F.sum("n").alias("n"))
