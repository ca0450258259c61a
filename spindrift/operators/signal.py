"""Smoothing along an axis, wavelet power, segmentation of a density, curve fits: dense steps, one series per task."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_filter(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter with mirrored edges, cut at four sigmas."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values, radius, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def gaussian_filter_bins(rows: DataFrame, keys: list[str], order: str, value: str, sigma: float, n: int) -> DataFrame:
    """The same over bins 0..n-1 of each key: each bin is given to its neighbours, mirrored at the edges, and summed."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    kernel = F.array(*(F.struct(F.lit(k - radius).alias("d"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)))
    # target bins b read source positions b + d, mirrored; from the source's side these are three reflections
    spread = rows.select(*keys, F.col(order).alias("s"), F.col(value).alias("v"), F.explode(F.array(F.col(order), -F.col(order) - 1, F.lit(2 * n - 1) - F.col(order))).alias("at"), kernel.alias("k"))
    moved = spread.select(*keys, "v", "at", F.explode("k").alias("k")).select(*keys, (F.col("at") - F.col("k.d")).cast("int").alias(order), (F.col("v") * F.col("k.w")).alias("part"))
    return moved.where(F.col(order).between(0, n - 1)).groupBy(*keys, order).agg(F.sum("part").alias("smoothed"))


def morlet_power(values: np.ndarray, scales: np.ndarray, fps: float, omega: float = 6.0) -> np.ndarray:
    """Power (scales, frames) of the Morlet transform, by one product in the frequency domain for each scale."""
    n = len(values)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.fft(values - values.mean(), size)
    w = 2 * np.pi * np.fft.fftfreq(size, 1 / fps)
    found = np.empty((len(scales), n))
    for i, s in enumerate(scales):
        daughter = np.pi**-0.25 * np.sqrt(2 * np.pi * s * fps) * np.exp(-0.5 * (s * w - omega) ** 2) * (w > 0)
        found[i] = np.abs(np.fft.ifft(spectrum * daughter)[:n]) ** 2
    return found


def wavelet_power(series: DataFrame, keys: list[str], fps: float, scales: list[float], order: str = "frame", value: str = "value") -> DataFrame:
    """keys, scale, frame, power of each key's series, which is one task's work; nulls count as the mean."""
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        v = rows[value].to_numpy(float)
        v = np.where(np.isnan(v), np.nanmean(v) if not np.isnan(v).all() else 0.0, v)
        power = morlet_power(v, np.array(scales), fps)
        n = len(rows)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "scale": np.repeat(scales, n), "frame": np.tile(rows[order].to_numpy(), len(scales)), "power": power.ravel()})

    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(transform, f"{kinds}, scale double, frame bigint, power double")


def spline_trend(values: np.ndarray, every: int = 120) -> np.ndarray:
    """Least-squares cubic spline with a knot every so many frames: what changes slowly."""
    t = np.linspace(-1, 1, len(values)) if len(values) > 1 else np.zeros(len(values))
    knots = t[every:-1:every] if len(values) > every else np.empty(0)
    basis = np.column_stack([t**k for k in range(4)] + [np.maximum(t - k, 0) ** 3 for k in knots])
    return basis @ np.linalg.lstsq(basis, values, rcond=None)[0]


def red_noise_power(values: np.ndarray, scales: np.ndarray, fps: float, level: float = 0.95, omega: float = 6.0) -> np.ndarray:
    """For each scale the power that AR(1) noise of the series' variance and lag-1 correlation exceeds with probability 1 - level.

    Torrence and Compo, 1998: a chi-squared variable of two degrees of freedom, whose quantile is -2 ln(1 - level).
    """
    d = values - values.mean()
    variance = float((d * d).mean())
    alpha = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if variance > 0 else 0.0
    period = 4 * np.pi * scales / (omega + np.sqrt(2 + omega * omega))
    spectrum = (1 - alpha**2) / (1 + alpha**2 - 2 * alpha * np.cos(2 * np.pi / (period * fps)))
    return variance * spectrum * -np.log(1 - level)


def time_frequency(series: DataFrame, keys: list[str], fps: float, scales: list[float], every: int = 120, level: float = 0.95, order: str = "frame", value: str = "value") -> DataFrame:
    """keys, scale, frame, amplitude, significant, averaged of each key's series without its spline trend, in units of its spread.

    ``amplitude`` is the root of the Morlet power; ``significant`` tells whether the power exceeds
    that of red noise; ``averaged`` is the power averaged over the scales (the same for each). A
    key's series is one task's work; nulls count as the mean.
    """
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        v = rows[value].to_numpy(float)
        v = np.where(np.isnan(v), np.nanmean(v) if not np.isnan(v).all() else 0.0, v)
        v = v - spline_trend(v, every)
        v = v / v.std() if v.std() > 1e-12 else np.zeros(len(v))
        at, n = np.array(scales), len(rows)
        power = morlet_power(v, at, fps)
        step = np.log2(at[1] / at[0]) if len(at) > 1 else 1.0
        averaged = step / (fps * 0.776) * (power / at[:, None]).sum(axis=0)  # fixed value: the Morlet wavelet's reconstruction factor
        significant = power > red_noise_power(v, at, fps, level)[:, None]
        return pd.DataFrame(
            {**{k: rows[k].iloc[0] for k in keys}, "scale": np.repeat(scales, n), "frame": np.tile(rows[order].to_numpy(), len(scales)), "amplitude": np.sqrt(power).ravel(), "significant": significant.ravel(), "averaged": np.tile(averaged, len(scales))}
        )

    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(transform, f"{kinds}, scale double, frame bigint, amplitude double, significant boolean, averaged double")


def density_grid(points: DataFrame, n: int = 60, margin: float = 0.05) -> DataFrame:
    """(gx, gy, n) counts of points (x, y) on an n x n grid that reaches past the extremes by a margin."""
    ends = points.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    at = {}
    for c in "xy":
        span = F.col(f"max_{c}") - F.col(f"min_{c}")
        low = F.col(f"min_{c}") - margin * span
        at[c] = F.least(F.floor(F.try_divide((F.col(c) - low) * n, span * (1 + 2 * margin))), F.lit(n - 1)).cast("int")
    return points.crossJoin(F.broadcast(ends)).groupBy(at["x"].alias("gx"), at["y"].alias("gy")).agg(F.count("*").alias("n"))  # one row


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    rows = np.apply_along_axis(gaussian_filter, 0, image, sigma)
    return np.apply_along_axis(gaussian_filter, 1, rows, sigma)


def watershed(image: np.ndarray) -> np.ndarray:
    """Labels from 1 of the basins around an image's maxima, grown from the highest value down."""
    n, m = image.shape
    labels = np.zeros((n, m), int)
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    heap, found = [], 0
    for i in range(n):
        for j in range(m):
            near = [image[i + a, j + b] for a, b in around if 0 <= i + a < n and 0 <= j + b < m]
            if image[i, j] > 0 and all(image[i, j] >= v for v in near) and not any(labels[i + a, j + b] for a, b in around if 0 <= i + a < n and 0 <= j + b < m and image[i + a, j + b] == image[i, j]):
                found += 1
                labels[i, j] = found
                heapq.heappush(heap, (-image[i, j], i, j))
    while heap:
        _, i, j = heapq.heappop(heap)
        for a, b in around:
            x, y = i + a, j + b
            if 0 <= x < n and 0 <= y < m and not labels[x, y] and image[x, y] > 0:
                labels[x, y] = labels[i, j]
                heapq.heappush(heap, (-image[x, y], x, y))
    return labels


def segment(points: DataFrame, n: int = 60, sigma: float = 2.0) -> DataFrame:
    """(gx, gy, label) of the blurred density's basins; the grid, whatever the number of points, is one task's work."""
    counts = density_grid(points, n)

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((n, n))
        image[rows["gx"], rows["gy"]] = rows["n"]
        labels = watershed(blur(image, sigma))
        return pd.DataFrame({"gx": rows["gx"], "gy": rows["gy"], "label": labels[rows["gx"], rows["gy"]]})

    return counts.groupBy(F.lit(0).alias("all")).applyInPandas(label, "gx int, gy int, label int")


def fit_decay(x: np.ndarray, y: np.ndarray, mu: float, sigma: float, betas: np.ndarray | None = None) -> tuple[float, float, float]:
    """A, beta, B of A * exp(-x / beta) + B * Gauss(mu, sigma): least squares, beta by search."""
    best = (np.inf, 0.0, 0.0, 0.0)
    bump = np.exp(-0.5 * ((x - mu) / sigma) ** 2)
    for beta in betas if betas is not None else np.geomspace(0.01, 100, 200) * max(np.ptp(x), 1e-9):
        a = np.column_stack((np.exp(-x / beta), bump))
        c, *_ = np.linalg.lstsq(a, y, rcond=None)
        best = min(best, (float(((a @ c - y) ** 2).sum()), float(c[0]), float(beta), float(c[1])))
    return best[1:]
