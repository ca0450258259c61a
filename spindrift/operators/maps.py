"""Occupancy, rate maps in one and two dimensions, smoothing, information rate, tuning peaks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.bins import gauss, ratio


def occupancy(frames: DataFrame, keys: list[str], seconds_per_frame: float) -> DataFrame:
    """Seconds spent in each bin; frames without a bin don't count."""
    return frames.dropna(subset=keys).groupBy(*keys).agg((F.count("*") * seconds_per_frame).alias("occ"))


def rate_map(spikes: DataFrame, occ: DataFrame, units: list[str], bins: list[str]) -> DataFrame:
    """Spikes per second of occupancy, for each unit and each occupied bin; bins without spikes have rate 0."""
    counts = spikes.dropna(subset=bins).groupBy(*units, *bins).agg(F.count("*").alias("n"))
    grid = counts.select(*units).distinct().crossJoin(F.broadcast(occ))  # bins: a fixed grid
    return grid.join(counts, [*units, *bins], "left").select(*units, *bins, "occ", (F.coalesce("n", F.lit(0)) / F.col("occ")).alias("raw"))


def smooth(
    rates: DataFrame, units: list[str], bins: list[str], sigmas: list[float], value: str = "raw", min_occ: float | None = None, periods: dict[str, int] | None = None
) -> DataFrame:
    """Gaussian mean over all bins of a unit, each weighted by its distance; with ``min_occ`` only over bins with more.

    ``periods`` names the bins whose distance wraps. The kernel is a join of the grid with itself,
    per unit: its size is the grid's squared, not the data's.
    """
    source = rates if min_occ is None else rates.where(F.col("occ") > min_occ)
    other = source.select(*units, *(F.col(b).alias(f"{b}_") for b in bins), F.col(value).alias("v_"))
    weight: Column = F.lit(1.0)
    for b, sigma in zip(bins, sigmas, strict=True):
        delta = F.abs(F.col(b) - F.col(f"{b}_"))
        if periods and b in periods:
            delta = F.least(delta, F.lit(periods[b]) - delta)
        weight = weight * gauss(delta, sigma)
    pairs = rates.join(other, units) if units else rates.crossJoin(other)
    return pairs.groupBy(*units, *bins).agg(F.first("occ").alias("occ"), F.first(value).alias(value), ratio(F.sum(weight * F.col("v_")), F.sum(weight)).alias("smoothed"))


def information_rate(rates: DataFrame, units: list[str], value: str = "raw") -> DataFrame:
    """Skaggs information: sum of p * (r / mean) * log2(r / mean) over bins with r > 1e-6, p the share of occupancy."""
    total = Window.partitionBy(*units)
    p = F.col("occ") / F.sum("occ").over(total)
    shares = rates.withColumn("p", p).withColumn("mean_rate", F.sum(F.col("p") * F.col(value)).over(total))
    x = F.col(value) / F.col("mean_rate")
    return shares.groupBy(*units).agg(F.coalesce(F.sum(F.when((F.col(value) > 1e-6) & (F.col("mean_rate") > 0), F.col("p") * x * F.log2(x))), F.lit(0.0)).alias("info"))


def adaptive_bounds(histogram: list[tuple[float, float]], lo: float, hi: float, n: int, least: float, rate: float = 0.05, steps: int = 10_000) -> tuple[float, float]:
    """Bounds drawn in by a share of a bin until both edge bins hold at least ``least``.

    ``histogram`` (value, weight) is a fine pre-aggregated table, so this is a small loop.
    """
    values = np.array([v for v, _ in histogram])
    weights = np.array([w for _, w in histogram])
    for _ in range(steps):
        width = (hi - lo) / n
        if width <= 0:
            break
        low = weights[(values > lo) & (values <= lo + width)].sum() >= least
        high = weights[(values > hi - width) & (values <= hi)].sum() >= least
        if low and high:
            break
        lo, hi = (lo if low else lo + rate * width), (hi if high else hi - rate * width)
    return float(lo), float(hi)


def peak_exceeds(curves: DataFrame, units: list[str], radius: int = 1) -> DataFrame:
    """Whether a curve's first maximum, and its neighbours within ``radius``, exceed mean + 3 std of its shuffles.

    ``curves``: units, bin, rate, sh_mean, sh_std. At an edge the neighbours that exist decide.
    """
    over = F.col("rate") > F.col("sh_mean") + 3 * F.col("sh_std")
    peak = curves.groupBy(*units).agg(F.max(F.struct("rate", (-F.col("bin")).alias("b"))).alias("m")).select(*units, (-F.col("m.b")).alias("peak_bin"), F.col("m.rate").alias("peak_rate"))
    near = curves.withColumn("over", over).join(peak, units).where(F.abs(F.col("bin") - F.col("peak_bin")) <= radius)
    return near.groupBy(*units, "peak_bin", "peak_rate").agg(F.bool_and("over").alias("exceeds"))


def shuffled_maps(spikes: DataFrame, lags: DataFrame, bin_after: Callable[[Column], Column], units: list[str]) -> DataFrame:
    """Counts per unit, shuffle and bin of spikes moved by each shuffle's lag: aggregated, never kept as a cube."""
    moved = spikes.crossJoin(F.broadcast(lags))  # a fixed number of shuffles
    return moved.withColumn("bin", bin_after(F.col("us") + F.col("lag_us"))).dropna(subset=["bin"]).groupBy(*units, "shuffle_id", "bin").agg(F.count("*").alias("n"))


def named_pairs(frames: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Each frame once for each named pair of covariates, as ``pair``, ``x`` and ``y``: all maps come from one scan."""
    return frames.withColumn("p", F.explode(F.array(*(F.struct(F.lit(name).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for name, (x, y) in pairs.items())))).select("*", "p.*").drop("p")
