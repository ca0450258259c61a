"""Expressions for frames, bins and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_of(us: Column, frame_us: int, rounding: str = "floor") -> Column:
    """Frame of a time: ``floor`` as spike counts take it, ``round`` (half to even) as rate maps do."""
    if rounding == "floor":
        return F.floor(us / F.lit(frame_us)).cast("bigint")
    return F.rint(us / F.lit(frame_us)).cast("bigint")


def bin_of(value: Column, lo: float, hi: float, n: int, closed: str = "right") -> Column:
    """Bin 0..n-1 of a value, null outside: ``right`` means (lo, hi], ``left`` means [lo, hi)."""
    at = (value - F.lit(lo)) * F.lit(n) / F.lit(hi - lo)
    found = (F.ceil(at) - 1 if closed == "right" else F.floor(at)).cast("int")
    return F.when((found >= 0) & (found < n), found)


def spine(spark: SparkSession, n: int, name: str = "bin") -> DataFrame:
    """All bins 0..n-1, so that empty ones get a row."""
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def wrapped(angle: Column) -> Column:
    """An angle difference brought once to (-180, 180]."""
    return F.when(angle > 180, angle - 360).when(angle < -180, angle + 360).otherwise(angle)


def gauss(delta: Column, sigma: float) -> Column:
    return F.exp(-0.5 * delta * delta / (sigma * sigma))


def md5_uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone, the same in any engine with md5."""
    text = F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, halves away from 0, by whole numbers: many times faster than ``round``, which goes through decimals. For |x| below 1e9."""
    scale = 10.0**digits
    whole = F.abs(x) * F.lit(scale)
    near = F.floor(whole)
    near = F.when(whole - near >= 0.5, near + 1).otherwise(near)
    return F.when(x < 0, -near).otherwise(near) / F.lit(scale)
