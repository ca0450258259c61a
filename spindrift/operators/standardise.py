"""Covariates in blocks: centred, and each block made orthonormal by a QR decomposition that is merged over tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.places import settled

#: Factors that a task merges into one.
FAN_IN = 32
#: A diagonal entry of a factor below this share of its column's length means that the block lacks full rank.
RANK_SHARE = 1e-10


@dataclass(frozen=True)
class Standard:
    """What turned covariates x into z: ``z = (x - mean) @ inverse``, over ``n`` rows."""

    n: int
    mean: np.ndarray
    inverse: np.ndarray

    def original(self, intercept: float, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Intercept and coefficients for x from those for z."""
        back = self.inverse @ np.asarray(beta, float)
        return float(intercept - self.mean @ back), back


def _whole(column: Column | str) -> Column:
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _factor(x: np.ndarray) -> np.ndarray:
    """R of ``x = Q R``, square and with a diagonal of no negative entry, so that it doesn't depend on the order of rows."""
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])
    return r * np.where(np.diag(r) < 0, -1, 1)[:, None]


def _merged(factors: DataFrame, width: int) -> np.ndarray:
    """The R of all rows from those of parts (part, r): a tree of tasks that merge ``FAN_IN`` each."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        stacked = table["r"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_factor(stacked).ravel().tolist()], pa.list_(pa.float64()))})

    factors = settled(factors, "factors")
    while (parts := factors.agg(F.max("part")).head()[0]) is not None and (parts > 0 or factors.count() > 1):
        factors = settled(factors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, "part bigint, r array<double>"), "factors")
    found = factors.head()
    return np.array(found.r, float).reshape(width, width) if found else np.zeros((width, width))


def factor(rows: DataFrame, column: str, width: int, mean: np.ndarray | None = None) -> np.ndarray:
    """R of the QR decomposition of all vectors of ``width`` entries less ``mean``, as if they were one tall matrix.

    A task folds its rows batch by batch into one square factor; factors are merged 32 by 32. So
    a task holds a batch and a factor, and nothing but the last factor reaches the driver.
    """
    mean = np.zeros(width) if mean is None else mean

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = np.zeros((0, width)), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) and part is None else part
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean
            r = _factor(np.vstack([r, x])) if len(x) else r
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    vectors = rows.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(column).cast("array<double>").alias("x")).where(_whole("x"))
    return _merged(vectors.mapInArrow(fold, "part bigint, r array<double>"), width)


def standardised_blocks(rows: DataFrame, column: str, groups: list[int], out: str = "z") -> tuple[DataFrame, Standard]:
    """``rows`` with ``out``, the vectors of ``column`` centred and each block of entries made orthonormal.

    ``groups`` has a number for each entry. Entries of group 0, which bear no penalty, are scaled
    one by one to a mean square of 1; those of another group become columns of mean square 1
    that are orthogonal to each other. A block without full rank is an error that names it. A
    vector that is null or has nulls or non-finite numbers takes no part and gives null; one
    of another length is an error. Without rows there is nothing to scale: the identity.
    """
    width, at = len(groups), np.array(groups)
    vectors = rows.select(F.col(column).cast("array<double>").alias("x")).where(_whole("x"))
    means = {r.i: (r.m, r.n) for r in vectors.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()}  # a row for each entry
    if means and (len(means) != width or len({n for _, n in means.values()}) != 1):
        raise ValueError(f"not all vectors have {width} entries")
    if not means:
        return rows.withColumn(out, F.lit(None).cast("array<double>")), Standard(0, np.zeros(width), np.eye(width))
    n, mean = means[0][1], np.array([means[i][0] for i in range(width)])
    order = np.argsort(at, kind="stable")
    r = factor(rows, column, width, mean)
    gram = r.T @ r  # lengths only; blocks are decomposed from r itself, which keeps its precision
    inverse = np.zeros((width, width))
    for g in dict.fromkeys(at[order].tolist()):
        own = np.flatnonzero(at == g)
        if g == 0:
            length = np.sqrt(np.diag(gram)[own] / n)
            inverse[own, own] = 1 / np.where(length > 0, length, 1)
            continue
        block = _factor(r[:, own])
        lengths = np.sqrt((r[:, own] ** 2).sum(axis=0))
        if (np.diag(block) <= RANK_SHARE * np.maximum(lengths, np.finfo(float).tiny)).any():
            raise ValueError(f"block {g} has not full rank")
        inverse[np.ix_(own, own)] = np.linalg.inv(block) * np.sqrt(n)
    found = Standard(n, mean, inverse)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(out)
            there = np.array(x.is_valid())
            flat = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = (flat - mean) @ inverse
            offsets = np.concatenate([[0], np.cumsum(there * width)])
            made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(z.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([made if name == out else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

    vector = F.col(column).cast("array<double>")
    ready = rows.withColumn(out, F.when(_whole(vector), vector))
    return ready.mapInArrow(turn, ready.schema), found
