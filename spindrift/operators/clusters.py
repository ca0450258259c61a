"""How well clusters part: Calinski-Harabasz, Davies-Bouldin and silhouette, exact at any number of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each side that a task compares.
BLOCK_ROWS = 4_096
#: Pairs whose distance is taken from differences at a time.
NEAR_PAIRS = 1 << 16


def _usable(rows: DataFrame) -> DataFrame:
    """(cluster, v) of rows that have a cluster and a vector without nulls and non-finite numbers."""
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("cluster", v.alias("v")).where(F.col("cluster").isNotNull() & finite)


def moments(rows: DataFrame) -> DataFrame:
    """(cluster, n, centre, scatter) of ``rows`` (cluster, v): size, mean vector and summed squared distance to it.

    Each cluster's entries are summed up where the rows are read; only a row for each cluster and entry is shuffled.
    """
    each = _usable(rows).select("cluster", F.posexplode("v").alias("i", "x"))
    entries = each.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("s"))
    return entries.groupBy("cluster").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centre"), F.sum("s").alias("scatter")
    )  # as many entries as a vector has


def calinski_harabasz(found: DataFrame) -> DataFrame:
    """(n, clusters, calinski_harabasz) from ``moments``; null with one cluster, or as many as rows, or without scatter."""
    entries = found.select("cluster", "n", F.posexplode("centre").alias("i", "m"))
    # the spread of the centres about the mean of all, from sums that merge
    spread = entries.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    between = entries.join(F.broadcast(spread), "i").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"))  # a row for each entry
    totals = found.agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.sum("scatter").alias("within"))
    index = F.try_divide(F.col("between") * (F.col("n") - F.col("clusters")), F.col("within") * (F.col("clusters") - 1))
    return totals.crossJoin(between).select("n", "clusters", F.when(F.col("clusters") < F.col("n"), index).alias("calinski_harabasz"))  # a row each


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with a ``block`` in each pair of blocks (i <= j) that holds theirs."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    return other.withColumns({"i": F.least("block", "other").cast("int"), "j": F.greatest("block", "other").cast("int")}).drop("other")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; those too near for the product's precision are taken from differences."""
    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    squares = size - 2 * a @ b.T
    x, y = np.nonzero(squares < 1e-4 * size)
    for k in range(0, len(x), NEAR_PAIRS):
        p, q = x[k : k + NEAR_PAIRS], y[k : k + NEAR_PAIRS]
        squares[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def _by_blocks(rows: DataFrame, blocks: int, between: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``between(own, others, distances)`` for each two blocks, both ways; a task holds two blocks."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        block = pa.array(table["block"].to_numpy() == i)
        one, two = table.filter(block), table.filter(pa.array(table["block"].to_numpy() == j))
        if not len(one) or not len(two):
            return between(one.slice(0, 0), two.slice(0, 0), np.zeros((0, 0)))
        d = _distances(_matrix(one, "v"), _matrix(two, "v"))
        there = between(one, two, d)
        return there if i == j else pa.concat_tables([there, between(two, one, d.T)])

    return _dealt(rows, blocks).groupBy("i", "j").applyInArrow(compare, schema)


def davies_bouldin(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(davies_bouldin) of ``rows`` with their ``moments``; null with one cluster. Two clusters of one centre count as 0."""
    apart = F.aggregate(F.zip_with("v", "centre", lambda x, m: (x - m) ** 2), F.lit(0.0), lambda a, x: a + x)
    widths = _usable(rows).join(found.select("cluster", "centre"), "cluster").groupBy("cluster").agg(F.avg(F.sqrt(apart)).alias("width"))
    centres = found.select("cluster", F.col("centre").alias("v")).join(widths, "cluster")
    blocks = max(1, -(-found.count() // BLOCK_ROWS))
    dealt = centres.withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int"))

    def worst(own: pa.Table, others: pa.Table, d: np.ndarray) -> pa.Table:
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (own["width"].to_numpy()[:, None] + others["width"].to_numpy()) / d if d.size else d
        ratio = np.where(d > 0, ratio, 0.0)
        return pa.table({"name": own["name"], "worst": pa.array(ratio.max(axis=1) if ratio.size else np.zeros(0))})

    named = dealt.select(F.col("cluster").cast("string").alias("name"), "v", "width", "block")
    each = _by_blocks(named, blocks, worst, "name string, worst double").groupBy("name").agg(F.max("worst").alias("worst"))
    return each.agg(F.when(F.count("*") > 1, F.avg("worst")).alias("davies_bouldin"))


def silhouettes(rows: DataFrame) -> DataFrame:
    """(cluster, n, silhouette): each cluster's mean silhouette, exact, null if there is one cluster only.

    A row's silhouette is (b - a) / max(a, b), with a its mean distance to the others of its
    cluster and b the least mean distance to another one; 0 in a cluster of one row. Equal rows
    are merged and counted before anything is compared. Blocks hold neighbouring clusters, and
    a task gives, for each row of one block, the summed distances to each cluster of another, so
    no pairs leave it. Work grows with the square of the different rows.
    """
    merged = _usable(rows).groupBy("cluster", "v").agg(F.count("*").alias("copies"))
    merged = merged.withColumns({"name": F.col("cluster").cast("string"), "row": F.unhex(F.md5(F.concat_ws(" ", F.col("cluster").cast("string"), F.col("v").cast("string"))))})
    sizes = merged.groupBy("name").agg(F.count("*").alias("different"), F.sum("copies").alias("n"))
    places = sizes.withColumn("earlier", F.sum("different").over(Window.orderBy("name")) - F.col("different"))  # a row for each cluster
    blocks = max(1, -(-merged.count() // BLOCK_ROWS))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = merged.join(places, "name").withColumn("block", F.least(F.floor((F.col("earlier") + F.floor(share * F.col("different"))) / BLOCK_ROWS), F.lit(blocks - 1)).cast("int"))

    def sums(own: pa.Table, others: pa.Table, d: np.ndarray) -> pa.Table:
        kinds, of = np.unique(others["name"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(others) else (np.array([], str), np.array([], int))
        weights = np.zeros((len(others), len(kinds)))
        weights[np.arange(len(others)), of] = others["copies"].to_numpy()
        total = d @ weights if d.size else np.zeros((len(own), len(kinds)))
        k = len(kinds)
        return pa.table({
            "row": pa.array(np.repeat(np.array(own["row"].to_pylist(), object), k), pa.binary()), "name": pa.array(np.repeat(own["name"].to_numpy(zero_copy_only=False), k), pa.string()),
            "copies": pa.array(np.repeat(own["copies"].to_numpy(), k), pa.int64()), "other": pa.array(np.tile(kinds, len(own)), pa.string()), "total": pa.array(total.ravel()),
        })

    pieces = _by_blocks(placed.select("row", "name", "copies", "v", "block"), blocks, sums, "row binary, name string, copies bigint, other string, total double")
    totals = pieces.groupBy("row", "name", "copies", "other").agg(F.sum("total").alias("total"))
    met = totals.join(sizes.select(F.col("name").alias("other"), F.col("n").alias("m")), "other")
    own = F.col("name") == F.col("other")
    each = met.groupBy("row", "name", "copies").agg(
        F.max(F.when(own, F.col("m"))).alias("n"), F.max(F.when(own, F.try_divide(F.col("total"), F.col("m") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("m"))).alias("b")
    )
    silhouette = F.when(F.col("b").isNotNull(), F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))
    found = each.withColumn("s", silhouette).groupBy("name").agg(F.max("n").alias("n"), (F.sum(F.col("s") * F.col("copies")) / F.max("n")).alias("silhouette"))
    kind = rows.schema["cluster"].dataType
    return found.select(F.col("name").cast(kind).alias("cluster"), "n", "silhouette")


def indices(rows: DataFrame) -> DataFrame:
    """n, clusters, calinski_harabasz, davies_bouldin, silhouette of ``rows`` (cluster, v), one row.

    Rows without a cluster or with a vector that has nulls or non-finite numbers are left out.
    Vectors must be of one length. One cluster, or none, has no indices.
    """
    found = moments(rows)
    each = silhouettes(rows).agg((F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette"))
    return calinski_harabasz(found).crossJoin(davies_bouldin(rows, found)).crossJoin(each)  # a row each
