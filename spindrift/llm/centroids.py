"""Exact k-means on whole-number vectors, with Elkan's bounds.

Each vector keeps an upper bound of the distance to its centroid and a lower bound for each
centroid. When centroids move, bounds move by as much, and a distance is computed only where
neither the bounds nor half the distance between two centroids rules it out (Elkan, 2003).
Squared distances are whole numbers and exact; bounds are their roots, rounded away from the
truth, and a centroid is ruled out only if it is strictly farther, so ties still go to the smaller
number and the result is that of a full search.

The bounds are written with the vectors after each round, in the shared folder: a round starts
from a table, whichever executors are lost. The driver holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, read, release_memory, settle

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Whole numbers beyond this are set to it, so that every squared distance fits in 63 bits.
LARGEST = 1 << 26
#: Vectors that are worked on at once.
SLICE_ROWS = 8192
_STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower array<double>, computed bigint"


def whole_numbers(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as int within ±``LARGEST``."""
    return F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(LARGEST).cast("bigint")), F.lit(-LARGEST).cast("bigint")).cast("int"))


def vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v of all rows with exactly ``size`` components, none null or non-finite; other rows and columns are left out."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == size) & F.coalesce(sound, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint"), whole_numbers(F.col("embedding"), scale).alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``, in that order; all of them if there are fewer.

    Rows of one vec_id are ordered by their components, a null vec_id stands last.
    """
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(named.alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.array([r.v for r in best], np.int64)


def _root_up(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(square.astype(np.float64)), np.inf)


def _root_down(square: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(square.astype(np.float64)), -np.inf), -np.inf), 0.0)


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper bound and lower bounds of each vector, from sound bounds, and how many distances were computed."""
    k = len(centroids)
    between = np.array([_squares(centroids, c) for c in centroids])
    half = _root_down(between) / 2  # halving is exact
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    open_ = ~(upper[:, None] < lower) & ~(upper[:, None] < half[cluster])
    open_[np.arange(len(x)), cluster] = False
    rows = np.flatnonzero(open_.any(axis=1))
    computed = len(rows)
    best = np.zeros(len(x), np.int64)
    best[rows] = _squares(x[rows], centroids[cluster[rows]])
    upper[rows] = _root_up(best[rows])
    lower[rows, cluster[rows]] = _root_down(best[rows])
    for j in range(k):
        at = rows[open_[rows, j]]
        at = at[(cluster[at] != j) & ~(upper[at] < lower[at, j]) & ~(upper[at] < half[cluster[at], j])]
        if not len(at):
            continue
        computed += len(at)
        square = _squares(x[at], centroids[j])
        lower[at, j] = _root_down(square)
        wins = (square < best[at]) | ((square == best[at]) & (j < cluster[at]))
        at, square = at[wins], square[wins]
        cluster[at], best[at], upper[at] = j, square, _root_up(square)
    return cluster, upper, lower, computed


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def assign(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Vectors with cluster and bounds, from plain vectors (``moved`` is None) or from the last round's rows.

    ``moved`` holds the squared distance that each centroid has moved since. ``computed`` counts
    the distances of a slice of vectors, on its first row.
    """
    executors_can_import(rows.sparkSession)
    k, width = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(low, SLICE_ROWS)
                n = batch.num_rows
                x = _matrix(batch.column("v"), np.int64, width)
                if moved is None:
                    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                else:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    far = _root_up(moved) * (moved > 0)
                    upper = np.nextafter(batch.column("upper").to_numpy() + far[cluster], np.inf)
                    lower = np.maximum(np.nextafter(_matrix(batch.column("lower"), np.float64, k) - far, -np.inf), 0.0)
                cluster, upper, lower, computed = nearest(x, centroids, cluster, upper, lower)
                counts = np.zeros(n, np.int64)
                counts[:1] = computed
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(x, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(counts)], names=["vec_id", "v", "cluster", "upper", "lower", "computed"])
            release_memory()

    return rows.mapInArrow(step, _STATE)


def _centred(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; an empty cluster keeps its centroid.

    Each task sums its own rows, so a cluster of most rows is no hot key.
    """
    k, width = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, x = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), np.int64, width)
            for j in np.unique(cluster):
                sums[j] += x[cluster == j].sum(axis=0)
            counts += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), _lists(sums, pa.int64())], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(partial, "cluster int, n bigint, sums array<bigint>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).where("n > 0")
    new = centroids.copy()
    for row in found.collect():  # a row for each centroid
        new[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
    return new


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Final rows (vec_id, v, cluster, upper, lower, computed) and centroids of ``rows`` (vec_id, v).

    Repeated and null vec_ids are vectors like others; fewer vectors than ``k`` give as many
    centroids, and no vectors an empty table. ``computed`` is the last pass's.
    """
    rows = settle(rows, "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], _STATE), centroids
    state = settle(assign(rows, centroids, None), "elkan")
    for _ in range(rounds):
        new = _centred(state, centroids)
        state, centroids = settle(assign(state, new, _squares(new, centroids)), "elkan"), new
    return state, centroids


def clustered(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of ``cluster_vectors``; distances anew and exact."""
    if not len(centroids):
        return state.selectExpr("vec_id", "cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    table = F.array(*(F.array(*(F.lit(int(c)) for c in row)) for row in centroids))
    d = F.zip_with("v", table[F.col("cluster")], lambda a, b: (a.cast("bigint") - b) * (a.cast("bigint") - b))
    rows = state.select("vec_id", "cluster", F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("distance"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1  # sums beyond a long say so by its largest value
    each = F.array(*(F.lit(min(sums.get(j, 0), most)).cast("bigint") for j in range(len(centroids))))
    named = F.array(*(F.lit(hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest()) for row in centroids))
    return rows.select("vec_id", "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"), F.lit(min(sum(sums.values()), most)).cast("bigint").alias("inertia"), named[F.col("cluster")].alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(*cluster_vectors(vectors(read(spark, sf_dir, "embeddings"))))


def _round(i: int) -> str:
    return f"""
a{i} AS (
    SELECT r, vec_id, v, c.j, list_sum(list_transform(list_zip(v, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i} c
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.j) = 1),
u{i} AS (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY j, i),
m{i} AS (SELECT j, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS w FROM u{i} GROUP BY j),
c{i + 1} AS (SELECT j, coalesce(m.w, c.w) AS w FROM c{i} c LEFT JOIN m{i} m USING (j)),"""


#: Every distance of every round.
ORACLE_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(least(floor(64 * x::DOUBLE), {LARGEST}), -{LARGEST})::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS w FROM kept QUALIFY j < 16),
{"".join(_round(i) for i in range(ROUNDS))}
final AS (
    SELECT r, vec_id, c.j, c.w, list_sum(list_transform(list_zip(v, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{ROUNDS} c
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.j) = 1)
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(w, ',')) AS centroid_sha256 FROM final
"""
