"""Decoding by nearest population vectors, components, clusters, classification scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.bins import md5_uniform, ratio

#: Vectors of each side that a task compares.
BLOCK_ROWS = 4096


def nearest(train: DataFrame, test: DataFrame, measure: str = "pearson") -> DataFrame:
    """For each row of ``test`` (id, v) the row of ``train`` (id, v, label) that is nearest: id, nearest, score, label.

    ``pearson``: the largest correlation across the vector's entries, -1 where a side is constant;
    ``euclid``: the least distance. Ties take the lowest training id. Both sides are dealt to
    blocks; a task compares a block of one side with a block of the other by a matrix product
    and gives each test row's best of that block, of which the best is taken.
    """
    blocks_of = lambda rows: max(1, -(-rows.count() // BLOCK_ROWS))
    n_train, n_test = blocks_of(train), blocks_of(test)

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return rows.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})

    known = dealt(train.select("id", "v", F.col("label").cast("int").alias("label"), F.lit(False).alias("asked")), "i", n_train, "j", n_test)
    asked = dealt(test.select("id", "v", F.lit(None).cast("int").alias("label"), F.lit(True).alias("asked")), "j", n_test, "i", n_train)

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ask = table["asked"].to_numpy()
        vectors = np.array(table["v"].to_pylist(), float).reshape(len(table), -1)
        ids, labels, q, v = table["id"].to_numpy(), table["label"].to_numpy(zero_copy_only=False)[~ask], vectors[ask], vectors[~ask]
        if not len(q) or not len(v):
            return pa.table({name: pa.array([], kind) for name, kind in (("id", pa.int64()), ("nearest", pa.int64()), ("score", pa.float64()), ("label", pa.int32()))})
        if measure == "pearson":
            score = _standardised(q) @ _standardised(v).T
            score = np.where(np.isnan(score), -1.0, score)
            at = score.argmax(axis=1)
        else:
            score = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ v.T + (v * v).sum(axis=1), 0))
            at = score.argmin(axis=1)
        label = pa.array([None if np.isnan(x) else int(x) for x in labels[at].astype(float)], pa.int32())
        return pa.table({"id": pa.array(ids[ask], pa.int64()), "nearest": pa.array(ids[~ask][at], pa.int64()), "score": pa.array(score[np.arange(len(q)), at]), "label": label})

    found = known.unionByName(asked).groupBy("i", "j").applyInArrow(best, "id bigint, nearest bigint, score double, label int")
    signed = -F.col("score") if measure == "pearson" else F.col("score")
    return found.groupBy("id").agg(F.min(F.struct(signed.alias("s"), "nearest", "label", "score")).alias("b")).select("id", F.col("b.nearest").alias("nearest"), F.col("b.score").alias("score"), F.col("b.label").alias("label"))


def _standardised(v: np.ndarray) -> np.ndarray:
    v = v - v.mean(axis=1, keepdims=True)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)


def sampled_runs(train: DataFrame, test: DataFrame, runs: int, entries: int, shuffles: int, measure: str = "pearson") -> DataFrame:
    """run, shuffle_id, n, accuracy of ``nearest`` on ``entries`` entries of the vectors, drawn anew for each run.

    The labels of ``train`` are also shuffled among its rows, ``shuffles`` times; shuffle -1 has the true ones.
    """
    spark, width = train.sparkSession, (train.select(F.size("v").alias("n")).head() or [0])[0]
    chosen = spark.range(runs).select(F.col("id").cast("int").alias("run")).crossJoin(spark.range(width).select(F.col("id").cast("int").alias("i")))  # runs x entries
    order = Window.partitionBy("run").orderBy(md5_uniform(F.lit("entry"), "run", "i"), "i")
    chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries).groupBy("run").agg(F.sort_array(F.collect_list("i")).alias("at")).orderBy("run").collect()
    found = None
    for run, at in chosen:
        part = lambda rows, at=at: rows.withColumn("v", F.array(*(F.col("v")[i] for i in at)))
        one = nearest(part(train), part(test), measure).select(F.lit(run).alias("run"), "id", "nearest")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("shuffle_id").orderBy("by", "id"))
    copies = train.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle_id"))
    drawn = copies.withColumn("by", md5_uniform(F.lit("labels"), "shuffle_id", "id")).select("shuffle_id", place.alias("place"), "label")
    rows = copies.withColumn("by", F.lit(0)).select("shuffle_id", place.alias("place"), "id")
    labels = rows.join(drawn, ["shuffle_id", "place"]).select("shuffle_id", "id", "label").unionByName(train.select(F.lit(-1).alias("shuffle_id"), "id", "label"))
    met = found.join(labels.withColumnRenamed("id", "nearest"), "nearest").join(test.select("id", F.col("label").alias("truth")), "id")
    return met.groupBy("run", "shuffle_id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return predicted.join(truth.select("id", F.col("label").alias("truth")), "id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))


def principal_components(rows: DataFrame, k: int, standardise: bool = False) -> tuple[DataFrame, list[float]]:
    """(id, scores) on the first k components of ``rows`` (id, v), centred; and each component's share of the variance."""
    n = F.size(F.first("v")).alias("n")
    width = rows.agg(n).head()["n"]
    stats = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row for each entry
    mean = F.array(*(F.lit(float(r.m)) for r in stats[:width]))
    scale = F.array(*(F.lit(float(r.s) if standardise and r.s else 1.0) for r in stats[:width]))
    centred = F.transform(F.arrays_zip(F.col("v").alias("x"), mean.alias("m"), scale.alias("s")), lambda z: ((z["x"] - z["m"]) / z["s"]).cast("double"))
    ready = rows.select("id", array_to_vector(centred).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(ready)
    return model.transform(ready).select("id", vector_to_array("pc").alias("scores")), [float(x) for x in model.explainedVariance]


def knee(shares: list[float]) -> int:
    """Number of components at the knee of the cumulated shares: the point farthest from the chord."""
    y = np.cumsum(shares)
    x = np.arange(len(y))
    if len(y) < 3:
        return len(y)
    chord = y[0] + (y[-1] - y[0]) * x / x[-1]
    return int((y - chord).argmax()) + 1


def size_ranked_clusters(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) of k-means on ``rows`` (id, v): clusters are numbered by size, the largest first."""
    ready = rows.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="raw").fit(ready).transform(ready).select("id", "raw")
    sizes = found.groupBy("raw").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)
    return found.join(F.broadcast(sizes.select("raw", "cluster")), "raw").select("id", "cluster")  # k rows


def roc_points(scores: DataFrame, y: str, yhat: str, thresholds: int = 100) -> DataFrame:
    """(step, threshold, tpr, fpr) at evenly spaced thresholds in [0, 1], a score counting as positive from there on.

    Each row falls into one step, so the rows are aggregated once and the steps cumulated.
    """
    at = F.least(F.greatest(F.floor(F.col(yhat) * (thresholds - 1) + 1e-12), F.lit(-1)), F.lit(thresholds - 1)).cast("int")
    counts = scores.select(at.alias("step"), (F.col(y) > 0).cast("int").alias("y")).groupBy("step").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = scores.sparkSession.range(-1, thresholds).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").fillna(0)
    by = Window.orderBy(F.desc("step"))  # one row for each threshold
    rates = grid.select("step", F.sum("pos").over(by).alias("tp"), F.sum("neg").over(by).alias("fp"))
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return rates.crossJoin(totals).where("step >= 0").select("step", (F.col("step") / F.lit(thresholds - 1.0)).alias("threshold"), ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n")).alias("fpr"))


def area_under(points: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """Area by trapezoids along ``order``; x must be monotone there."""
    by = Window.orderBy(order)
    return points.select(F.abs(F.col(x) - F.lag(x).over(by)).alias("dx"), ((F.col(y) + F.lag(y).over(by)) / 2).alias("h")).agg(F.sum(F.col("dx") * F.col("h")).alias("auc"))


def bernoulli_scores(rows: DataFrame, keys: list[str], y: str, mu: str, null_mu: str) -> DataFrame:
    """Deviance, pseudo-R2, log-likelihood ratio, accuracy, and Cox-Snell, Nagelkerke and Tjur scores."""

    def clipped(c: str):
        return F.when(F.col(c) <= 0, 1e-10).when(F.col(c) >= 1, 1 - 1e-10).otherwise(F.col(c))

    def loglik(m):
        return F.sum(F.col(y) * F.log(m) + (1 - F.col(y)) * F.log(1 - m))

    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).cast("bigint").alias("n_spikes"), loglik(clipped(mu)).alias("l1"), loglik(clipped(null_mu)).alias("l0"),
        F.avg(((F.col(mu) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
        (F.avg(F.when(F.col(y) == 1, F.col(mu))) - F.avg(F.when(F.col(y) == 0, F.col(mu)))).alias("tjur"),
    )
    l1, l0, n = F.col("l1"), F.col("l0"), F.col("n")
    cox = 1 - F.exp(2 * (l0 - l1) / n)
    return sums.select(
        *keys, "n", "n_spikes", (-2 * l1).alias("deviance"), (1 - ratio(l1, l0)).alias("pseudo_r2"), (2 * (l1 - l0)).alias("llr"), ratio(2 * (l1 - l0), F.col("n_spikes")).alias("llr_per_spike"),
        "accuracy", cox.alias("cox_snell"), ratio(cox, 1 - F.exp(2 * l0 / n)).alias("nagelkerke"), "tjur",
    )
