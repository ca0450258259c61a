"""Rank tests, permutation tests and resampling, on portable pseudo-random numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.bins import md5_uniform, ratio
from spindrift.functions.places import settled
from spindrift.operators import joins
from spindrift.operators.pairs import average_rank


def normal_tail(z: Column) -> Column:
    """P(Z > z), to 7.5e-8 (Abramowitz and Stegun, 26.2.17)."""
    # fixed values of that formula
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = sum((c * F.pow(t, F.lit(i + 1)) for i, c in enumerate(b)), F.lit(0.0))
    tail = F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def signed_rank(pairs: DataFrame, keys: list[str], x: str, y: str, zeros: str = "drop") -> DataFrame:
    """Wilcoxon signed-rank sums of x - y: n, w_plus, w_minus, z, p_two_sided, p_greater (normal approximation, ties corrected).

    ``zeros``: ``drop`` leaves out equal pairs; ``split`` ranks them and gives half to each side.
    """
    rows = pairs.select(*keys, (F.col(x) - F.col(y)).alias("d")).where("d IS NOT NULL")
    if zeros == "drop":
        rows = rows.where("d <> 0")
    ranked = average_rank(rows.withColumn("size", F.abs("d")), keys, "size", "rank")
    ties = ranked.groupBy(*keys, "size").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    half = F.when(F.col("d") == 0, F.col("rank") / 2).otherwise(0.0)
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(half)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(half)).alias("w_minus"),
        F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("zeros"),
    )
    found = sums.join(ties, keys) if keys else sums.crossJoin(ties)
    n = F.col("n")
    spread = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = ratio(F.col("w_plus") - n * (n + 1) / 4.0, F.sqrt(F.greatest(spread, F.lit(0.0))))
    found = found.withColumn("z", z)
    return found.select(*keys, "n", "w_plus", "w_minus", "z", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))).alias("p_two_sided"), normal_tail(F.col("z")).alias("p_greater"))


def signed_rank_exact_greater(differences: list[float]) -> float:
    """Exact one-sided p of the signed-rank test for few values: all signs are enumerated by rank sums."""
    values = sorted((abs(d), d > 0) for d in differences if d)
    if not values:
        return 1.0
    ranks, i = [], 0
    while i < len(values):
        j = i
        while j < len(values) and values[j][0] == values[i][0]:
            j += 1
        ranks += [i + j + 1] * (j - i)  # twice the mean rank
        i = j
    plus = sum(r for r, (_, up) in zip(ranks, values, strict=True) if up)
    ways = {0: 1}
    for r in ranks:
        more = dict(ways)
        for s, n in ways.items():
            more[s + r] = more.get(s + r, 0) + n
        ways = more
    return sum(n for s, n in ways.items() if s >= plus) / 2 ** len(ranks)


def mann_whitney(rows: DataFrame, keys: list[str], group: str, value: str, first: str, second: str) -> DataFrame:
    """U of group ``first`` against ``second``, with the tie-corrected normal approximation."""
    two = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranked = average_rank(two, keys, value, "rank")
    ties = ranked.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*keys).agg(
        F.count(F.when(F.col(group) == first, 1)).alias("n1"), F.count(F.when(F.col(group) == second, 1)).alias("n2"), F.sum(F.when(F.col(group) == first, F.col("rank"))).alias("r1")
    )
    found = sums.join(ties, keys) if keys else sums.crossJoin(ties)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    found = found.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    n = n1 + n2
    spread = n1 * n2 / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1)))
    return found.withColumn("z", ratio(F.col("u") - n1 * n2 / 2, F.sqrt(spread))).select(*keys, "n1", "n2", "u", "z", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))).alias("p"))


def swap_test(pairs: DataFrame, keys: list[str], test: str, ref: str, row_id: str, shuffles: int, salt: str = "swap") -> DataFrame:
    """Paired label-swap permutation test of mean(ref - test): each shuffle turns each pair by a coin of its own.

    Returns keys, true_diff, null_mean, null_std, z, p (one-sided, folded below 0.5).
    """
    d = pairs.select(*keys, F.col(row_id).alias("row"), (F.col(ref) - F.col(test)).alias("d")).where("d IS NOT NULL")
    true = d.groupBy(*keys).agg(F.avg("d").alias("true_diff"))
    coins = d.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    turned = coins.withColumn("d", F.when(md5_uniform(F.lit(salt), "shuffle_id", "row") < 0.5, -F.col("d")).otherwise(F.col("d")))
    sums = turned.groupBy(*keys, "shuffle_id").agg(F.sum("d").alias("t"), F.count("*").alias("n"))  # of equal numbers of pairs
    null = sums.groupBy(*keys).agg((F.sum("t") / F.sum("n")).alias("null_mean"), F.stddev_pop(F.col("t") / F.col("n")).alias("null_std"))
    found = true.join(null, keys) if keys else true.crossJoin(null)
    found = found.withColumn("z", ratio(F.col("true_diff") - F.col("null_mean"), F.col("null_std")))
    p = normal_tail(F.col("z"))
    return found.withColumn("p", F.when(p >= 0.5, 1 - p).otherwise(p))


def shifts(spark: SparkSession, n: int, low_us: int, high_us: int, salt: str = "shift") -> DataFrame:
    """(shuffle_id, lag_us): lags drawn evenly from [low, high)."""
    ids = spark.range(n).select(F.col("id").cast("int").alias("shuffle_id"))
    return ids.withColumn("lag_us", (F.lit(low_us) + F.floor(md5_uniform(F.lit(salt), "shuffle_id") * (high_us - low_us))).cast("bigint"))


def shifted_trains(spikes: DataFrame, lags: DataFrame, stop_us: int) -> DataFrame:
    """Each train moved by each lag, without wrapping; what passes the end is cut off."""
    return spikes.crossJoin(F.broadcast(lags)).withColumn("us", F.col("us") + F.col("lag_us")).where(F.col("us") < stop_us)  # a fixed number of lags


def jittered(spikes: DataFrame, n: int, half_us: int, row_id: str, salt: str = "jitter") -> DataFrame:
    """``n`` copies of each train, each spike moved by its own even draw from [-half, half)."""
    copies = spikes.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.withColumn("us", F.col("us") + F.floor((md5_uniform(F.lit(salt), "shuffle_id", row_id) * 2 - 1) * half_us).cast("bigint"))


def drawn_pairs(units: DataFrame, unit: str, kind: Callable[[str, str], Column], quotas: dict[str, int], shuffles: int, salt: str = "null", rounds: int = 3) -> DataFrame:
    """(shuffle_id, kind, a, b): for each shuffle, ``quotas`` pairs of each kind, drawn at random without replacement.

    ``kind`` gives the kind of a pair from the prefixes of its two units' columns (``one.`` and
    ``two.``). Numbers of pairs are drawn, not pairs made: the number tells the places of the two
    units, a < b. Draws that repeat a pair or find no quota left are passed over. Where quotas
    stay open there are eight times as many draws; after ``rounds`` of these all pairs are made
    and the open quotas are sampled from them.
    """
    spark, wanted = units.sparkSession, shuffles * sum(quotas.values())
    placed = settled(joins.numbered_rows(units, unit), "places")
    n = placed.count()
    pairs = n * (n - 1) // 2
    limits = F.create_map(*(F.lit(x) for item in quotas.items() for x in item))
    sides = [placed.select(F.struct(*units.columns).alias(side), F.col("i").alias(at)) for side, at in (("one", "i"), ("two", "j"))]

    def filled(numbered: DataFrame) -> DataFrame:
        """``numbered``: shuffle_id, i, j, by; the earliest of each kind."""
        met = numbered.join(sides[0], "i").join(sides[1], "j").select("shuffle_id", kind("one.", "two.").alias("kind"), F.col(f"one.{unit}").alias("a"), F.col(f"two.{unit}").alias("b"), "by")
        first = met.where(F.col("kind").isin(list(quotas))).groupBy("shuffle_id", "kind", "a", "b").agg(F.min("by").alias("by"))
        nth = F.row_number().over(Window.partitionBy("shuffle_id", "kind").orderBy("by", "a", "b"))
        return first.withColumn("nth", nth).where(F.col("nth") <= limits[F.col("kind")]).select("shuffle_id", "kind", "a", "b")

    draws = 20 * sum(quotas.values())
    before = lambda i: i * F.lit(n) - F.floor(i * (i + 1) / 2)
    for _ in range(rounds if pairs else 0):
        rows = spark.range(shuffles * draws).select(F.floor(F.col("id") / draws).cast("int").alias("shuffle_id"), (F.col("id") % draws).alias("draw"))
        u = md5_uniform(F.lit(salt), "shuffle_id", "draw") + md5_uniform(F.lit(salt), "shuffle_id", "draw", F.lit("fine")) / 4294967296.0
        rows = rows.withColumn("nth", F.least(F.floor(u * pairs), F.lit(pairs - 1)))
        guess = F.floor((F.lit(2 * n - 1) - F.sqrt(F.lit(float(2 * n - 1)) ** 2 - 8.0 * F.col("nth"))) / 2)
        rows = rows.withColumn("i", guess).withColumn("i", F.when(before(F.col("i")) > F.col("nth"), F.col("i") - 1).when(before(F.col("i") + 1) <= F.col("nth"), F.col("i") + 1).otherwise(F.col("i")))
        found = settled(filled(rows.select("shuffle_id", "i", (F.col("nth") - before(F.col("i")) + F.col("i") + 1).alias("j"), F.col("draw").cast("double").alias("by"))), "drawn")
        if found.count() == wanted:
            return found
        draws *= 8
    numbered = placed.where("i < n - 1").select("i", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"))
    numbered = numbered.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    return filled(numbered.withColumn("by", md5_uniform(F.lit(salt), "shuffle_id", "i", "j")))
