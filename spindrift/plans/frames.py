"""Queries on frame series: filters that keep the time axis, masks, shifts, condensing, shuffled copies, session decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.bins import md5_uniform
from spindrift.operators import decoding, joins, resampling
from spindrift.sources.tables import load, spikes

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's events as frames with covariates: x, y and a speed."""
    by = Window.partitionBy("unit").orderBy("us", "event_id")
    rows = spikes(spark, sf_dir, "event_id", "value").withColumn("frame", F.row_number().over(by) - 1)
    return rows.select("unit", "event_id", "us", "frame", F.col("value").alias("x"), F.pmod(F.col("value") * 13, F.lit(97.0)).alias("y"), F.pmod(F.col("value") * 3, F.lit(50.0)).alias("speed"))


def masked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, circle and split filters: what they exclude becomes null, so no frame is lost."""
    inside = F.pow(F.col("x") - 100, 2) + F.pow(F.col("y") - 50, 2) <= 80 * 80
    keep = F.col("speed").between(5, 40) & inside & F.col("x").between(20, 180)
    rows = _frames(spark, sf_dir).select("unit", "frame", F.when(keep, F.col("x")).alias("x"))
    return rows.groupBy("unit").agg(F.count("*").alias("frames"), F.count("x").alias("valid"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.max("x"), 6).alias("max_x"))


def complete_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which every covariate is there and some isn't zero."""
    rows = _frames(spark, sf_dir).select("unit", F.when(F.col("speed") > 10, F.col("x")).alias("x"), F.when(F.col("x") < 150, F.col("y")).alias("y"))
    return rows.dropna(how="any").where(F.exists(F.array("x", "y"), lambda v: v != 0)).groupBy("unit").agg(F.count("*").alias("n"))


def session_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes inside any of some closed intervals, as frames rounded half to even; each counts once."""
    intervals = spark.createDataFrame([(2 * DAY, 6 * DAY), (5 * DAY, 9 * DAY), (20 * DAY, 21 * DAY)], "lo long, hi long")
    rows = spikes(spark, sf_dir, "event_id")
    inside = rows.join(F.broadcast(intervals), F.col("us").between(F.col("lo"), F.col("hi")), "left_semi")  # three intervals
    return inside.select("event_id", "unit", F.rint((F.col("us") - 2 * DAY) / float(HOUR)).cast("bigint").alias("frame"))


def glm_bins_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two binned covariates with more than a least number of frames, counted from the lowest cell."""
    rows = load(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice").select(F.floor(F.col("l_quantity") / 5).alias("ix"), F.floor(F.col("l_extendedprice") / 10000).alias("iy"))
    low = rows.agg(F.min("ix").alias("x0"), F.min("iy").alias("y0"))
    cells = rows.groupBy("ix", "iy").agg(F.count("*").alias("n")).where("n > 100")
    return cells.crossJoin(low).select((F.col("ix") - F.col("x0")).alias("ix"), (F.col("iy") - F.col("y0")).alias("iy"), "n")


def glm_bins_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as indicators of 15 half-open bins: how many each bin has, and how many lie in none."""
    at = F.floor(F.col("l_extendedprice") / 5000).cast("int")
    rows = load(spark, sf_dir, "lineitem", "l_extendedprice").select(F.when(at.between(0, 14), at).alias("bin"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.coalesce((F.col("bin") == i).cast("int"), F.lit(0)))
    return rows.select(F.posexplode(hot).alias("bin", "one")).groupBy("bin").agg(F.sum("one").alias("n"))


def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates moved against spikes by three frames to either side."""
    by = Window.partitionBy("unit").orderBy("frame")
    rows = _frames(spark, sf_dir)
    return rows.select("unit", "frame", F.round(F.lag("x", 3).over(by), 6).alias("later"), F.round(F.lead("x", 3).over(by), 6).alias("earlier"))


def permuted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes and covariates of each unit in one random order of frames, the same for both."""
    rows = _frames(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("unit").orderBy(md5_uniform(F.lit("permute"), "event_id"), "event_id")) - 1
    return rows.select("unit", place.cast("int").alias("place"), "frame", F.round("x", 6).alias("x"))


def origin_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths moved so that each unit's least x and y are 0, in centimetres."""
    by = Window.partitionBy("unit")
    rows = _frames(spark, sf_dir)
    return rows.select("unit", "frame", F.round((F.col("x") - F.min("x").over(by)) * 100, 4).alias("x"), F.round((F.col("y") - F.min("y").over(by)) * 100, 4).alias("y"))


def condensed_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by day of each unit and of its shifted copies, in sparse form: days without spikes have no row."""
    rows = spikes(spark, sf_dir)
    copies = resampling.shifted_trains(rows, resampling.shifts(spark, 4, 20 * HOUR, 60 * HOUR), 30 * DAY)
    both = rows.withColumn("shuffle_id", F.lit(-1)).unionByName(copies.select("unit", "us", "shuffle_id"))
    return both.groupBy("unit", "shuffle_id", F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"))


def condensed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames condensed by five: spikes summed, a signal on if at least half is, covariates averaged; a partial last block is dropped."""
    rows = _frames(spark, sf_dir).withColumns({"block": F.floor(F.col("frame") / 5), "on": (F.col("speed") > 25).cast("int")})
    found = rows.groupBy("unit", "block").agg(F.count("*").alias("k"), F.sum("on").alias("s"), F.round(F.avg("x"), 6).alias("x"))
    return found.where("k = 5").select("unit", "block", (F.col("s") >= 2.5).cast("int").alias("on"), "x")


def mean_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each unit's signal from two frames before to three after its loud frames."""
    rows = _frames(spark, sf_dir)
    loud = rows.where("x > 60").select("unit", F.col("frame").alias("at"), F.explode(F.sequence(F.lit(-2), F.lit(3))).alias("rel")).withColumn("frame", F.col("at") + F.col("rel"))
    return loud.join(rows.select("unit", "frame", "x"), ["unit", "frame"]).groupBy("unit", "rel").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("mean"))


def session_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two sessions the third resembles: its vectors take the label of the nearest training vector."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3).alias("session"))
    train = rows.where("session < 2").select("id", "v", (1 - F.col("session")).cast("int").alias("label"))
    found = decoding.nearest(train, rows.where("session = 2"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("accuracy"))


def decoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, standard error and percentile band over runs, and the range over sessions."""
    rows = load(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_discount").withColumn("v", F.col("l_discount") * 10)
    found = rows.groupBy("l_linenumber", "l_returnflag").agg(F.avg("v").alias("m"), F.expr("percentile(v, array(0.005, 0.995))").alias("p"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("e"))
    return found.groupBy("l_linenumber").agg(
        F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"), F.round(F.max("e"), 6).alias("sem"), F.round(F.min(F.col("p")[0]), 6).alias("low"), F.round(F.max(F.col("p")[1]), 6).alias("high")
    )


def merged_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensor variants of the same frames side by side, the second's columns under a prefix; their keys must agree."""
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice").groupBy("l_orderkey")
    one, two = items.agg(F.sum("l_quantity").alias("total")), items.agg(F.round(F.sum("l_extendedprice"), 2).alias("cf_total"))
    return joins.merged(one, two, ["l_orderkey"])


def session_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the same unit in three sessions, the first of each, side by side."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    one = joins.first_rows(orders, ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")], 1)
    parts = [one.where(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderkey").alias(name)) for s, name in (("F", "first"), ("O", "second"), ("P", "third"))]
    return parts[0].join(parts[1], "o_custkey").join(parts[2], "o_custkey")


def tuning_by_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative occupancy of each bin beside the units whose fullest bin it is; joined by bin number."""
    bins = _frames(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("x") / 20), F.lit(24)).cast("int"))
    occ = bins.groupBy("bin").agg(F.count("*").alias("frames"))
    counts = bins.groupBy("unit", "bin").agg(F.count("*").alias("n"))
    peaks = counts.groupBy("unit").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m")).groupBy((-F.col("m.b")).alias("bin")).agg(F.count("*").alias("peaks"))
    return occ.join(peaks, "bin", "left").select("bin", "frames", F.coalesce("peaks", F.lit(0)).alias("peaks"))


QUERIES = {
    f.__name__: f
    for f in (
        masked_frames, complete_frames, session_mask, glm_bins_2d, glm_bins_1d, time_shift, permuted_frames, origin_shift, condensed_shuffles, condensed_features, mean_waveform, session_decoder,
        decoding_summary, merged_variants, session_triples, tuning_by_occupancy,
    )
}

_E = "e AS (SELECT event_id, user_id AS unit, value, epoch_us(ts) - 1704067200000000 AS us FROM events)"
_FR = f"""{_E}, f AS (SELECT unit, event_id, us, (row_number() OVER (PARTITION BY unit ORDER BY us, event_id) - 1)::INT AS frame, value AS x, (value * 13) % 97 AS y, (value * 3) % 50 AS speed FROM e)"""
_U = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0"

ORACLE_SQL = {
    "masked_frames": f"""
        WITH {_FR}, m AS (SELECT unit, CASE WHEN speed BETWEEN 5 AND 40 AND pow(x - 100, 2) + pow(y - 50, 2) <= 6400 AND x BETWEEN 20 AND 180 THEN x END AS x FROM f)
        SELECT unit, count(*) AS frames, count(x) AS valid, round(avg(x), 6) AS mean_x, round(max(x), 6) AS max_x FROM m GROUP BY unit""",
    "complete_frames": f"WITH {_FR} SELECT unit, count(*) AS n FROM f WHERE speed > 10 AND x < 150 AND (x <> 0 OR y <> 0) GROUP BY unit",
    "session_mask": f"""
        WITH {_E} SELECT event_id, unit, round_even((us - {2 * DAY}) / {HOUR}.0::DOUBLE, 0)::BIGINT AS frame FROM e
        WHERE us BETWEEN {2 * DAY} AND {6 * DAY} OR us BETWEEN {5 * DAY} AND {9 * DAY} OR us BETWEEN {20 * DAY} AND {21 * DAY}""",
    "glm_bins_2d": """
        WITH r AS (SELECT floor(l_quantity / 5)::BIGINT AS ix, floor(l_extendedprice / 10000)::BIGINT AS iy FROM lineitem)
        SELECT ix - (SELECT min(ix) FROM r) AS ix, iy - (SELECT min(iy) FROM r) AS iy, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 100""",
    "glm_bins_1d": "SELECT i::INT AS bin, (SELECT count(*) FROM lineitem WHERE floor(l_extendedprice / 5000) = i) AS n FROM range(15) r(i)",
    "time_shift": f"WITH {_FR} SELECT unit, frame, round(lag(x, 3) OVER w, 6) AS later, round(lead(x, 3) OVER w, 6) AS earlier FROM f WINDOW w AS (PARTITION BY unit ORDER BY frame)",
    "permuted_frames": f"""WITH {_FR} SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY {_U("'permute|' || event_id")}, event_id) - 1)::INT AS place, frame, round(x, 6) AS x FROM f""",
    "origin_shift": f"WITH {_FR} SELECT unit, frame, round((x - min(x) OVER w) * 100, 4) AS x, round((y - min(y) OVER w) * 100, 4) AS y FROM f WINDOW w AS (PARTITION BY unit)",
    "condensed_shuffles": f"""
        WITH {_E}, l AS (SELECT i::INT AS k, ({20 * HOUR} + floor({_U("'shift|' || i")} * {40 * HOUR}))::BIGINT AS lag FROM range(4) r(i)),
        b AS (SELECT unit, -1 AS k, us FROM e UNION ALL SELECT unit, k, us + lag FROM e CROSS JOIN l WHERE us + lag < {30 * DAY})
        SELECT unit, k AS shuffle_id, us // {DAY} AS day, count(*) AS n FROM b GROUP BY ALL""",
    "condensed_features": f"""
        WITH {_FR}, b AS (SELECT unit, (frame // 5)::BIGINT AS block, count(*) AS k, sum((speed > 25)::INT) AS s, round(avg(x), 6) AS x FROM f GROUP BY ALL)
        SELECT unit, block, (s >= 2.5)::INT AS "on", x FROM b WHERE k = 5""",
    "mean_waveform": f"""
        WITH {_FR} SELECT a.unit, r::INT AS rel, count(*) AS n, round(avg(b.x), 9) AS mean FROM f a CROSS JOIN range(-2, 4) t(r) JOIN f b ON b.unit = a.unit AND b.frame = a.frame + r WHERE a.x > 60 GROUP BY ALL""",
    "session_decoder": """
        WITH v AS (SELECT vec_id AS id, vec_id % 3 AS s, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT *, list_transform(e, lambda x: x - list_avg(e)) AS c FROM v),
        u AS (SELECT id, s, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM c),
        p AS (SELECT b.id, 1 - a.s AS label, row_number() OVER (PARTITION BY b.id ORDER BY list_dot_product(a.u, b.u) DESC, a.id) AS k FROM u a JOIN u b ON a.s < 2 AND b.s = 2)
        SELECT count(*) AS n, round(avg(label), 6) AS accuracy FROM p WHERE k = 1""",
    "decoding_summary": """
        WITH s AS (SELECT l_linenumber, l_returnflag, avg(l_discount * 10) AS m, quantile_cont(l_discount * 10, 0.005) AS lo, quantile_cont(l_discount * 10, 0.995) AS hi, stddev_samp(l_discount * 10) / sqrt(count(*)) AS e FROM lineitem GROUP BY ALL)
        SELECT l_linenumber, round(min(m), 6) AS least, round(max(m), 6) AS most, round(max(e), 6) AS sem, round(min(lo), 6) AS low, round(max(hi), 6) AS high FROM s GROUP BY l_linenumber""",
    "merged_variants": "SELECT l_orderkey, sum(l_quantity) AS total, round(sum(l_extendedprice), 2) AS cf_total FROM lineitem GROUP BY ALL",
    "session_triples": """
        WITH o AS (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY ALL)
        SELECT a.o_custkey, a.k AS first, b.k AS second, c.k AS third FROM o a JOIN o b USING (o_custkey) JOIN o c USING (o_custkey) WHERE a.s = 'F' AND b.s = 'O' AND c.s = 'P'""",
    "tuning_by_occupancy": f"""
        WITH {_FR}, b AS (SELECT unit, least(floor(x / 20), 24)::INT AS bin FROM f), c AS (SELECT unit, bin, count(*) AS n FROM b GROUP BY ALL),
        p AS (SELECT bin, count(*) AS peaks FROM (SELECT unit, bin, row_number() OVER (PARTITION BY unit ORDER BY n DESC, bin) AS k FROM c) WHERE k = 1 GROUP BY bin)
        SELECT o.bin, frames, coalesce(peaks, 0) AS peaks FROM (SELECT bin, count(*) AS frames FROM b GROUP BY bin) o LEFT JOIN p USING (bin)""",
}
