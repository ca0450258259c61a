"""Queries on covariates: range joins, occupancy, rate maps, information, tuning, histograms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.bins import bin_of, ratio
from spindrift.operators import joins, maps, signal
from spindrift.operators.resampling import shifts
from spindrift.sources.tables import load, spikes

#: Occupancy of a bin counts from this many seconds on; a line item stands for a frame of 0.1 s.
LEAST_OCC, FRAME_S = 0.4, 0.1


def area_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by area: half-open ranges of sizes, the first that fits; sizes outside all ranges are dropped."""
    areas = spark.createDataFrame([("V1", 1, 12, 0), ("V2M", 10, 25, 1), ("WhMa", 25, 40, 2), ("A1", 40, 48, 3)], "area string, ch_lo int, ch_hi int, rank int")
    placed = joins.first_range(load(spark, sf_dir, "part", "p_partkey", "p_size"), areas, ["p_partkey"], "p_size")
    return placed.groupBy("area").agg(F.count("*").alias("n"), F.min("p_size").alias("lowest"), F.max("p_size").alias("highest"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames: two covariates, a session, and whether the unit (the ship mode's flag) fired."""
    rows = load(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return rows.select(
        (F.col("l_suppkey") % 10).cast("int").alias("unit"), F.col("l_returnflag").alias("session"), F.col("l_quantity").alias("q"),
        bin_of(F.col("l_quantity"), 0, 50, 10).alias("bin"), bin_of(F.col("l_extendedprice"), 900, 105000, 8).alias("by"), bin_of(F.col("l_discount"), -0.005, 0.105, 11).alias("bd"),
    )


def occupancy_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in each bin of quantity and each session, and the share of the session."""
    from pyspark.sql import Window

    occ = maps.occupancy(_frames(spark, sf_dir), ["session", "bin"], FRAME_S)
    return occ.select("session", "bin", F.round("occ", 6).alias("occ"), F.round(F.col("occ") / F.sum("occ").over(Window.partitionBy("session")), 6).alias("share"))


def _map_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return maps.rate_map(frames.where("session = 'R'"), maps.occupancy(frames, ["bin"], FRAME_S), ["unit"], ["bin"])


def ratemap_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maps.smooth(_map_1d(spark, sf_dir), ["unit"], ["bin"], [1.0])
    return found.select("unit", "bin", F.round("raw", 5).alias("raw"), F.round("smoothed", 5).alias("smoothed"))


def ratemap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two covariates; smoothing goes over bins with enough occupancy only."""
    frames = _frames(spark, sf_dir).dropna(subset=["bin", "by"])
    rates = maps.rate_map(frames.where("session = 'R'"), maps.occupancy(frames, ["bin", "by"], FRAME_S), ["unit"], ["bin", "by"])
    rates = rates.withColumn("raw", F.when(F.col("occ") < LEAST_OCC, 0.0).otherwise(F.col("raw")))
    found = maps.smooth(rates, ["unit"], ["bin", "by"], [1.15, 1.15], min_occ=LEAST_OCC)
    return found.select("unit", "bin", "by", F.round("raw", 5).alias("raw"), F.round("smoothed", 5).alias("smoothed"))


def spatial_map_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map over quantity and discount whose second axis wraps."""
    frames = _frames(spark, sf_dir).dropna(subset=["bin", "bd"])
    rates = maps.rate_map(frames.where("session = 'R'"), maps.occupancy(frames, ["bin", "bd"], FRAME_S), ["unit"], ["bin", "bd"])
    found = maps.smooth(rates, ["unit"], ["bin", "bd"], [1.0, 2.0], min_occ=LEAST_OCC, periods={"bd": 11})
    return found.select("unit", "bin", "bd", F.round("smoothed", 5).alias("smoothed"))


def velocity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed by direction, bins closed on the left, the direction's distance wrapping; occupancy and rate."""
    rows = load(spark, sf_dir, "lineitem", "l_quantity", "l_partkey", "l_returnflag").select(
        bin_of(F.col("l_quantity"), 1, 51, 5, "left").alias("speed"), bin_of((F.col("l_partkey") % 360).cast("double") - 180, -180, 180, 12, "left").alias("heading"), "l_returnflag"
    )
    rates = maps.rate_map(rows.where("l_returnflag = 'R'").withColumn("unit", F.lit(0)), maps.occupancy(rows, ["speed", "heading"], FRAME_S), ["unit"], ["speed", "heading"])
    found = maps.smooth(rates, ["unit"], ["speed", "heading"], [1.0, 1.0], min_occ=LEAST_OCC, periods={"heading": 12})
    return found.select("speed", "heading", F.round("occ", 5).alias("occ"), F.round("smoothed", 5).alias("smoothed"))


def selfmotion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on the integer grid of (dx, dy) steps of 3, cut to limits."""
    rows = load(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_returnflag")
    at = rows.select(F.floor(F.col("l_quantity") / 3).cast("int").alias("ix"), F.floor((F.rint(F.col("l_tax") * 100) * 10 - 5) / 3).cast("int").alias("jy"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    at = at.where(F.col("ix").between(0, 12) & F.col("jy").between(-1, 26))
    return at.groupBy("ix", "jy").agg(F.count("*").alias("frames"), F.sum("y").alias("n"), F.round(F.sum("y") / (F.count("*") * FRAME_S), 6).alias("rate"))


def info_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information of each unit's map, and the four units that have most."""
    found = maps.information_rate(_map_1d(spark, sf_dir), ["unit"])
    return found.select("unit", F.round("info", 6).alias("info")).orderBy(F.desc("info"), "unit").limit(4)


def valid_bin_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two covariates that all three sessions have occupied for long enough."""
    occ = maps.occupancy(_frames(spark, sf_dir), ["session", "bin", "by"], FRAME_S).where("occ > 4.05")
    return occ.groupBy("bin", "by").agg(F.countDistinct("session").alias("k"), F.round(F.min("occ"), 6).alias("least")).where("k = 3").select("bin", "by", "least")


def behaviour_occupancy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative occupancy of each bin in two sessions, and its difference."""
    occ = maps.occupancy(_frames(spark, sf_dir).where("session IN ('A', 'N')"), ["session", "bin"], 1.0)
    total = occ.groupBy("session").agg(F.sum("occ").alias("all"))
    shares = occ.join(F.broadcast(total), "session").groupBy("bin").agg(*(F.coalesce(F.max(F.when(F.col("session") == s, F.col("occ") / F.col("all"))), F.lit(0.0)).alias(s) for s in ("A", "N")))
    return shares.select("bin", F.round("A", 6).alias("a"), F.round("N", 6).alias("n"), F.round(F.col("A") - F.col("N"), 6).alias("diff"))


_SHUFFLES, _HOUR, _BINS = 20, 3_600_000_000, 24


def _hour_of_day(us):
    return F.floor((us % (24 * _HOUR)) / _HOUR).cast("int")


def _shuffled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts by hour of the day of all units: as they are, and mean and std over shifted copies."""
    rows = spikes(spark, sf_dir)
    real = rows.groupBy("unit", _hour_of_day(F.col("us")).alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.select("unit").distinct().crossJoin(F.broadcast(spark.range(_BINS).select(F.col("id").cast("int").alias("bin"))))
    lags = shifts(spark, _SHUFFLES, 2 * _HOUR, 22 * _HOUR)
    moved = maps.shuffled_maps(rows, lags, _hour_of_day, ["unit"])
    cells = grid.crossJoin(F.broadcast(lags.select("shuffle_id"))).join(moved, ["unit", "bin", "shuffle_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.join(real, ["unit", "bin"], "left").select("unit", "bin", F.coalesce("n", F.lit(0)).alias("rate")), cells


def peak_exceeds_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, cells = _shuffled(spark, sf_dir)
    null = cells.groupBy("unit", "bin").agg(F.avg("n").alias("sh_mean"), F.stddev_pop("n").alias("sh_std"))
    return maps.peak_exceeds(real.join(null, ["unit", "bin"]), ["unit"])


def shuffle_percentile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.5th and 99.5th percentile of the shuffled counts in each bin."""
    _, cells = _shuffled(spark, sf_dir)
    band = cells.groupBy("unit", "bin").agg(F.expr("percentile(n, array(0.005, 0.995))").alias("p"))
    return band.select("unit", "bin", F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First maximum, its place, area and minimum of each unit's map."""
    rates = _map_1d(spark, sf_dir)
    found = rates.groupBy("unit").agg(F.max(F.struct("raw", (-F.col("bin")).alias("b"))).alias("m"), F.sum("raw").alias("area"), F.min_by("bin", F.struct("raw", "bin")).alias("low_bin"))
    return found.select("unit", (-F.col("m.b")).alias("peak_bin"), F.round("m.raw", 5).alias("peak"), F.round("area", 5).alias("area"), "low_bin")


def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram with fixed edges whose last bin holds its upper edge too; median of all."""
    v = load(spark, sf_dir, "lineitem", "l_quantity").where(F.col("l_quantity").between(0, 50))
    at = F.least(F.floor(F.col("l_quantity") / 5), F.lit(9)).cast("int")
    counts = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.crossJoin(v.agg(F.round(F.expr("percentile(l_quantity, 0.5)"), 6).alias("median")))


def probe_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by probe row: counts pooled by two channels, and each pool's share of the fullest."""
    counts = load(spark, sf_dir, "part", "p_size").groupBy(F.floor(F.col("p_size") / 2).cast("int").alias("pool")).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.max("n").alias("top"))).select("pool", "n", F.round(ratio(F.col("n"), F.col("top")), 6).alias("share"))


def gaussian_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts smoothed by a Gaussian of 1.5 days with mirrored ends."""
    days = spikes(spark, sf_dir).groupBy(F.expr("cast(us div 86400000000 as int)").alias("day")).agg(F.count("*").cast("double").alias("n")).withColumn("one", F.lit(1))
    return signal.gaussian_filter_bins(days, ["one"], "day", "n", 1.5, 30).select("day", F.round("smoothed", 5).alias("smoothed"))


def centre_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each brand lies along its sizes: mean size weighted by count, over sizes within 20 of the fullest that have over 15 % of it."""
    from pyspark.sql import Window

    counts = load(spark, sf_dir, "part", "p_brand", "p_size").groupBy("p_brand", "p_size").agg(F.count("*").alias("w"))
    peak = F.max(F.struct("w", (-F.col("p_size")).alias("s"))).over(Window.partitionBy("p_brand"))
    near = counts.withColumn("peak", peak).where((F.col("w") > 0.15 * F.col("peak.w")) & (F.abs(F.col("p_size") + F.col("peak.s")) <= 20))
    return near.groupBy("p_brand").agg(F.round(F.sum(F.col("p_size") * F.col("w")) / F.sum("w"), 6).alias("centre"))


def adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the order price that leave both edge bins with enough frames."""
    fine = load(spark, sf_dir, "orders", "o_totalprice").groupBy(F.floor(F.col("o_totalprice") / 500).alias("b")).agg(F.count("*").alias("n"))

    def bounds(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        found = maps.adaptive_bounds(list(zip(rows["b"] * 500.0 + 250, rows["n"].astype(float), strict=True)), rows["b"].min() * 500.0, rows["b"].max() * 500.0 + 500, 36, rows["n"].sum() / 200)
        return pd.DataFrame([found], columns=["lo", "hi"])

    return fine.where("b IS NOT NULL").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(bounds, "lo double, hi double")  # a fine histogram, bounded by the price range


QUERIES = {
    f.__name__: f
    for f in (
        area_range_join, occupancy_1d, ratemap_1d, ratemap_2d, spatial_map_wrap, velocity_map, selfmotion_map, info_rate, valid_bin_intersection, behaviour_occupancy_diff, peak_exceeds_shuffle,
        shuffle_percentile_band, curve_summary, histogram_edges, probe_profile, gaussian_counts, centre_of_mass, adaptive_bounds,
    )
}

_B = lambda v, lo, hi, n: f"(CASE WHEN ceil(({v} - {lo}) * {n} / {hi - lo}) - 1 BETWEEN 0 AND {n - 1} THEN ceil(({v} - {lo}) * {n} / {hi - lo}) - 1 END)::INT"
_F = f"""f AS (SELECT (l_suppkey % 10)::INT AS unit, l_returnflag AS session, {_B('l_quantity', 0.0, 50.0, 10)} AS bin, {_B('l_extendedprice', 900.0, 105000.0, 8)} AS "by",
    {_B('l_discount', -0.005, 0.105, 11)} AS bd FROM lineitem)"""
_MAP = f"""{_F}, o AS (SELECT bin, count(*) * 0.1::DOUBLE AS occ FROM f WHERE bin IS NOT NULL GROUP BY bin), c AS (SELECT unit, bin, count(*) AS n FROM f WHERE session = 'R' AND bin IS NOT NULL GROUP BY ALL),
m AS (SELECT u.unit, o.bin, occ, coalesce(n, 0) / occ AS raw FROM (SELECT DISTINCT unit FROM c) u CROSS JOIN o LEFT JOIN c ON c.unit = u.unit AND c.bin = o.bin)"""


def _map2(a: str, b: str, zero: bool) -> str:
    raw = f"CASE WHEN occ < {LEAST_OCC} THEN 0.0 ELSE coalesce(n, 0) / occ END" if zero else "coalesce(n, 0) / occ"
    return f"""{_F}, g AS (SELECT * FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL), o AS (SELECT {a} AS p, {b} AS s, count(*) * 0.1::DOUBLE AS occ FROM g GROUP BY ALL),
c AS (SELECT unit, {a} AS p, {b} AS s, count(*) AS n FROM g WHERE session = 'R' GROUP BY ALL),
m AS (SELECT u.unit, o.p, o.s, occ, {raw} AS raw FROM (SELECT DISTINCT unit FROM c) u CROSS JOIN o LEFT JOIN c ON c.unit = u.unit AND c.p = o.p AND c.s = o.s)"""


def _sh_sql() -> str:
    u = "('0x' || substr(md5('shift|' || i), 1, 8))::BIGINT / 4294967296.0"
    return f"""e AS (SELECT user_id AS unit, epoch_us(ts) - 1704067200000000 AS us FROM events),
    lags AS (SELECT i AS k, ({2 * _HOUR} + floor({u} * {20 * _HOUR}))::BIGINT AS lag FROM range({_SHUFFLES}) r(i)), units AS (SELECT DISTINCT unit FROM e),
    moved AS (SELECT unit, k, floor((us + lag) % {24 * _HOUR} / {_HOUR})::INT AS bin, count(*) AS n FROM e CROSS JOIN lags GROUP BY ALL),
    cells AS (SELECT units.unit, i::INT AS bin, lags.k, coalesce(moved.n, 0) AS n FROM units CROSS JOIN range({_BINS}) r(i) CROSS JOIN lags LEFT JOIN moved ON moved.unit = units.unit AND moved.bin = i AND moved.k = lags.k)"""


_W = lambda d, s: f"exp(-0.5 * pow({d}, 2) / {s * s})"

ORACLE_SQL = {
    "area_range_join": """
        WITH a(area, lo, hi, rank) AS (VALUES ('V1', 1, 12, 0), ('V2M', 10, 25, 1), ('WhMa', 25, 40, 2), ('A1', 40, 48, 3)),
        p AS (SELECT p_partkey, p_size, arg_min(area, rank) AS area FROM part JOIN a ON p_size >= lo AND p_size < hi GROUP BY ALL)
        SELECT area, count(*) AS n, min(p_size) AS lowest, max(p_size) AS highest FROM p GROUP BY area""",
    "occupancy_1d": f"""
        WITH {_F}, o AS (SELECT session, bin, count(*) * 0.1::DOUBLE AS occ FROM f WHERE bin IS NOT NULL GROUP BY ALL)
        SELECT session, bin, round(occ, 6) AS occ, round(occ / sum(occ) OVER (PARTITION BY session), 6) AS share FROM o""",
    "ratemap_1d": f"""
        WITH {_MAP} SELECT a.unit, a.bin, round(any_value(a.raw), 5) AS raw, round(sum({_W('a.bin - b.bin', 1)} * b.raw) / sum({_W('a.bin - b.bin', 1)}), 5) AS smoothed
        FROM m a JOIN m b ON a.unit = b.unit GROUP BY a.unit, a.bin""",
    "ratemap_2d": f"""
        WITH {_map2('bin', '"by"', True)}
        SELECT a.unit, a.p AS bin, a.s AS "by", round(any_value(a.raw), 5) AS raw, round(sum({_W('a.p - b.p', 1.15)} * {_W('a.s - b.s', 1.15)} * b.raw) / sum({_W('a.p - b.p', 1.15)} * {_W('a.s - b.s', 1.15)}), 5) AS smoothed
        FROM m a JOIN m b ON a.unit = b.unit AND b.occ > {LEAST_OCC} GROUP BY ALL""",
    "spatial_map_wrap": f"""
        WITH {_map2('bin', 'bd', False)}, d AS (SELECT a.unit, a.p, a.s, {_W('a.p - b.p', 1)} * {_W('least(abs(a.s - b.s), 11 - abs(a.s - b.s))', 2)} AS w, b.raw FROM m a JOIN m b ON a.unit = b.unit AND b.occ > {LEAST_OCC})
        SELECT unit, p AS bin, s AS bd, round(sum(w * raw) / sum(w), 5) AS smoothed FROM d GROUP BY ALL""",
    "velocity_map": f"""
        WITH f AS (SELECT floor((l_quantity - 1) * 5 / 50)::INT AS p, floor((l_partkey % 360)::DOUBLE * 12 / 360)::INT AS s, l_returnflag FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51),
        m AS (SELECT p, s, count(*) * 0.1::DOUBLE AS occ, count(*) FILTER (l_returnflag = 'R') / (count(*) * 0.1::DOUBLE) AS raw FROM f GROUP BY ALL),
        d AS (SELECT a.p, a.s, a.occ, {_W('a.p - b.p', 1)} * {_W('least(abs(a.s - b.s), 12 - abs(a.s - b.s))', 1)} AS w, b.raw FROM m a JOIN m b ON b.occ > {LEAST_OCC})
        SELECT p AS speed, s AS heading, round(occ, 5) AS occ, round(sum(w * raw) / sum(w), 5) AS smoothed FROM d GROUP BY p, s, occ""",
    "selfmotion_map": """
        WITH a AS (SELECT floor(l_quantity / 3)::INT AS ix, floor((round_even(l_tax * 100, 0) * 10 - 5) / 3)::INT AS jy, (l_returnflag = 'R')::INT AS y FROM lineitem)
        SELECT ix, jy, count(*) AS frames, sum(y)::BIGINT AS n, round(sum(y) / (count(*) * 0.1::DOUBLE), 6) AS rate FROM a WHERE ix BETWEEN 0 AND 12 AND jy BETWEEN -1 AND 26 GROUP BY ALL""",
    "info_rate": f"""
        WITH {_MAP}, p AS (SELECT *, occ / sum(occ) OVER (PARTITION BY unit) AS p FROM m), r AS (SELECT *, sum(p * raw) OVER (PARTITION BY unit) AS mr FROM p)
        SELECT unit, round(coalesce(sum(CASE WHEN raw > 1e-6 THEN p * (raw / mr) * log2(raw / mr) END), 0.0), 6) AS info FROM r GROUP BY unit ORDER BY info DESC, unit LIMIT 4""",
    "valid_bin_intersection": f"""
        WITH {_F}, o AS (SELECT session, bin, "by", count(*) * 0.1::DOUBLE AS occ FROM f WHERE bin IS NOT NULL AND "by" IS NOT NULL GROUP BY ALL)
        SELECT bin, "by", round(min(occ), 6) AS least FROM o WHERE occ > 4.05 GROUP BY bin, "by" HAVING count(DISTINCT session) = 3""",
    "behaviour_occupancy_diff": f"""
        WITH {_F}, o AS (SELECT session, bin, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY session) AS share FROM f WHERE bin IS NOT NULL AND session IN ('A', 'N') GROUP BY session, bin),
        b AS (SELECT bin, coalesce(max(share) FILTER (session = 'A'), 0.0) AS a, coalesce(max(share) FILTER (session = 'N'), 0.0) AS n FROM o GROUP BY bin)
        SELECT bin, round(a, 6) AS a, round(n, 6) AS n, round(a - n, 6) AS diff FROM b""",
    "peak_exceeds_shuffle": f"""
        WITH {_sh_sql()}, null_ AS (SELECT unit, bin, avg(n) AS m, stddev_pop(n) AS s FROM cells GROUP BY ALL),
        real AS (SELECT unit, floor(us % {24 * _HOUR} / {_HOUR})::INT AS bin, count(*) AS n FROM e GROUP BY ALL),
        r AS (SELECT null_.*, coalesce(real.n, 0) AS rate FROM null_ LEFT JOIN real USING (unit, bin)),
        p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY rate DESC, bin) AS k FROM r)
        SELECT p.unit, p.bin AS peak_bin, p.rate AS peak_rate, bool_and(r.rate > r.m + 3 * r.s) AS exceeds FROM p JOIN r ON r.unit = p.unit AND abs(r.bin - p.bin) <= 1 WHERE k = 1 GROUP BY ALL""",
    "shuffle_percentile_band": f"WITH {_sh_sql()} SELECT unit, bin, round(quantile_cont(n, 0.005), 6) AS low, round(quantile_cont(n, 0.995), 6) AS high FROM cells GROUP BY unit, bin",
    "curve_summary": f"""
        WITH {_MAP}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY raw DESC, bin) AS hi, row_number() OVER (PARTITION BY unit ORDER BY raw, bin) AS lo FROM m)
        SELECT unit, max(bin) FILTER (hi = 1) AS peak_bin, round(max(raw), 5) AS peak, round(sum(raw), 5) AS area, max(bin) FILTER (lo = 1) AS low_bin FROM k GROUP BY unit""",
    "histogram_edges": """
        WITH v AS (SELECT l_quantity AS q FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
        SELECT least(floor(q / 5), 9)::INT AS bin, count(*) AS n, (SELECT round(quantile_cont(q, 0.5), 6) FROM v) AS median FROM v GROUP BY 1""",
    "probe_profile": "WITH c AS (SELECT (p_size // 2)::INT AS pool, count(*) AS n FROM part GROUP BY 1) SELECT pool, n, round(n * 1.0::DOUBLE / (SELECT max(n) FROM c), 6) AS share FROM c",
    "gaussian_counts": """
        WITH d AS (SELECT (epoch_us(ts) - 1704067200000000) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1),
        k AS (SELECT d, exp(-0.5 * pow(d / 1.5, 2)) / (SELECT sum(exp(-0.5 * pow(x / 1.5, 2))) FROM range(-6, 7) t(x)) AS w FROM range(-6, 7) r(d)),
        p AS (SELECT b, w, CASE WHEN b + d < 0 THEN -(b + d) - 1 WHEN b + d > 29 THEN 59 - (b + d) ELSE b + d END AS s FROM range(30) r(b) CROSS JOIN k)
        SELECT b::INT AS day, round(sum(w * n), 5) AS smoothed FROM p JOIN d ON d.day = p.s GROUP BY b""",
    "centre_of_mass": """
        WITH c AS (SELECT p_brand, p_size, count(*) AS w FROM part GROUP BY ALL), k AS (SELECT p_brand, arg_max(p_size, w * 1000 - p_size) AS s, max(w) AS top FROM c GROUP BY p_brand)
        SELECT p_brand, round(sum(p_size * w) / sum(w), 6) AS centre FROM c JOIN k USING (p_brand) WHERE w > 0.15 * top AND abs(p_size - s) <= 20 GROUP BY p_brand""",
}
