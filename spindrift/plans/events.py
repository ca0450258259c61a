"""Queries on events as spike trains: selection, parsing, counts, onsets, aligned responses, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.bins import md5_uniform, spine
from spindrift.operators import joins, windows
from spindrift.sources.tables import load, micros, spikes

HOUR, DAY = 3_600_000_000, 86_400_000_000
HOURS = 720
_E = "e AS (SELECT event_id, user_id AS unit, event_type, value, epoch_us(ts) - 1704067200000000 AS us FROM events)"


def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes inside a recording window, in seconds from its start."""
    start, stop = 5 * DAY, 25 * DAY
    t = spikes(spark, sf_dir, "event_id").where((F.col("us") >= start) & (F.col("us") < stop))
    return t.select("event_id", "unit", F.round((F.col("us") - start) / 1e6, 6).alias("t"))


def unit_select_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by segment, area, modulation class and activity in a session, all together."""
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    areas = spark.createDataFrame([("A", 0, 10, 0), ("B", 10, 20, 1), ("C", 15, 25, 2)], "area string, ch_lo int, ch_hi int, rank int")
    placed = joins.first_range(customer, areas, ["c_custkey", "c_acctbal", "c_mktsegment"], "c_nationkey")
    classed = placed.withColumn("smi", joins.modulation_class(F.col("c_acctbal"), md5_uniform("c_custkey"), 0.5))
    chosen = joins.select_units(classed, c_mktsegment=["BUILDING", "MACHINERY"], area=["A", "C"], smi=["sign pos", "sign neg"])
    active = load(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return chosen.join(active, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment", "area", "smi").orderBy("c_custkey")


def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that names encode: parts of URLs, with one value mapped to another."""
    url = F.col("url")
    return load(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id",
        F.regexp_extract(url, r"^(https?)://", 1).alias("scheme"),
        F.regexp_extract(url, r"example\.([a-z]+)", 1).alias("bank"),
        F.regexp_extract(url, r"/(en|de|fr|es)/", 1).alias("kind"),
        F.regexp_extract(url, r"/([0-9]+)", 1).cast("int").alias("number"),
        F.when(F.substring_index(url, "#", -1) == "top", "head").otherwise("rest").alias("mapped"),
        (url.contains("utm") | url.contains("ref")).alias("tagged"),
    )


def brand_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit id's parts: the number behind a fixed prefix, and the text behind a separator; sorted by the latter as text."""
    part = load(spark, sf_dir, "part", "p_partkey", "p_brand")
    return part.select("p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("number"), F.split("p_brand", "#")[1].alias("tail"), F.replace(F.col("p_brand"), F.lit("Brand"), F.lit("B")).alias("short")).orderBy("tail", "p_partkey")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, counted, and shaped into JSON again."""
    k = F.get_json_object("props", "$.k").cast("int")
    found = load(spark, sf_dir, "events", "event_type", "props").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))
    return found.select("event_type", "n", "total", F.to_json(F.struct("n", "most")).alias("doc"))


def baseline_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes per day of each unit, rounded to two places."""
    return spikes(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n")).select("unit", "n", F.bround(F.col("n") / 30.0, 2).alias("rate"))


def hourly(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spikes(spark, sf_dir, *more).withColumn("frame", F.expr(f"us div {HOUR}"))


def spike_counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each unit and day, empty days too, and the same condensed to 10 days with the mean day."""
    counts = spikes(spark, sf_dir).select("unit", F.expr(f"cast(us div {DAY} as int)").alias("day")).groupBy("unit", "day").agg(F.count("*").alias("n"))
    dense = counts.select("unit").distinct().crossJoin(F.broadcast(spine(spark, 30, "day"))).join(counts, ["unit", "day"], "left")  # 30 days
    return dense.groupBy("unit", F.floor(F.col("day") / 10).cast("int").alias("block")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("per_day"))


def sound_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 series by hour: whether there was an error."""
    on = hourly(spark, sf_dir, "event_type").where("event_type = 'error'").select("frame").distinct().withColumn("on", F.lit(1))
    frames = spine(spark, HOURS, "frame").withColumn("frame", F.col("frame").cast("bigint"))
    return frames.join(on, "frame", "left").select(F.lit(0).alias("session"), "frame", F.coalesce("on", F.lit(0)).alias("on"))


def event_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_onsets(sound_series(spark, sf_dir), ["session"]).select("onset", "offset")


def event_onsets_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.event_onsets(sound_series(spark, sf_dir), ["session"])
    return windows.filter_onsets(found, ["session"], expected=2, slack=1, min_gap=3).select("onset", "offset")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in each hour, empty hours too."""
    counts = hourly(spark, sf_dir, "event_type").groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    frames = spine(spark, HOURS, "frame").withColumn("frame", F.col("frame").cast("bigint"))
    return counts.select("event_type").distinct().crossJoin(F.broadcast(frames)).join(counts, ["event_type", "frame"], "left").select("event_type", "frame", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def runs_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.runs_in_band(activity(spark, sf_dir), ["event_type"], 1, 4, 3)


def runs_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.thinned_starts(windows.runs_in_band(activity(spark, sf_dir), ["event_type"], 1, 4, 3), ["event_type"], 3)


def _onset_frames(spark: SparkSession, sf_dir: str, kind: str = "error") -> DataFrame:
    return hourly(spark, sf_dir, "event_type").where(F.col("event_type") == kind).select(F.col("frame").alias("onset")).distinct()


def _other_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, "event_type").where("event_type <> 'error'").groupBy("frame").agg(F.count("*").alias("n"))


def peth_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean response around the hours with an error, from 6 hours before to 5 after."""
    rates = windows.peth(_other_counts(spark, sf_dir), _onset_frames(spark, sf_dir), -6, 5)
    return windows.mean_and_sem(rates, ["rel"], "rate").select("rel", F.round("mean", 6).alias("mean_rate"), F.round("sem", 6).alias("sem"), "n")


def peth_discontinuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that begin at the onset, three sessions one after the other: two bins of each."""
    counts = _other_counts(spark, sf_dir)
    parts = [
        windows.peth(counts, _onset_frames(spark, sf_dir, kind), 0, 1).select((F.col("rel") + 2 * i).cast("int").alias("bin"), "rate") for i, kind in enumerate(("error", "signup", "purchase"))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return windows.mean_and_sem(rows, ["bin"], "rate").select("bin", F.round("mean", 6).alias("mean_rate"), "n")


def raster_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within an hour of a signup, before or after, as counts by whole minutes from it."""
    rows = spikes(spark, sf_dir, "event_id", "event_type")
    onsets = rows.where("event_type = 'signup'").select(F.col("event_id").alias("onset_id"), "us")
    return windows.raster_counts(rows.where("event_type <> 'signup'").select("us"), onsets, 60_000_000, 60).withColumnRenamed("rel", "minute")


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("unit").orderBy("us", "event_id")
    return spikes(spark, sf_dir, "event_id", "value").withColumn("frame", F.row_number().over(by) - 1).withColumn("angle", F.pmod(F.col("value") * 7, F.lit(360.0)) - 180)


def derivative_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second differences of each unit's angles over two frames to each side."""
    found = windows.derivative(_sequence(spark, sf_dir), ["unit"], 2, 10.0, value="angle", angle=True)
    return found.select("unit", "frame", F.round("der1", 4).alias("der1"), F.round("der2", 4).alias("der2"))


def self_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _sequence(spark, sf_dir).select("unit", "frame", (F.col("value") / 100).alias("x"), (F.pmod(F.col("value") * 13, F.lit(97.0)) / 100).alias("y"), F.col("angle").alias("direction"))
    found = windows.self_motion(path, ["unit"], 5, 10.0)
    return found.select("unit", "frame", *(F.round(c, 4).alias(c) for c in ("jump", "cum", "dx", "dy")))


def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.unwrapped(_sequence(spark, sf_dir), ["unit"])
    return found.select("unit", "frame", F.round("unwrapped", 4).alias("unwrapped"))


def minute_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each unit in even and odd minutes."""
    odd = F.expr("us div 60000000") % 2
    return spikes(spark, sf_dir).groupBy("unit").agg(F.count(F.when(odd == 0, 1)).alias("even"), F.count(F.when(odd == 1, 1)).alias("odd"))


def modulation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post - pre) / (post + pre) by type of event, over two hours after and before the hours with an error."""
    counts = hourly(spark, sf_dir, "event_type").where("event_type <> 'error'").groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    rates = windows.peth(counts, _onset_frames(spark, sf_dir), -2, 1, keys=["event_type"])
    sums = rates.groupBy("event_type").agg(F.avg(F.when(F.col("rel") >= 0, F.col("rate"))).alias("post"), F.avg(F.when(F.col("rel") < 0, F.col("rate"))).alias("pre"))
    return sums.select("event_type", F.round(F.try_divide(F.col("post") - F.col("pre"), F.col("post") + F.col("pre")), 6).alias("smi"))


def session_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each unit: runs of events with no gap of six hours."""
    rows = load(spark, sf_dir, "events", "user_id", "ts").select("user_id", (F.timestamp_micros(micros())).alias("at"))
    found = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_project_filter, unit_select_conjunctive, filename_parse, brand_parts, json_props, baseline_rate, spike_counts_dense, event_onsets, event_onsets_filtered, runs_in_band, runs_thinned,
        peth_mean_sem, peth_discontinuous, raster_interval_join, derivative_wrap, self_motion, angle_unwrap, minute_split, modulation_index, session_window_counts,
    )
}

_SERIES = f"""{_E}, on_hours AS (SELECT DISTINCT us // {HOUR} AS frame FROM e WHERE event_type = 'error'),
s AS (SELECT i AS frame, CASE WHEN o.frame IS NULL THEN 0 ELSE 1 END AS v FROM range({HOURS}) r(i) LEFT JOIN on_hours o ON o.frame = i),
ch AS (SELECT frame FROM (SELECT frame, v, coalesce(lag(v) OVER (ORDER BY frame), (SELECT v FROM s WHERE frame = {HOURS - 1})) AS b FROM s) WHERE v <> b),
k AS (SELECT frame AS "onset", lead(frame) OVER (ORDER BY frame) AS "offset", row_number() OVER (ORDER BY frame) AS k FROM ch),
ons AS (SELECT "onset", "offset" FROM k WHERE k % 2 = 1)"""
_ACTIVITY = f"""{_E}, c AS (SELECT event_type, us // {HOUR} AS frame, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT t.event_type, i AS frame, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) t CROSS JOIN range({HOURS}) r(i) LEFT JOIN c ON c.event_type = t.event_type AND c.frame = i)"""
_SEQ = f"{_E}, q AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY us, event_id) - 1 AS frame, (value * 7) % 360 - 180 AS angle FROM e)"
_OTHER = f"oc AS (SELECT us // {HOUR} AS frame, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY ALL)"


def _peth_sql(kind: str, first: int, last: int) -> str:
    return f"""SELECT o.frame AS ons, rel, CASE WHEN o.frame + rel >= 0 THEN coalesce(oc.n, 0) END AS rate
        FROM (SELECT DISTINCT us // {HOUR} AS frame FROM e WHERE event_type = '{kind}') o CROSS JOIN range({first}, {last + 1}) r(rel) LEFT JOIN oc ON oc.frame = o.frame + rel"""


def _wrap_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END)"


ORACLE_SQL = {
    "scan_project_filter": f"WITH {_E} SELECT event_id, unit, round((us - {5 * DAY}) / 1e6, 6) AS t FROM e WHERE us >= {5 * DAY} AND us < {25 * DAY}",
    "unit_select_conjunctive": """
        WITH areas(area, lo, hi, rank) AS (VALUES ('A', 0, 10, 0), ('B', 10, 20, 1), ('C', 15, 25, 2)),
        p AS (SELECT c_custkey, c_mktsegment, c_acctbal, arg_min(area, rank) AS area FROM customer JOIN areas ON c_nationkey >= lo AND c_nationkey < hi GROUP BY ALL),
        m AS (SELECT *, CASE WHEN ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.5 AND c_acctbal < 0 THEN 'sign neg'
            WHEN ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.5 AND c_acctbal > 0 THEN 'sign pos' ELSE 'ns' END AS smi FROM p)
        SELECT c_custkey, c_mktsegment, area, smi FROM m WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND area IN ('A', 'C') AND smi <> 'ns'
            AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
    "filename_parse": r"""
        SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, 'example\.([a-z]+)', 1) AS bank, regexp_extract(url, '/(en|de|fr|es)/', 1) AS kind,
            regexp_extract(url, '/([0-9]+)', 1)::INT AS number, CASE WHEN split_part(url, '#', -1) = 'top' THEN 'head' ELSE 'rest' END AS mapped, contains(url, 'utm') OR contains(url, 'ref') AS tagged FROM pages""",
    "brand_parts": "SELECT p_partkey, substr(p_brand, 7)::INT AS number, split_part(p_brand, '#', 2) AS tail, replace(p_brand, 'Brand', 'B') AS short FROM part",
    "json_props": """
        SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, '{"n":' || count(k) || ',"most":' || max(k) || '}' AS doc
        FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY event_type""",
    "baseline_rate": "SELECT user_id AS unit, count(*) AS n, round_even(count(*) / 30.0, 2) AS rate FROM events GROUP BY 1",
    "spike_counts_dense": f"""
        WITH {_E}, c AS (SELECT unit, us // {DAY} AS day, count(*) AS n FROM e GROUP BY ALL),
        d AS (SELECT u.unit, i AS day, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT unit FROM e) u CROSS JOIN range(30) r(i) LEFT JOIN c ON c.unit = u.unit AND c.day = i)
        SELECT unit, (day // 10)::INT AS block, sum(n)::BIGINT AS n, round(avg(n), 6) AS per_day FROM d GROUP BY ALL""",
    "event_onsets": f'WITH {_SERIES} SELECT "onset", "offset" FROM ons',
    "event_onsets_filtered": f"""
        WITH {_SERIES} SELECT "onset", "offset" FROM (SELECT *, "onset" - lag("onset") OVER (ORDER BY "onset") AS gap FROM ons)
        WHERE (gap IS NULL OR gap > 3) AND abs("offset" - "onset" - 2) <= 1""",
    "runs_in_band": f"""
        WITH {_ACTIVITY}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY event_type ORDER BY frame) AS g FROM a WHERE n BETWEEN 1 AND 4)
        SELECT event_type, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM i GROUP BY event_type, g HAVING count(*) >= 3""",
    "peth_mean_sem": f"""
        WITH {_E}, {_OTHER}, p AS ({_peth_sql('error', -6, 5)})
        SELECT rel::INT AS rel, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate) / sqrt(count(rate)), 6) AS sem, count(rate) AS n FROM p GROUP BY rel""",
    "peth_discontinuous": f"""
        WITH {_E}, {_OTHER}, p AS ({' UNION ALL '.join(f'SELECT (rel + {2 * i})::INT AS bin, rate FROM ({_peth_sql(kind, 0, 1)})' for i, kind in enumerate(('error', 'signup', 'purchase')))})
        SELECT bin, round(avg(rate), 6) AS mean_rate, count(rate) AS n FROM p GROUP BY bin""",
    "raster_interval_join": f"""
        WITH {_E} SELECT floor((a.us - o.us) / 60e6)::INT AS minute, count(*) AS n, count(DISTINCT o.event_id) AS onsets
        FROM e a JOIN e o ON o.event_type = 'signup' AND a.event_type <> 'signup' AND a.us >= o.us - {HOUR} AND a.us < o.us + {HOUR} GROUP BY 1""",
    "derivative_wrap": f"""
        WITH {_SEQ}, d AS (SELECT unit, frame, lead(angle, 2) OVER w - lag(angle, 2) OVER w AS x FROM q WINDOW w AS (PARTITION BY unit ORDER BY frame)),
        f AS (SELECT unit, frame, {_wrap_sql('x')} * 10.0 / 4 AS der1 FROM d)
        SELECT unit, frame, round(der1, 4) AS der1, round((lead(der1, 2) OVER w - lag(der1, 2) OVER w) * 10.0 / 4, 4) AS der2 FROM f WINDOW w AS (PARTITION BY unit ORDER BY frame)""",
    "self_motion": f"""
        WITH {_SEQ}, p AS (SELECT unit, frame, value / 100 AS x, ((value * 13) % 97) / 100 AS y, angle FROM q),
        s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, lag(x, 2) OVER w AS x0, lag(y, 2) OVER w AS y0, lead(x, 3) OVER w AS x1, lead(y, 3) OVER w AS y1,
            lead(angle, 3) OVER w - lag(angle, 2) OVER w AS da FROM p WINDOW w AS (PARTITION BY unit ORDER BY frame)),
        m AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * 100 / 0.5 AS jump,
            CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN sum(step) OVER (PARTITION BY unit ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) * 100 / 0.5 END AS cum, radians({_wrap_sql('da')}) AS turn FROM s)
        SELECT unit, frame, round(jump, 4) AS jump, round(cum, 4) AS cum, round(jump * sin(turn), 4) AS dx, round(jump * cos(turn), 4) AS dy FROM m""",
    "angle_unwrap": f"""
        WITH {_SEQ}, j AS (SELECT unit, frame, angle, coalesce(angle - lag(angle) OVER (PARTITION BY unit ORDER BY frame), 0) AS d FROM q)
        SELECT unit, frame, round(angle + sum(CASE WHEN d > 90 THEN -180.0 WHEN d < -90 THEN 180.0 ELSE 0.0 END) OVER (PARTITION BY unit ORDER BY frame), 4) AS unwrapped FROM j""",
    "minute_split": f"WITH {_E} SELECT unit, count(*) FILTER (us // 60000000 % 2 = 0) AS even, count(*) FILTER (us // 60000000 % 2 = 1) AS odd FROM e GROUP BY unit",
    "modulation_index": f"""
        WITH {_E}, c AS (SELECT event_type, us // {HOUR} AS frame, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY ALL),
        o AS (SELECT DISTINCT us // {HOUR} AS frame FROM e WHERE event_type = 'error'),
        p AS (SELECT t.event_type, rel, CASE WHEN o.frame + rel >= 0 THEN coalesce(c.n, 0) END AS rate FROM o CROSS JOIN range(-2, 2) r(rel) CROSS JOIN (SELECT DISTINCT event_type FROM c) t
            LEFT JOIN c ON c.event_type = t.event_type AND c.frame = o.frame + rel),
        s AS (SELECT event_type, avg(rate) FILTER (rel >= 0) AS post, avg(rate) FILTER (rel < 0) AS pre FROM p GROUP BY event_type)
        SELECT event_type, round((post - pre) / (post + pre), 6) AS smi FROM s""",
    "session_window_counts": f"""
        WITH {_E}, g AS (SELECT unit, us, CASE WHEN us - lag(us) OVER (PARTITION BY unit ORDER BY us) < {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM e),
        n AS (SELECT unit, sum(fresh) OVER (PARTITION BY unit ORDER BY us) AS s FROM g), c AS (SELECT unit, s, count(*) AS n FROM n GROUP BY ALL)
        SELECT unit AS user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY unit""",
}
