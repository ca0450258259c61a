"""Queries on raw recordings, flat arrays and result tables, written from the tables first, on clusters and on blocks of covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.places import scratch
from spindrift.operators import clusters, joins, snippets, standardise
from spindrift.sources import arrays, updates
from spindrift.sources.tables import load, spikes

#: Channels of the recording that stands for ``orders``.
CHANNELS = 4


def _recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``orders`` by key as samples of four channels."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    values = F.array(*(c.cast("smallint") for c in (F.floor(F.col("o_totalprice") / 50), F.col("o_custkey") % 1000, F.dayofyear("o_orderdate"), F.floor(-F.col("o_totalprice") / 70))))
    placed = joins.numbered_rows(rows.select("o_orderkey", values.alias("values")), "o_orderkey")
    return arrays.write_recording(placed.select(F.col("i").alias("sample"), "values"), scratch(spark, "recording"))


def _spikes(spark: SparkSession, sf_dir: str, files: DataFrame, unit: str) -> DataFrame:
    """All events, their times stretched over the recording; a unit's channel follows from its name."""
    rows = spikes(spark, sf_dir, "event_type")
    last = rows.agg(F.max("us").cast("double").alias("last"))
    n = files.agg(F.sum("samples").cast("double").alias("n"))
    placed = rows.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(n))  # a row each
    sample = F.floor(F.col("us") / (F.col("last") + 1) * F.col("n"))
    return placed.select(F.lit(0).alias("session"), F.col(unit).alias("unit"), sample.alias("sample"), (F.length(F.col(unit).cast("string")) % CHANNELS).alias("channel"))


def snippet_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean waveform of each unit on its channel and one on each side, over at most 1,000 drawn spikes."""
    files = _recording(spark, sf_dir)
    found = snippets.drawn_means(_spikes(spark, sf_dir, files, "unit"), files, CHANNELS, around=1, scale=0.5)
    return found.select("unit", "channel", F.col("at").alias("rel"), "n", F.round("mean", 6).alias("mean"))


def drawn_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets of 1,000 drawn spikes of each event type, put together again: their sums and ends."""
    files = _recording(spark, sf_dir)
    found = snippets.snippets(_spikes(spark, sf_dir, files, "event_type"), files, CHANNELS, around=0)
    parts = found.groupBy("unit", "sample", "channel").agg(F.sort_array(F.collect_list(F.struct("rel", "values"))).alias("parts"))  # few pieces a snippet
    whole = parts.select("unit", "sample", "channel", F.flatten("parts.values").alias("v"))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return whole.select("unit", "sample", "channel", F.size("v").alias("n"), total.alias("total"), F.element_at("v", 1).cast("int").alias("first"), F.element_at("v", -1).cast("int").alias("last"))


def npy_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors through ``.npy`` files, even ones by rows and odd ones by columns, read by ranges of 1,000 rows."""
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = None
    for part, fortran in enumerate((False, True)):
        half = joins.numbered_rows(rows.where(F.col("vec_id") % 2 == part).select("vec_id", F.col("embedding").alias("values")), "vec_id").withColumnRenamed("i", "sample")
        folder = scratch(spark, "npy")
        arrays.write_npy(half, folder, fortran, 10_000)
        first = F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("bigint")
        read = arrays.npy(spark, folder, 1_000).select((first + F.col("row")).alias("place"), F.lit(part).alias("part"), "values")
        found = read if found is None else found.unionByName(read)
    return found.select("part", "place", F.posexplode("values").alias("entry", "x")).select("part", "place", "entry", F.round("x", 6).alias("x"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings", "embedding", "label").select(F.col("label").alias("cluster"), F.col("embedding").alias("v"))


def cluster_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and silhouette of all labelled vectors."""
    found = clusters.indices(_labelled(spark, sf_dir))
    return found.select("n", "clusters", *(F.round(c, 5).alias(c) for c in ("calinski_harabasz", "davies_bouldin", "silhouette")))


def cluster_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.silhouettes(_labelled(spark, sf_dir)).select("cluster", "n", F.round("silhouette", 5).alias("silhouette"))


def block_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and price of each line as one block, discount as another, tax without penalty."""
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = rows.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"))
    found, _ = standardise.standardised_blocks(rows, "x", [1, 1, 2, 0])
    return found.select("l_orderkey", "l_linenumber", *(F.round(F.col("z")[i], 5).alias(name) for i, name in enumerate(("quantity", "price", "discount", "tax"))))


def updated_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as a table by nation, in which those with orders then get their number and total."""
    path = scratch(spark, "profiles")
    load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumns({"n": F.lit(None).cast("bigint"), "total": F.lit(None).cast("double")}).write.partitionBy("c_nationkey").parquet(path)
    sums = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    nations = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    updates.update(spark, path, nations.join(sums, "c_custkey"), ["c_custkey"], ["c_nationkey"])
    found = updates.table_at(spark, path, nations.select("c_nationkey").schema)
    return found.select("c_custkey", "c_nationkey", "c_acctbal", "n", F.round("total", 2).alias("total"))


QUERIES = {f.__name__: f for f in (snippet_means, drawn_snippets, npy_arrays, cluster_indices, cluster_silhouettes, block_standard, updated_profiles)}

_LABELLED = """
    v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT label, count(*) AS n FROM v GROUP BY label),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM v a CROSS JOIN v b GROUP BY ALL),
    m AS (SELECT vec_id, d.label, max(CASE WHEN d.label = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN d.label <> other THEN total / n END) AS b FROM d JOIN z ON z.label = other GROUP BY ALL),
    s AS (SELECT label, CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s FROM m)"""

_SAMPLES = """
    s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, [floor(o_totalprice / 50), o_custkey % 1000, dayofyear(o_orderdate), floor(-o_totalprice / 70)]::INT[] AS v FROM orders),
    t AS (SELECT user_id, event_type, epoch_us(ts) - 1704067200000000 AS us FROM events), m AS (SELECT max(us)::DOUBLE AS last, (SELECT count(*)::DOUBLE FROM orders) AS n FROM t)"""


def _drawn(unit: str) -> str:
    draw = f"('0x' || substr(md5('snippet|0|' || unit || '|' || sample), 1, 8))::BIGINT / 4294967296.0"
    return f"""{_SAMPLES},
    e AS (SELECT DISTINCT {unit} AS unit, floor(us::DOUBLE / (last + 1) * n)::BIGINT AS sample, (length({unit}::VARCHAR) % 4)::INT AS channel, n FROM t CROSS JOIN m),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {draw}, sample) AS nth FROM e WHERE sample >= 20 AND sample + 62 <= n),
    w AS (SELECT unit, sample, channel, i::INT AS rel FROM k CROSS JOIN range(82) r(i) WHERE nth <= 1000)"""


ORACLE_SQL = {
    "snippet_means": f"""
        WITH {_drawn('user_id')}, c AS (SELECT *, channel + d AS c FROM w CROSS JOIN range(-1, 2) r(d) WHERE channel + d BETWEEN 0 AND 3)
        SELECT unit, c::INT AS channel, rel, count(*) AS n, round(sum(v[c + 1]) / count(*) * 0.5, 6) AS mean FROM c JOIN s ON i = sample - 20 + rel GROUP BY unit, c, rel""",
    "drawn_snippets": f"""
        WITH {_drawn('event_type')}
        SELECT unit, sample, channel, count(*)::INT AS n, sum(v[channel + 1])::BIGINT AS total, arg_min(v[channel + 1], rel) AS first, arg_max(v[channel + 1], rel) AS last
        FROM w JOIN s ON i = sample - 20 + rel GROUP BY unit, sample, channel""",
    "npy_arrays": """
        WITH p AS (SELECT (vec_id % 2)::INT AS part, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS place, embedding FROM embeddings)
        SELECT part, place, i::INT AS entry, round(embedding[i + 1]::DOUBLE, 6) AS x FROM p CROSS JOIN range(64) r(i)""",
    "cluster_silhouettes": f"WITH {_LABELLED} SELECT label AS cluster, count(*) AS n, round(avg(s), 5) AS silhouette FROM s GROUP BY label",
    "cluster_indices": f"""
        WITH {_LABELLED}, x AS (SELECT vec_id, label, i, v[i] AS x FROM v CROSS JOIN range(1, 65) r(i)),
        c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
        t AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM z) AS k, (SELECT sum(c.n * pow(c.m - g.m, 2)) FROM c JOIN g USING (i)) AS between, (SELECT sum(pow(x - m, 2)) FROM x JOIN c USING (label, i)) AS within),
        o AS (SELECT vec_id, label, sqrt(sum(pow(x - m, 2))) AS d FROM x JOIN c USING (label, i) GROUP BY ALL), w AS (SELECT label, avg(d) AS w FROM o GROUP BY label),
        p AS (SELECT a.label AS one, b.label AS two, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
        r AS (SELECT one, max((x.w + y.w) / d) AS r FROM p JOIN w x ON x.label = one JOIN w y ON y.label = two GROUP BY one)
        SELECT n, k AS clusters, round(between * (n - k) / (within * (k - 1)), 5) AS calinski_harabasz, (SELECT round(avg(r), 5) FROM r) AS davies_bouldin, (SELECT round(avg(s), 5) FROM s) AS silhouette FROM t""",
    "block_standard": """
        WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem),
        x AS (SELECT l_orderkey, l_linenumber, n, l_quantity - q AS q, l_extendedprice - p AS p, l_discount - d AS d, l_tax - t AS t FROM lineitem CROSS JOIN m),
        a AS (SELECT sum(p * q) / sum(q * q) AS slope FROM x), y AS (SELECT *, p - slope * q AS rest FROM x CROSS JOIN a),
        s AS (SELECT sqrt(avg(q * q)) AS sq, sqrt(avg(rest * rest)) AS sp, sqrt(avg(d * d)) AS sd, sqrt(avg(t * t)) AS st FROM y)
        SELECT l_orderkey, l_linenumber, round(q / sq, 5) AS quantity, round(rest / sp, 5) AS price, round(d / sd, 5) AS discount, round(t / st, 5) AS tax FROM y CROSS JOIN s""",
    "updated_profiles": """
        WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
        SELECT c_custkey, c_nationkey, c_acctbal, n, total FROM customer LEFT JOIN o USING (c_custkey)""",
}
