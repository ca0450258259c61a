"""Reading tables: column choice at the scan, NaN as null, sentinels, long spike trains; and writing results."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the recording that ``events`` stands for.
ORIGIN = "2024-01-01 00:00:00"


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (a plain checkout)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table's chosen columns (all without any); NaN becomes null."""
    workers_can_import(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.select(*columns) if columns else df
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in floats}) if floats else df


def micros(ts: str = "ts") -> Column:
    """Microseconds since ``ORIGIN``, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ORIGIN}', {ts})")


def spikes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``events`` as spike trains: unit, us (microseconds since the origin), and more columns of it."""
    return load(spark, sf_dir, "events", "user_id", "ts", *more).select(F.col("user_id").alias("unit"), micros().alias("us"), *more)


def unpivoted(rows: DataFrame, keys: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each of the ``values`` columns of a row: keys, the column's name, and its value as a double."""
    return rows.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, name, value)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, least, most, mean) of numeric columns, from one scan."""
    stats = [F.struct(F.count(c).alias("n"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most"), F.avg(c).alias("mean")).alias(c) for c in columns]
    wide = rows.agg(*stats)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.column", "x.s.*")


def without_sentinels(value: str, limit: float = 100.0) -> Column:
    """Tracker values beyond the limit are missing."""
    return F.when(F.abs(F.col(value)) <= limit, F.col(value))


def markers_to_slots(markers: DataFrame, slots: int = 7) -> DataFrame:
    """(session_id, frame, marker, x, y, z) -> a column of points for each slot; a frame needs two labelled markers."""
    clean = markers.select("session_id", "frame", "marker", *(without_sentinels(c).alias(c) for c in "xyz"))
    point = F.struct("x", "y", "z")
    wide = clean.groupBy("session_id", "frame").agg(
        F.count("x").alias("labelled"), *(F.max(F.when(F.col("marker") == i, point)).alias(f"m{i}") for i in range(slots))
    )
    return wide.select("session_id", "frame", *(F.when(F.col("labelled") > 1, F.col(f"m{i}")).alias(f"m{i}") for i in range(slots)))


def explode_groups(groups: DataFrame, column: str = "groups") -> DataFrame:
    """A JSON map of group name to unit ids -> (unit_type, unit_id)."""
    return groups.select(F.explode(column).alias("unit_type", "unit_ids")).select("unit_type", F.explode("unit_ids").alias("unit_id"))


def file_ranges(spark: SparkSession, path: str, record_bytes: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, start, bytes): the files below ``path`` in ranges of whole records; what is left of a record at the end is left out."""
    step = max(1, most_bytes // record_bytes) * record_bytes
    whole = listing(spark, path).withColumn("bytes", F.col("bytes") - F.col("bytes") % record_bytes).where("bytes > 0")
    ranges = whole.select("path", F.col("bytes").alias("end"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(step).cast("bigint"))).alias("start"))
    return ranges.select("path", "start", F.least(F.lit(step), F.col("end") - F.col("start")).alias("bytes"))


def raw_channels(spark: SparkSession, path: str, channels: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Interleaved int16 recordings below ``path`` as (path, sample, values); a task reads one range of a file."""
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    def decode(batches):
        for batch in batches:
            for path_, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes")), strict=True):
                system, at = fs.FileSystem.from_uri(path_)
                with system.open_input_file(at) as file:
                    file.seek(start)
                    data = np.frombuffer(file.read(size), "<i2").astype(np.int32)
                n = len(data) // channels
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * channels, pa.int32()), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array([path_] * n, pa.string()), pa.array(start // (2 * channels) + np.arange(n)), values], names=["path", "sample", "values"])

    ranges = file_ranges(spark, path, 2 * channels, most_bytes)
    spread = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")  # few rows, each megabytes
    return spread.mapInArrow(decode, "path string, sample bigint, values array<int>")


def spectrum(spark: SparkSession, path: str, rate: float) -> DataFrame:
    """Magnitudes ``2 / n * |FFT|`` of int16 mono sound files (path, hz, magnitude); a WAV header is skipped.

    A transform needs a whole sound, so a file is one task's row; sounds are short.
    """
    import numpy as np
    import pandas as pd

    def transform(batches):
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                body = content[44:] if content[:4] == b"RIFF" else content
                sound = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(float)
                n = len(sound)
                if n:
                    half = np.abs(np.fft.fft(sound))[: n // 2] * 2 / n
                    yield pd.DataFrame({"path": path_, "hz": np.arange(n // 2) * rate / n, "magnitude": half})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(transform, "path string, hz double, magnitude double")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path`` whose names fit: path and bytes; contents aren't read, and empty files are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options: str) -> None:
    """Write results as parquet, json, csv or orc, always to a new place."""
    writer = df.write.mode("errorifexists").format(kind).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
