"""Operators on series in time order: onsets, runs, aligned responses, derivatives, motion, angles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.bins import ratio, wrapped


def event_onsets(series: DataFrame, keys: list[str], frame: str = "frame", on: str = "on") -> DataFrame:
    """Onsets and offsets of a 0/1 series: every second change, frame 0 being compared with the last one.

    Returns keys, onset, offset (null for an onset without one).
    """
    by = Window.partitionBy(*keys).orderBy(frame)
    last = F.last(on).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    changes = series.withColumn("before", F.coalesce(F.lag(on).over(by), last)).where(F.col(on) != F.col("before"))
    numbered = changes.withColumns({"k": F.row_number().over(by), "offset": F.lead(frame).over(by)})
    return numbered.where("k % 2 = 1").select(*keys, F.col(frame).alias("onset"), "offset")


def filter_onsets(onsets: DataFrame, keys: list[str], expected: int, slack: int, min_gap: int) -> DataFrame:
    """Onsets that last ``expected`` frames within ``slack``, the first or more than ``min_gap`` after the one before."""
    gap = F.col("onset") - F.lag("onset").over(Window.partitionBy(*keys).orderBy("onset"))
    kept = onsets.withColumn("gap", gap).where((F.col("gap").isNull() | (F.col("gap") > min_gap)) & (F.abs(F.col("offset") - F.col("onset") - expected) <= slack))
    return kept.drop("gap")


def runs_in_band(series: DataFrame, keys: list[str], low: float, high: float, min_frames: int, frame: str = "frame", value: str = "value") -> DataFrame:
    """Runs of consecutive frames with low <= value <= high: keys, first, last, frames (``min_frames`` at least)."""
    inside = series.where(F.col(value).between(low, high))
    island = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    runs = inside.withColumn("island", island).groupBy(*keys, "island").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("frames"))
    return runs.where(F.col("frames") >= min_frames).drop("island")


def thinned_starts(runs: DataFrame, keys: list[str], min_frames: int) -> DataFrame:
    """Starts within the runs, taken greedily so that each is more than 2 * ``min_frames`` after the one taken before.

    A run offers the starts from which ``min_frames`` frames still lie inside it. The choice depends
    on all before it, so a series' runs are walked in order; runs, not frames, are what is walked.
    """
    schema = ", ".join([*(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys), "start bigint"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, taken = [], None
        for first, last in pdf.sort_values("first")[["first", "last"]].itertuples(index=False):
            at = first if taken is None else max(first, taken + 2 * min_frames + 1)
            while at + min_frames - 1 <= last:
                starts.append(at)
                taken = at
                at += 2 * min_frames + 1
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "start": pd.Series(starts, dtype="int64")})

    return runs.groupBy(*keys).applyInPandas(walk, schema)


def peth(counts: DataFrame, onsets: DataFrame, first: int, last: int, step: int = 1, bin_seconds: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Rates around onsets: keys, onset, rel, rate for each relative bin ``first..last`` of ``step`` frames.

    ``counts`` (keys, frame, n) may leave out empty frames; ``onsets`` (onset). A bin that begins
    before frame 0 has no rate; one beyond the series' end counts what is there.
    """
    keys = keys or []
    bins = onsets.select("onset", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("rel")).withColumn("start", F.col("onset") + F.col("rel") * step)
    if keys:
        bins = bins.crossJoin(counts.select(*keys).distinct())  # a bounded set of units, asked for by the caller
    frames = bins.where("start >= 0").select(*keys, "onset", "rel", F.explode(F.sequence(F.col("start"), F.col("start") + step - 1)).alias("frame"))
    found = frames.join(counts, [*keys, "frame"], "left").groupBy(*keys, "onset", "rel").agg((F.sum(F.coalesce("n", F.lit(0))) / bin_seconds).alias("rate"))
    return bins.select(*keys, "onset", "rel").join(found, [*keys, "onset", "rel"], "left")


#: Events and onsets that a stretch of time holds on average, and onsets looked at together.
STRETCH_ROWS, ONSETS_AT_ONCE = 250_000, 4096


def raster_counts(events: DataFrame, onsets: DataFrame, bin_us: int, bins: int) -> DataFrame:
    """rel, n, onsets: events (us) by whole bins from onsets (onset_id, us), -bins..bins - 1, and the different onsets that have any.

    No pair of event and onset is made. Time is cut into stretches; a task has the onsets of one
    and the events in their reach, sorted, and a bin's events are those before its end less those
    before its begin. Repeated onset ids, if any, are counted by their own.
    """
    reach = bins * bin_us
    extent = events.select("us").unionByName(onsets.select("us")).agg(F.count("us").alias("n"), F.min("us").alias("low"), F.max("us").alias("high")).head()
    width = reach if not extent["n"] else max(bin_us, min(2 * reach, (extent["high"] - extent["low"] + 1) * STRETCH_ROWS // extent["n"]))
    repeated = onsets.where("onset_id IS NOT NULL").groupBy("onset_id").agg(F.count("*").alias("m")).where("m > 1").select("onset_id", F.lit(True).alias("again"))
    marked = onsets.where("us IS NOT NULL").join(repeated, "onset_id", "left")
    again = F.coalesce("again", F.lit(False))
    # an onset counts for n always, for the different onsets once; ids that come again are listed
    points = marked.select(F.floor(F.col("us") / width).alias("stretch"), "us", F.lit(True).alias("onset"), F.when(again, F.col("onset_id")).alias("id"), (F.col("onset_id").isNotNull() & ~again).alias("single"))
    near = F.sequence(F.floor((F.col("us") - reach) / width), F.floor((F.col("us") + reach) / width))
    found = events.where("us IS NOT NULL").select(F.explode(near).alias("stretch"), "us", F.lit(False).alias("onset"), F.lit(None).cast(onsets.schema["onset_id"].dataType).alias("id"), F.lit(False).alias("single"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        us, onset, single = (table[c].to_numpy() for c in ("us", "onset", "single"))
        at, ids = np.sort(us[~onset]), table["id"].filter(pa.array(onset)).combine_chunks()
        order = np.argsort(us[onset], kind="stable")
        starts, single, ids = us[onset][order], single[onset][order], ids.take(pa.array(order))
        n, seen, listed, rels = np.zeros(2 * bins, np.int64), np.zeros(2 * bins, np.int64), [], []
        some = ids.is_valid().to_numpy(zero_copy_only=False)
        for a in range(0, len(starts), ONSETS_AT_ONCE):
            part = slice(a, a + ONSETS_AT_ONCE)
            before = np.searchsorted(at, starts[part] - reach)
            for k in range(2 * bins):
                until = np.searchsorted(at, starts[part] + (k + 1 - bins) * bin_us)
                here, before = until - before, until
                n[k] += here.sum()
                seen[k] += (single[part] & (here > 0)).sum()
                if some[part].any():
                    which = np.flatnonzero((here > 0) & some[part]) + a
                    listed.append(which)
                    rels.append(np.full(len(which), k))
        which, of = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (listed, rels))
        rel = pa.array(np.concatenate((np.arange(2 * bins), of)) - bins, pa.int32())
        none = np.zeros(len(which), np.int64)
        return pa.table({"rel": rel, "n": pa.array(np.concatenate((n, none))), "seen": pa.array(np.concatenate((seen, none))), "id": pa.concat_arrays([pa.nulls(2 * bins, ids.type), ids.take(pa.array(which))])})

    kinds = T.StructType([T.StructField("rel", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("id", onsets.schema["onset_id"].dataType)])
    counted = points.unionByName(found).groupBy("stretch").applyInArrow(count, kinds)
    once = counted.groupBy("rel", "id").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    return once.groupBy("rel").agg(F.sum("n").alias("n"), (F.sum("seen") + F.count("id")).alias("onsets")).where("n > 0")


def mean_and_sem(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), ratio(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def derivative(series: DataFrame, keys: list[str], half: int, fps: float, order: str = "frame", value: str = "value", angle: bool = False) -> DataFrame:
    """First and second derivative by differences over ``half`` frames to each side; angles are wrapped once."""
    by = Window.partitionBy(*keys).orderBy(order)
    first = F.lead(value, half).over(by) - F.lag(value, half).over(by)
    found = series.withColumn("der1", (wrapped(first) if angle else first) * fps / (2 * half))
    return found.withColumn("der2", (F.lead("der1", half).over(by) - F.lag("der1", half).over(by)) * fps / (2 * half))


def self_motion(path: DataFrame, keys: list[str], frames: int, fps: float, order: str = "frame") -> DataFrame:
    """Speed over a window of ``frames`` around each frame, end to end (jump) and along the path (cum), and its parts.

    The window is frame + sm .. frame + em with sm = -floor(frames / 2), em = floor(frames + sm).
    The path's length leaves out the window's last step. ``path``: keys, order, x, y, direction
    (degrees).
    """
    sm = -(frames // 2)
    em = frames + sm
    by = Window.partitionBy(*keys).orderBy(order)

    def at(c: str, k: int):
        return F.lead(c, k).over(by) if k >= 0 else F.lag(c, -k).over(by)

    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(by), 2) + F.pow(F.col("y") - F.lag("y").over(by), 2))
    found = path.withColumn("step", step)
    seconds = frames / fps
    complete = at("x", sm).isNotNull() & at("x", em).isNotNull()
    found = found.withColumns(
        {
            "jump": F.when(complete, F.sqrt(F.pow(at("x", em) - at("x", sm), 2) + F.pow(at("y", em) - at("y", sm), 2)) * 100 / seconds),
            "cum": F.when(complete, F.sum("step").over(by.rowsBetween(sm + 1, em - 1)) * 100 / seconds),
            "turn": F.radians(wrapped(at("direction", em) - at("direction", sm))),
        }
    )
    return found.withColumns({"dx": F.col("jump") * F.sin("turn"), "dy": F.col("jump") * F.cos("turn")}).drop("step", "turn")


def unwrapped(series: DataFrame, keys: list[str], order: str = "frame", value: str = "angle", period: float = 180.0) -> DataFrame:
    """Angles made continuous: each jump is brought to the least by -period, 0 or +period, which then holds on."""
    by = Window.partitionBy(*keys).orderBy(order)
    jump = F.coalesce(F.col(value) - F.lag(value).over(by), F.lit(0.0))
    shift = F.when(jump > period / 2, F.lit(-period)).when(jump < -period / 2, F.lit(period)).otherwise(F.lit(0.0))
    return series.withColumn("shift", shift).withColumn("unwrapped", F.col(value) + F.sum("shift").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("shift")


def linear_fold(frame: str, total: int, folds: int):
    """Fold of a frame: contiguous blocks whose edges are floor(i * total / folds)."""
    edges = [i * total // folds for i in range(1, folds)]
    return sum((F.when(F.col(frame) >= e, 1).otherwise(0) for e in edges), F.lit(0))


def common_events(events: DataFrame, session: str, order: str) -> DataFrame:
    """Of each session the first so many events, numbered from 1 as ``nth``, that every session has as many."""
    least = events.groupBy(session).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    numbered = events.withColumn("nth", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("bigint"))
    return numbered.crossJoin(F.broadcast(least)).where("nth <= least").drop("least")  # one row


def running_mean(rows: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """``mean`` of the n rows around each, fewer at the ends; of an even n one more lies before."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n // 2), (n - 1) // 2)
    return rows.withColumn("mean", F.avg(value).over(by))


def paired_in_order(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    """(nth, first, second): the i-th of one list with the i-th of the other, in the order of names; lists of files are short."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)).cast("bigint") - 1
    return one.select(place.alias("nth"), F.col(name).alias("first")).join(two.select(place.alias("nth"), F.col(name).alias("second")), "nth")


def common_tokens(one: Column, two: Column, between: str) -> Column:
    """Tokens of one name that another has too, in the first one's order."""
    return F.array_join(F.filter(F.split(one, between), lambda x: F.array_contains(F.split(two, between), x)), between)
