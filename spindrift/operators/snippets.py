"""Pieces of a raw recording around spikes, and the mean waveform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.functions.batches import tasks
from spindrift.functions.bins import md5_uniform
from spindrift.sources.arrays import ranges_read, read_runs

#: Samples in which spikes and files meet.
STRETCH = 65_536


def drawn(rows: DataFrame, keys: list[str], at: str, picks: int) -> DataFrame:
    """``picks`` rows of each group of ``keys``, those of the least portable random numbers; all of a smaller group.

    Rows are counted by steps of their numbers' logarithm, which merges before the shuffle; the
    step that holds the last pick bounds what is ranked to about a tenth more than the picks, so
    a hot group is never sorted whole. ``at`` names a row within its group: repeats count once.
    """
    named = rows.dropDuplicates([*keys, at]).withColumn("by", md5_uniform(F.lit("snippet"), *keys, at))
    step = F.floor(-8 * F.log2(F.greatest(F.col("by"), F.lit(2.0**-33)))).cast("int")
    named = named.withColumn("step", step)
    counts = named.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    lower = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("step"))) - F.col("n")  # at most 265 steps a group
    last = counts.withColumn("lower", lower).where(F.col("lower") < picks).groupBy(*keys).agg(F.min("step").alias("last"))
    few = named.join(last, keys).where(F.col("step") >= F.col("last"))
    return few.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("by", at))).where(F.col("nth") <= picks).drop("by", "step", "last", "nth")


def _pieces(spikes: DataFrame, files: DataFrame, channels: int, before: int, length: int, picks: int | None) -> DataFrame:
    """session, unit, sample, channel of the spikes that ``snippets`` reads, with rel, path, start and n of each piece of a window."""
    keys = ["session", "unit"]
    ends = files.groupBy("session").agg(F.max(F.col("first") + F.col("samples")).alias("end"))
    whole = spikes.select(*keys, F.col("sample").cast("bigint").alias("sample"), F.col("channel").cast("int").alias("channel")).dropna().join(ends, "session")
    whole = whole.where((F.col("sample") >= before) & (F.col("sample") - before + length <= F.col("end")) & F.col("channel").between(0, channels - 1)).drop("end")
    chosen = whole.dropDuplicates([*keys, "sample"]) if picks is None else drawn(whole, keys, "sample", picks)
    low, high = F.col("sample") - before, F.col("sample") - before + length
    stretches = lambda a, b: F.explode(F.sequence(F.floor(a / STRETCH), F.floor((b - 1) / STRETCH)))
    windows = chosen.withColumns({"low": low, "high": high}).withColumn("stretch", stretches(F.col("low"), F.col("high")))
    parts = files.withColumn("stretch", stretches(F.col("first"), F.col("first") + F.col("samples")))
    met = windows.join(parts, ["session", "stretch"])
    begin = F.greatest("low", "first", F.col("stretch") * STRETCH)
    stop = F.least("high", F.col("first") + F.col("samples"), (F.col("stretch") + 1) * STRETCH)
    pieces = met.withColumns({"begin": begin, "stop": stop}).where(F.col("begin") < F.col("stop"))
    return pieces.select(*keys, "sample", "channel", (F.col("begin") - F.col("low")).cast("int").alias("rel"), "path", (F.col("begin") - F.col("first")).alias("start"), (F.col("stop") - F.col("begin")).cast("int").alias("n"))


def snippets(spikes: DataFrame, files: DataFrame, channels: int, before: int = 20, length: int = 82, around: int = 2, picks: int | None = 1_000) -> DataFrame:
    """What ``files`` (session, path, first, samples) hold around ``spikes`` (session, unit, sample, channel).

    Of each unit ``picks`` spikes are drawn (all with None) whose whole window, ``before`` samples
    before the spike to ``length`` in all, lies in the session. Returned are session, unit, sample,
    rel (the piece's first sample from the window's start), channel and values, for the unit's
    ``channel`` and up to ``around`` on each side, as far as there are any. A window over the
    end of a file or of a stretch comes in pieces, one after another by rel. Repeated spikes count
    once; rows with nulls, with a channel that isn't there, or of sessions without files are left out.
    """
    near = F.sequence(F.greatest(F.lit(0), F.col("channel") - around), F.least(F.lit(channels - 1), F.col("channel") + around))
    pieces = _pieces(spikes, files, channels, before, length, picks).select("session", "unit", "sample", "rel", "path", "start", "n", near.alias("wanted"))
    read = ranges_read(pieces, channels)
    each = read.select("session", "unit", "sample", "rel", "n", "values", F.posexplode("wanted").alias("k", "channel"))
    return each.select("session", "unit", "sample", "rel", "channel", F.slice("values", F.col("k") * F.col("n") + 1, F.col("n")).alias("values"))


def mean_snippets(found: DataFrame, scale: float = 1.0) -> DataFrame:
    """(session, unit, channel, at, n, mean) of ``snippets``: the mean at each sample of the window, times ``scale``.

    Sums are of whole numbers and merge before the shuffle; no unit's snippets are gathered.
    """
    each = found.select("session", "unit", "channel", "rel", F.posexplode("values").alias("k", "x"))
    sums = each.groupBy("session", "unit", "channel", (F.col("rel") + F.col("k")).alias("at")).agg(F.count("*").alias("n"), F.sum(F.col("x").cast("bigint")).alias("total"))
    return sums.select("session", "unit", "channel", "at", "n", (F.col("total") / F.col("n") * F.lit(scale)).alias("mean"))


#: Pieces that a task looks at together, and units times channels whose sums it holds.
PIECES, SUMS = 10_000, 8_192


def _sums(pieces: dict[str, np.ndarray], group: np.ndarray, channels: int, length: int, around: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns group, channel, at, n, total of pieces, whose groups are numbered in order."""
    edges = np.searchsorted(group, np.arange(group[-1] + 2))
    low = np.maximum(np.minimum.reduceat(pieces["channel"], edges[:-1]) - around, 0)
    span = int((np.minimum(np.maximum.reduceat(pieces["channel"], edges[:-1]) + around, channels - 1) - low).max()) + 1
    step = max(1, SUMS // span)
    for first in range(0, len(low), step):
        a, b = edges[first], edges[min(first + step, len(low))]
        order = np.lexsort((pieces["start"][a:b], pieces["path"][a:b])) + a
        part = {c: v[order] for c, v in pieces.items()}
        of, base = group[order] - first, low[group[order]]
        wanted = np.clip(part["channel"][:, None] + np.arange(-around, around + 1), 0, channels - 1)
        n, total = np.zeros((2, min(step, len(low) - first) * span * length))
        runs = read_runs(part["path"].tolist(), part["start"].tolist(), part["n"].tolist(), [wanted.shape[1]] * len(order), channels)
        for i, k, read, data in runs:
            lengths = part["n"][i:k]
            piece = np.repeat(np.arange(i, k), lengths)
            within = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sample, at = part["start"][piece] - read + within, part["rel"][piece] + within
            for d in range(-around, around + 1):
                channel = part["channel"][piece] + d
                there = (channel >= 0) & (channel < channels)
                key = ((of[piece] * span + channel - base[piece]) * length + at)[there]
                np.add.at(n, key, 1.0)
                np.add.at(total, key, data[sample[there], channel[there]].astype(float))
        at = np.flatnonzero(n)
        which = at // (span * length)
        yield {"group": which + first, "channel": at // length % span + low[which + first], "at": at % length, "n": n[at].astype(np.int64), "total": total[at].astype(np.int64)}


def drawn_means(spikes: DataFrame, files: DataFrame, channels: int, before: int = 20, length: int = 82, around: int = 2, picks: int | None = 1_000, scale: float = 1.0) -> DataFrame:
    """``mean_snippets`` of ``snippets`` without a shuffle of samples: a unit's windows are read, and added up, in one task.

    Only where windows lie is dealt out, by units. A task reads its units' windows in order of
    file and sample, near ones at once; what it holds is bounded. Made for ``picks`` a task can read.
    """
    pieces = _pieces(spikes, files, channels, before, length, picks).select("session", "unit", "channel", "rel", "path", "start", "n")
    kinds = StructType([pieces.schema["session"], pieces.schema["unit"], *StructType.fromDDL("channel int, at int, n bigint, total bigint")])

    def added(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = [table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("session", "unit")]
        new = np.append(True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))
        columns = {c: table[c].to_numpy() for c in ("channel", "rel", "path", "start", "n")}
        rows = np.flatnonzero(new)
        for found in _sums(columns, np.cumsum(new) - 1, channels, length, around):
            at = pa.array(rows[found.pop("group")])
            whose = [table[c].combine_chunks().take(at) for c in ("session", "unit")]
            numbers = [pa.array(v.astype(np.int32 if c in ("channel", "at") else np.int64)) for c, v in found.items()]
            yield pa.RecordBatch.from_arrays([*whose, *numbers], names=kinds.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PIECES:
                table = pa.Table.from_batches(held)
                last = [pc.equal(table[c], table[c][-1]) for c in ("session", "unit")]
                cut = n - int(pc.sum(pc.and_(*last)).as_py())  # the last unit may go on
                if cut:
                    yield from added(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from added(pa.Table.from_batches(held))

    # by hash: small rows, but what they read isn't
    dealt = pieces.repartition(tasks(spikes.sparkSession), "session", "unit").sortWithinPartitions("session", "unit")
    return dealt.mapInArrow(each, kinds).select("session", "unit", "channel", "at", "n", (F.col("total") / F.col("n") * F.lit(scale)).alias("mean"))
