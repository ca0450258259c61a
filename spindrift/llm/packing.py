"""Packing of documents into sequences of a fixed number of tokens.

Method: linear grouping (Fernandez de la Vega and Lueker, 1981), configurations by linear
programming (Gilmore and Gomory, 1961), best fit for what is small.

1. Documents longer than a sequence are cut from the end; every piece has 1 to ``capacity`` tokens.
   Full pieces are sequences of their own.
2. Only the histogram of lengths, at most ``capacity`` rows however large the corpus, reaches
   the driver. Lengths above ``SMALL_SHARE`` of the capacity are sorted and dealt to groups of
   equal cardinality; each group is rounded up to its longest length.
3. A linear program over configurations (multisets of the few group sizes that fit a sequence)
   is solved by column generation and rounded down.
4. Actual lengths take the places of their group in descending order, the last place of a
   sequence whichever fits best, so which lengths meet, and the gap that is left, is known in
   runs of equal sequences.
5. What rounding left over, and all small pieces, go by best fit decreasing into those gaps,
   run by run, and into new sequences where no gap suffices.

The plan is a table of runs: the ranks ``first..first + n - 1`` among the pieces of one length go
to sequences ``sequence..sequence + n - 1`` at one offset. Its size depends on the capacity, not
on the corpus, so it is broadcast, and each piece finds its place by its length and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import executors_can_import, settle, text_slices, tokenizer_path
from spindrift.llm.tokens import TEXT_BYTES, encoder

CAPACITY, TOKENIZER, END_ID = 1024, "byte_bpe_50k.json", 2
#: Lengths up to this share of the capacity are small.
SMALL_SHARE = 1 / 16
#: Groups that the large lengths are rounded to.
GROUPS = 96
#: The linear program ends when its bound is this close, or after so many columns.
LP_GAP, LP_COLUMNS = 1e-3, 1000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): ids, then ``end_id``; longer ones cut, the first piece may be shorter.

    ``part`` and ``nth`` number the pieces of one length within a task. Null texts count as empty.
    """
    executors_can_import(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder = TaskContext.get().partitionId(), encoder(tokenizer_path(tokenizer), plain=False)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_slices(batches, TEXT_BYTES):
            ids, bounds = coder.encode(batch.column(1))
            sizes = np.diff(bounds) + 1
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(batch.num_rows), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            short = sizes - (counts - 1) * capacity  # tokens of the first piece
            length = np.where(piece == 0, short[row], capacity)
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            checks = np.empty(len(row), np.int64)
            at = 0
            for i in range(batch.num_rows):
                raw = memoryview(np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4").view(np.uint8))
                for _ in range(counts[i]):
                    checks[at] = zlib.crc32(raw[4 * start[at] : 4 * (start[at] + length[at])])
                    at += 1
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.searchsorted(ranked, ranked)
            nth = np.empty(len(row), np.int64)
            nth[order] = seen[ranked] + np.arange(len(row)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(checks), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def linear_groups(sizes: list[int], counts: list[int], groups: int) -> list[list[int]]:
    """Indices into ``sizes`` (descending), dealt to at most ``groups`` groups of about equal cardinality.

    Equal lengths stay together: they are rounded to the same size at no loss.
    """
    total, dealt, found = sum(counts), 0, []
    for i, n in enumerate(counts):
        if not found or dealt * groups >= total * len(found):
            found.append([])
        found[-1].append(i)
        dealt += n
    return found


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits the capacity with the largest total value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    at = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fit = np.searchsorted(-at, -room)  # sizes descend: the first that fits
        gain = best[room - at[fit:]] + values[fit:]
        i = int(gain.argmax())
        best[room], took[room] = best[room - 1], -1
        if gain[i] > best[room]:
            best[room], took[room] = gain[i], fit + i
    made, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            made[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), made


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(sequences, how many of each size one holds): the linear program's optimum, rounded down."""
    k = len(sizes)
    need = np.array(counts, float)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / columns.diagonal())
    used = inverse @ need
    for _ in range(LP_COLUMNS):
        prices = inverse.sum(axis=0)
        worth, column = best_configuration(sizes, prices, capacity)
        if worth <= 1 + LP_GAP:
            break
        turn = inverse @ column
        ratio = np.full(k, np.inf)
        np.divide(used, turn, out=ratio, where=turn > 1e-9)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        used -= step * turn
        used[leaves] = step
        np.clip(used, 0, None, out=used)
        pivot = inverse[leaves] / turn[leaves]
        inverse -= np.outer(turn, pivot)
        inverse[leaves] = pivot
        columns[:, leaves] = column
    return [(int(n), columns[:, j].astype(int).tolist()) for j, n in enumerate(np.floor(used + 1e-6)) if n >= 1]


class Plan:
    """Runs of equal sequences and the places of lengths in them."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = dict(histogram)
        self.next_rank = defaultdict(int)
        self.sequences = 0
        #: length, first rank, number, first sequence, offset
        self.runs: list[tuple[int, int, int, int, int]] = []
        #: gap -> runs of sequences with that gap: (first sequence, number)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self._known: list[int] = []
        self.large = sorted(x for x, n in histogram.items() if n and capacity * SMALL_SHARE < x < capacity)

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], n, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def add_gap(self, gap: int, sequence: int, n: int) -> None:
        if gap > 0:
            if not self.gaps[gap]:
                bisect.insort(self._known, gap)
            self.gaps[gap].append((sequence, n))

    def fill_configuration(self, times: int, groups: list[list[int]]) -> None:
        """Up to ``times`` sequences of actual lengths for one configuration, given as its groups' lengths.

        Each place takes its group's longest length that is left; the last one takes the longest
        of all that fits, so what rounding up left free in the other places isn't lost. When a
        group has run out, or a sequence would hold less than its groups' shortest lengths, the
        configuration ends: what is left goes by best fit.
        """
        done, planned = 0, sum(group[-1] for group in groups)
        while done < times:
            taken: list[int] = []
            for group in groups[:-1]:
                taken += [x for x in group if self.left[x] > taken.count(x)][:1]
            if len(taken) < len(groups) - 1:
                return
            room = self.capacity - sum(taken)
            for i in range(bisect.bisect_right(self.large, room) - 1, -1, -1):
                if self.left[self.large[i]] > taken.count(self.large[i]):
                    taken.append(self.large[i])
                    break
            if sum(taken) < planned:
                return
            n = min(times - done, *(self.left[x] // taken.count(x) for x in set(taken)))
            sequence, offset = self.open(n), 0
            for length in taken:
                self.place(length, n, sequence, offset)
                offset += length
            self.add_gap(self.capacity - offset, sequence, n)
            done += n

    def best_fit(self) -> None:
        """All that is left, longest first, each into the smallest gap that holds it."""
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(self._known, length)
                if at < len(self._known):
                    gap = self._known[at]
                    sequence, n = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        del self._known[at]
                else:
                    gap = self.capacity
                    n = -(-self.left[length] // (gap // length))
                    sequence = self.open(n)
                self._fill(length, gap, sequence, n)

    def _fill(self, length: int, gap: int, sequence: int, n: int) -> None:
        """As many of one length as a gap holds into the first sequences of a run, the rest into one more."""
        most = gap // length
        full, over = divmod(min(self.left[length], n * most), most)
        used = self.capacity - gap
        if full:
            for i in range(most):
                self.place(length, full, sequence, used + i * length)
            self.add_gap(gap - most * length, sequence, full)
        if over:
            for i in range(over):
                self.place(length, 1, sequence + full, used + i * length)
            self.add_gap(gap - over * length, sequence + full, 1)
        rest = n - full - bool(over)
        if rest:
            self.add_gap(gap, sequence + full + bool(over), rest)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Where the pieces of each length go; ``histogram`` counts them by length (1 to ``capacity``)."""
    plan = Plan(histogram, capacity)
    if full := histogram.get(capacity):
        plan.place(capacity, full, plan.open(full), 0)
    if large := plan.large[::-1]:
        dealt = linear_groups(large, [histogram[x] for x in large], groups)
        members = [[large[i] for i in group] for group in dealt]
        counts = [sum(histogram[x] for x in group) for group in members]
        for times, column in sorted(configurations([group[0] for group in members], counts, capacity), reverse=True):
            plan.fill_configuration(times, [members[j] for j, n in enumerate(column) for _ in range(n)])
    plan.best_fit()
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``PIECES``, settled) with sequence_id and offset: at most ``capacity`` tokens in a sequence, without gaps."""
    spark = pieces.sparkSession
    counts = settle(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_packing(histogram, capacity)
    kinds = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "low", "n", "sequence", "offset")])
    runs = spark.createDataFrame(plan.runs, kinds).withColumn("high", F.col("low") + F.col("n")).drop("n")
    # a row for each length and task; a length's earlier tasks give the rank of its first piece in this one
    by = Window.partitionBy("length").orderBy("part")
    before = counts.select("length", "part", (F.sum("n").over(by) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    # the plan's rows depend on the capacity alone
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as
    empty: their only token is the end id. Rows with equal or null doc_id are packed one by one.
    An empty table gives an empty table.
    """
    return pack(settle(cut_pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
