"""Arrays in flat files: recordings of interleaved int16 channels, ``.npy`` arrays; written and read by ranges of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spindrift.functions.places import settled
from spindrift.sources.tables import listing

#: Rows in a written file.
FILE_ROWS = 65_536
#: Most bytes that a task reads or yields at a time.
READ_BYTES = 8 << 20
#: Bytes between two wanted ranges that are read along rather than skipped.
GAP_BYTES = 1 << 16
#: Most pieces cut from one read.
READ_PIECES = 4_096


def _written(rows: DataFrame, folder: str, suffix: str, encode: Callable[[np.ndarray, int], bytes], file_rows: int) -> DataFrame:
    """Files of ``file_rows`` rows each of ``rows`` (sample, values), and their table (path, first, samples).

    Samples count from 0 without gaps or repeats, and all values are as long; anything else is an
    error. A file is written under a name of its own and then renamed, so a repeated task does no harm.
    """

    def put(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample")
        at = table["sample"].to_numpy()
        first = int(at[0])
        if first % file_rows or (np.diff(at) != 1).any():
            raise ValueError(f"samples have gaps or repeats behind {first}")
        values = table["values"].combine_chunks()
        if values.null_count or len(set(values.value_lengths().to_pylist())) != 1:
            raise ValueError("values are missing or differ in length")
        system, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        name, draft = f"{base}/{first:015d}.{suffix}", f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(encode(values.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1), first))
        system.move(draft, name)
        return pa.table({"path": [f"{folder if ':' in folder else f'file://{folder}'}/{first:015d}.{suffix}"], "first": pa.array([first], pa.int64()), "samples": pa.array([len(table)], pa.int64())})

    parts = rows.select("sample", "values", F.floor(F.col("sample") / file_rows).alias("part"))
    found = settled(parts.groupBy("part").applyInArrow(put, "path string, first bigint, samples bigint"), "files")
    n, short, end = found.agg(F.count("*"), F.count(F.when(F.col("samples") < file_rows, 1)), F.max(F.col("first") + F.col("samples"))).head()
    if n and not (short <= 1 and (n - 1) * file_rows < end <= n * file_rows):
        raise ValueError("samples have gaps")
    return found


def write_recording(rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """``rows`` (sample, values) as files of interleaved little-endian int16; gives (session, path, first, samples), session 0."""
    found = _written(rows.select(F.col("sample").cast("bigint").alias("sample"), F.col("values").cast("array<smallint>").alias("values")), folder, "bin", lambda v, _: v.astype("<i2").tobytes(), file_rows)
    return found.select(F.lit(0).alias("session"), "path", "first", "samples")


def write_npy(rows: DataFrame, folder: str, fortran: bool = False, file_rows: int = FILE_ROWS) -> DataFrame:
    """``rows`` (sample, values) as ``.npy`` files of doubles in either memory order; gives (path, first, samples)."""

    def encode(values: np.ndarray, _: int) -> bytes:
        from io import BytesIO

        out = BytesIO()
        np.lib.format.write_array(out, np.asarray(values, "<f8", order="F" if fortran else "C"), allow_pickle=False)
        return out.getvalue()

    return _written(rows.select(F.col("sample").cast("bigint").alias("sample"), F.col("values").cast("array<double>").alias("values")), folder, "npy", encode, file_rows)


def recording_files(spark: SparkSession, path: str, channels: int, session: Column | None = None, pattern: str = "*.bin") -> DataFrame:
    """(session, path, first, samples) of the recordings below ``path``.

    Files of a session follow each other by name. ``session`` is made of ``path``, 0 for all
    without it. What is left of a sample at the end of a file is left out, as are files without any.
    """
    whole = listing(spark, path, pattern).select((F.lit(0) if session is None else session).alias("session"), "path", F.floor(F.col("bytes") / (2 * channels)).alias("samples")).where("samples > 0")
    earlier = F.sum("samples").over(Window.partitionBy("session").orderBy("path")) - F.col("samples")  # a row for each file
    return whole.select("session", "path", earlier.alias("first"), "samples")


def read_runs(paths: list[str], starts: list[int], lengths: list[int], widths: list[int], channels: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Runs of near pieces, in order of path and start, read at once: first piece, end, the first sample read, samples by channels.

    ``widths`` are the channels wanted of each piece: what a run holds is bounded by ``READ_BYTES`` (or one piece).
    """
    size = 2 * channels
    open_path, file, i = None, None, 0
    try:
        while i < len(paths):
            low, high, k, held = starts[i], starts[i] + lengths[i], i + 1, lengths[i] * widths[i] * 2
            while k < len(paths) and k - i < READ_PIECES and paths[k] == paths[i] and starts[k] * size <= high * size + GAP_BYTES:
                end, more = max(high, starts[k] + lengths[k]), lengths[k] * widths[k] * 2
                if (end - low) * size > READ_BYTES or held + more > READ_BYTES:
                    break
                high, held, k = end, held + more, k + 1
            if paths[i] != open_path:
                if file is not None:
                    file.close()
                system, at = fs.FileSystem.from_uri(paths[i])
                open_path, file = paths[i], system.open_input_file(at)
            file.seek(low * size)
            data = np.frombuffer(file.read((high - low) * size), "<i2").reshape(-1, channels)
            if len(data) < high - low:
                raise ValueError(f"{open_path} ends before sample {high}")
            yield i, k, low, data
            i = k
    finally:
        if file is not None:
            file.close()


def ranges_read(pieces: DataFrame, channels: int) -> DataFrame:
    """Pieces of recordings: (..., path, start, n, wanted) with ``values`` (channels of ``wanted`` one after another, n each).

    ``start`` is the piece's first sample in its file. Pieces are dealt by ranges of path and
    start, so those of one task lie side by side; near ones are read at once, others skipped.
    No more than ``READ_BYTES`` (or one piece) are held, however many pieces there are.
    """
    names = pieces.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, lengths, wanted = (batch.column(c).to_pylist() for c in ("path", "start", "n", "wanted"))
            for i, k, low, data in read_runs(paths, starts, lengths, [len(w) for w in wanted], channels):
                found = [data[s - low : s - low + n, w].T.ravel() for s, n, w in zip(starts[i:k], lengths[i:k], wanted[i:k], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, k - i).columns, values], names=[*names, "values"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    session = pieces.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # pieces are small, what they read isn't
    return pieces.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(read, f"{kinds}, values array<smallint>")


class _Rows(InputPartition):
    """Rows ``low`` to ``high`` of one array."""

    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns lie together, type and place of the data of an open ``.npy`` file."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    if kind.hasobject or kind.names or kind.kind not in "biuf":
        raise ValueError(f"an array of {kind} has no plain numbers")
    return shape or (1,), fortran and len(shape) > 1, kind, file.tell()


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _files(self) -> list[str]:
        system, base = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(base).type == fs.FileType.File:
            return [base]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".npy"))

    def partitions(self) -> list[_Rows]:
        """Ranges of rows; of each file only the header is read here."""
        system, _ = fs.FileSystem.from_uri(self.path)
        found = []
        for name in self._files():
            with system.open_input_file(name) as file:
                shape, _, kind, _ = _header(file)
            step = self.rows or max(1, (32 << 20) // max(1, kind.itemsize * prod(shape[1:])))
            found += [_Rows(name, low, min(low + step, shape[0])) for low in range(0, shape[0], step)]
        return found or [_Rows("", 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if partition.low >= partition.high:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            shape, fortran, kind, data = _header(file)
            width = prod(shape[1:])
            step = max(1, READ_BYTES // max(1, 8 * width))
            for low in range(partition.low, partition.high, step):
                n = min(step, partition.high - low)
                if fortran:  # each column's rows lie together, the first of the further axes running fastest
                    columns = np.empty((n, width), kind)
                    for j in range(width):
                        file.seek(data + (j * shape[0] + low) * kind.itemsize)
                        columns[:, j] = np.frombuffer(file.read(n * kind.itemsize), kind)
                    values = columns.reshape(n, *shape[1:], order="F").reshape(n, width)
                else:
                    file.seek(data + low * width * kind.itemsize)
                    values = np.frombuffer(file.read(n * width * kind.itemsize), kind).reshape(n, width)
                flat = pa.array(np.ascontiguousarray(values, "<f8").ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(low + np.arange(n), pa.int64()), lists], names=["path", "row", "values"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: (path, row, values) of an array, or of all ``.npy`` files below a folder.

    The first axis gives the rows, the others are put one after another as in row order. Numbers
    and booleans become doubles; other types are an error, and nothing is unpickled. A task reads
    ``rows`` rows (by default 32 MB), from a column-ordered file each column's part. An array
    without rows gives none; one number gives one row.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row bigint, values array<double>"

    def reader(self, schema) -> NpyReader:
        path = self.options["path"]
        return NpyReader(path if ":" in path else f"file://{path}", int(self.options.get("rows", "0")))


def npy(spark: SparkSession, path: str, rows: int = 0) -> DataFrame:
    """``.npy`` arrays at or below ``path`` as (path, row, values); see ``NpySource``."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rows", str(rows)).load(path)
