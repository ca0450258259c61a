"""Token ids of documents in length-delimited binary record files with an offset index.

A data file is a run of frames, one for each document::

    length  uint64   bytes of the record
    check   uint32   masked CRC-32 of those 8 bytes
    record  length bytes
    check   uint32   masked CRC-32 of the record

    record: flags uint8 (1: doc_id is null; 2: ids take 4 bytes, else 2), doc_id int64, ids

Everything is little-endian. A CRC is masked as ``rotate right by 15, plus 0xa282ead8``, so that
checksums of data that hold checksums stay sound. Beside ``part-N.rec`` lies ``part-N.idx``: for
each frame its offset (uint64), with which any record can be read alone, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, fresh_path, release_memory, settle, shuffle_partitions, text_slices, tokenizer_path
from spindrift.llm.files import committed, make_folder, opened
from spindrift.llm.tokens import TEXT_BYTES, encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Bytes of a file that one row of the reading stage covers; a longer record stands alone.
RUN_BYTES = 4 << 20
RUNS = "part bigint, path string, run bigint, first bigint, n_records bigint, at bigint, bytes bigint"
_FRAME, _HEAD = struct.Struct("<Q"), struct.Struct("<Bq")
_CHECK = struct.Struct("<I")
_NULL_ID, _WIDE = 1, 2


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    length = _FRAME.pack(len(record))
    return b"".join((length, _CHECK.pack(masked_crc(length)), record, _CHECK.pack(masked_crc(record))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The record framed at ``at``, and where the next frame begins; ValueError if a checksum differs."""
    length = bytes(data[at : at + 8])
    (check,) = _CHECK.unpack(data[at + 8 : at + 12])
    if check != masked_crc(length):
        raise ValueError(f"length of the record at {at} is damaged")
    (size,) = _FRAME.unpack(length)
    record = data[at + 12 : at + 12 + size]
    if len(record) < size or _CHECK.unpack(data[at + 12 + size : at + 16 + size])[0] != masked_crc(record):
        raise ValueError(f"record at {at} is damaged")
    return record, at + 16 + size


def pack_record(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return _HEAD.pack((doc_id is None) * _NULL_ID | wide * _WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_record(record: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _HEAD.unpack_from(record)
    return None if flags & _NULL_ID else doc_id, np.frombuffer(record, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size)


def write_records(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) to record files in ``folder``, in ascending doc_id order.

    File numbers follow the order too. Nulls come first; rows of equal doc_id are ordered by a
    hash of the text, and a doc_id with very many rows spreads over several files. Null texts
    count as empty and give a record with the end id only. Returns a row (``RUNS``) for each run
    of about ``run_bytes`` of a file: its number, its first record, how many it has, and where
    its bytes lie. No documents give no runs. Reading the result writes the files, so read it
    once (``settle``).
    """
    spark = docs.sparkSession
    executors_can_import(spark)
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, coder, at = TaskContext.get().partitionId(), encoder(tokenizer_path(tokenizer), plain=False), 0
        wide = max(coder.vocabulary - 1, end_id) >= 1 << 16
        path = f"{folder}/part-{number:06d}"
        runs: list[dict] = []
        with committed(f"{path}.rec") as data, committed(f"{path}.idx") as index:
            for batch in text_slices(batches, TEXT_BYTES):
                ids, bounds = coder.encode(batch.column("text"))
                starts = []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    made = frame(pack_record(doc_id, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)), wide))
                    if not runs or runs[-1]["bytes"] + len(made) > run_bytes:
                        first = runs[-1]["first"] + runs[-1]["n_records"] if runs else 0
                        runs.append({"part": number, "path": path, "run": len(runs), "first": first, "n_records": 0, "at": at, "bytes": 0})
                    runs[-1]["n_records"] += 1
                    runs[-1]["bytes"] += len(made)
                    data.write(made)
                    starts.append(at)
                    at += len(made)
                index.write(np.array(starts, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist(runs, _RUNS)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # the hash takes the rows of one doc_id apart; the row number does so for equal texts
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    return rows.select("doc_id", "text").mapInArrow(write, RUNS)


_RUNS = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RUNS.split(", ")])


def read_records(runs: DataFrame) -> DataFrame:
    """Read the runs that ``write_records`` has named: part, run, nth, doc_id, ids, n_tokens, in_run, ids_crc32.

    Each task finds its records by the offset index and verifies both checksums of each;
    ``in_run`` counts the ids of the run's earlier records. A damaged file raises an error.
    """
    spark = runs.sparkSession
    executors_can_import(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, path, run, first, n, at, size = (batch.column(c)[row].as_py() for c in _RUNS.names)
                with opened(f"{path}.idx") as index:
                    index.seek(8 * first)
                    starts = np.frombuffer(index.read(8 * n), "<u8").astype(np.int64) - at
                with opened(f"{path}.rec") as file:
                    file.seek(at)
                    data = memoryview(file.read(size))
                names, found = [], []
                for start in starts.tolist():
                    doc_id, ids = unpack_record(unframe(data, start)[0])
                    names.append(doc_id)
                    found.append(ids.astype(np.int32))
                sizes = np.array([len(ids) for ids in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part), pa.int64()), pa.array(np.full(n, run), pa.int64()), pa.array(np.arange(first, first + n), pa.int64()), pa.array(names, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(found))),
                        pa.array(sizes), pa.array(np.cumsum(sizes) - sizes),
                        pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                    ],
                    names=["part", "run", "nth", "doc_id", "ids", "n_tokens", "in_run", "ids_crc32"],
                )
        release_memory()

    # the rows are few and each stands for megabytes: spread them
    spread = runs.repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)), "part", "run")
    return spread.mapInArrow(read, "part bigint, run bigint, nth bigint, doc_id bigint, ids array<int>, n_tokens bigint, in_run bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to record files, read these back, and return what they hold of each document.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the
    little-endian unsigned 32-bit ids), part, nth.
    """
    spark = docs.sparkSession
    written = settle(write_records(docs, fresh_path(spark, "records"), tokenizer, end_id), "record-runs")
    rows = settle(read_records(written).drop("ids"), "records-read")
    runs = rows.groupBy("part", "run").agg(F.sum("n_tokens").alias("ids_in_run"))
    parts = runs.groupBy("part").agg(F.sum("ids_in_run").alias("ids_in_part"))
    # a row for each file: few, however many documents there are
    parts = parts.select("part", (F.sum("ids_in_part").over(Window.orderBy("part")) - F.col("ids_in_part")).alias("before_part"))
    runs = runs.select("part", "run", (F.sum("ids_in_run").over(Window.partitionBy("part").orderBy("run")) - F.col("ids_in_run")).alias("before_run"))
    starts = runs.join(parts, "part").select("part", "run", (F.col("before_part") + F.col("before_run")).alias("before"))
    return rows.join(starts, ["part", "run"]).select("doc_id", (F.col("before") + F.col("in_run")).alias("start"), "n_tokens", "ids_crc32", "part", "nth")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
