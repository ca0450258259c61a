"""Places, lineage cuts and small checks that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public tokenizer files; ``tokenizer_path`` looks there unless told otherwise.
TOKENIZERS = "public_tokenizers"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where a local session names neither (a test), a temporary folder is made and removed
    when Python ends. On a cluster that is an error: each machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = getattr(spark, "_spindrift_shared", None)
    if current is None:
        current = spark._spindrift_shared = tempfile.mkdtemp(prefix="spark-spindrift-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    return f"file://{current}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Later steps survive a lost executor without repeating the work before the cut.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def executors_can_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (a plain checkout)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies, on whichever machine this runs."""
    import importlib

    return importlib.import_module(TOKENIZERS).path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if ``df`` has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_memory() -> None:
    """Give what this process has freed back to the system: workers stay between tasks, beside others that need the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: int | str = "text") -> Iterator[pa.RecordBatch]:
    """All batches in slices of bounded texts; what the work on a slice took goes back to the system after it."""
    for batch in batches:
        for part in slices(batch, column, most_bytes):
            yield part
            release_memory()


def slices(batch: pa.RecordBatch, column: int | str, most_bytes: int = 16 << 20):
    """The batch in runs of rows whose texts have about ``most_bytes`` together; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and held + size > most_bytes:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield batch.slice(low)
