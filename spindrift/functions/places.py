"""Where to write what is read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only a local session may name neither: it gets a temporary folder, removed when Python ends.
    On a cluster that is an error, as each machine would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = getattr(spark, "_spindrift_scratch", None)
        if shared is None:
            shared = spark._spindrift_scratch = tempfile.mkdtemp(prefix="spark-spindrift-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and there for a repeated task."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
