"""Shuffling of a corpus into shards by a two-pass external shuffle.

First pass: each record goes to one of many buckets that fit in memory, by seeded hashes. The
shard follows from doc_id and the number of shards alone (jump consistent hash, Lamping and
Veach, 2014), so one more shard takes rows only into itself; within its shard, a record's bucket
is a uniform draw by the hash of a row number, so neither a doc_id nor a text that fills a third
of the corpus fills one bucket. Second pass: each bucket is put in random order by a seeded
Fisher-Yates shuffle and written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, fresh_path, shuffle_partitions

#: Bytes of records that a bucket holds on average, and the fixed cost of a record.
BUCKET_BYTES, RECORD_BYTES = 8 << 20, 16
SEED = 20240501


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key: changes with one more shard only to that shard.

    The published loop draws the number of shards at which a key next moves. Here each number is
    asked in turn: a key moves to shard b when its b-th draw falls below 1 / (b + 1); the last
    such b is the shard.
    """
    found = F.lit(0)
    for b in range(1, shards):
        draw = F.pmod(F.xxhash64(key, F.lit(b)), F.lit(1 << 52).cast("bigint")) * F.lit(b + 1)
        found = F.when(draw < F.lit(1 << 52), F.lit(b)).otherwise(found)
    return found


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniformly random order of ``n`` rows; ``Generator.permutation`` is a Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed))).permutation(n)


def shard_records(docs: DataFrame, folder: str, shards: int = 40, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) in random order to Parquet files below ``folder``, one folder for each shard.

    Returns the written rows: doc_id, text, size, shard, grown_shard, bucket, place (within the
    bucket). ``size`` is the UTF-8 bytes of the text, none for a null text, plus 16. Rows of
    equal doc_id share a shard; a null doc_id counts as a value of its own. Other columns are
    left out; an empty table gives an empty folder.
    """
    spark = docs.sparkSession
    executors_can_import(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + RECORD_BYTES
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed))
    total = rows.agg(F.sum(size)).head()[0] or 0
    buckets = max(1, round(total / shards / bucket_bytes))
    rows = rows.withColumns({"key": key, "row": F.monotonically_increasing_id()})
    rows = rows.select("doc_id", "text", jump_hash(F.col("key"), shards).alias("shard"), jump_hash(F.col("key"), shards + 1).alias("grown_shard"), "row")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(buckets)).cast("int"))

    def shuffled(key: tuple, bucket: pa.Table) -> pa.Table:
        shard, number = (x.as_py() for x in key)
        order = fisher_yates(bucket.num_rows, [seed, shards, shard, number])
        # rows arrive in any order; a fixed one first makes a repeated task give the same result
        at = np.argsort(bucket.column("row").to_numpy())[order]
        place = pa.array(np.arange(bucket.num_rows), pa.int64())
        return bucket.take(pa.array(at)).drop_columns("row").append_column("place", place)

    # tasks by the data's size: eight buckets or so for each, one after the other
    tasks = max(shuffle_partitions(spark), -(-total // (8 * bucket_bytes)))
    done = rows.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(shuffled, "doc_id bigint, text string, shard int, grown_shard int, bucket int, place bigint")
    done.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    written = spark.read.schema("doc_id bigint, text string, grown_shard int, bucket int, place bigint, shard int").parquet(folder)
    return written.withColumn("size", size)


def shard_digest(written: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of what ``shard_records`` has written.

    Slots number a shard's rows from 0: its buckets one after the other, each in its shuffled order.
    """
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    # checksums first: the join then moves no text
    rows = written.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    return rows.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard", "bucket")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_digest(shard_records(docs, fresh_path(spark, "shards")))
