"""Token counts of the documents in flat token files, by a scan for the end-of-document id.

A flat file holds nothing but ids, each document's followed by the end id; no index, no lengths.
The scan cuts the files into blocks of equal size. A task searches its block for end ids in one
vectorised pass; a document that crosses blocks is stitched together afterwards: a prefix scan
over the blocks' short summaries gives each block the number of documents before it and the ids
of the document that was still open at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, fresh_path, settle, text_slices, tokenizer_path
from spindrift.llm.files import committed, make_folder, opened
from spindrift.llm.tokens import TEXT_BYTES, encoder

#: Bytes of a file that one task row searches at once.
BLOCK_BYTES = 4 << 20
TOKENIZER, END_ID = "byte_bpe_50k.json", 50256


def write_flat(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat files of little-endian ids in ``folder``.

    One file for each partition, named by its number; ids take 2 bytes if the vocabulary and
    ``end_id`` allow, else 4. Null texts count as empty. Returns (file, nth, doc_id): which
    document is the n-th of a file, which the files themselves don't tell. Reading the result
    writes the files, so read it once (``settle``).
    """
    executors_can_import(docs.sparkSession)
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path(tokenizer))
        width = _width(coder.vocabulary, end_id)
        nth = 0
        first = next(batches, None)
        if first is None:
            return
        with committed(f"{folder}/part-{number:06d}.ids") as stream:
            for batch in text_slices(_chained(first, batches), TEXT_BYTES):
                ids, bounds = coder.encode(batch.column(1))
                out = np.full(len(ids) + batch.num_rows, end_id, width)
                at = np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                out[at] = ids
                stream.write(out.tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(nth, nth + n), pa.int64()), batch.column(0)], names=["file", "nth", "doc_id"]
                )
                nth += n

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(write, "file bigint, nth bigint, doc_id bigint")


def _chained(first, rest):
    yield first
    yield from rest


def _width(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def _search(end_id: int, width: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block: ids before its first end id, counts between end ids, ids after the last."""
        for batch in batches:
            heads, inner, tails, ends = [], [], [], []
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                with opened(path) as file:
                    file.seek(start)
                    ids = np.frombuffer(file.read(length), width)
                at = np.flatnonzero(ids == end_id)
                ends.append(len(at))
                heads.append(int(at[0]) if len(at) else len(ids))
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else 0)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("block"), pa.array(ends, pa.int64()), pa.array(heads, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tails, pa.int64())],
                names=["path", "block", "ends", "head", "inner", "tail"],
            )

    return search


def token_counts(spark: SparkSession, folder: str, end_id: int = END_ID, width: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document in the flat files below ``folder``: path, nth (from 0), n_tokens, ended.

    ``n_tokens`` is without the end id. Ids behind the last end id of a file are a document that
    has no end (``ended`` false). Empty files have no documents; two end ids in a row enclose an
    empty one. A file whose size isn't a multiple of the id's width is an error.
    """
    executors_can_import(spark)
    size = np.dtype(width).itemsize
    step = max(1, block_bytes // size) * size
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", F.col("length").alias("bytes"))
    files = files.withColumn("bytes", F.when(F.col("bytes") % size == 0, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("not whole ids: "), "path")).cast("bigint")))
    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("length"))
    # the rows are few and each stands for megabytes: spread them
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")
    found = settle(blocks.mapInArrow(_search(end_id, width), "path string, block bigint, ends bigint, head bigint, inner array<bigint>, tail bigint"), "blocks")

    by = Window.partitionBy("path").orderBy("block")
    ends, head, tail = F.col("ends"), F.col("head"), F.col("tail")
    scan = found.select("path", "block", "ends", "head", "tail")
    scan = scan.withColumn("running", F.sum(F.when(ends == 0, head).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(ends > 0, F.struct("block", "running", "tail"))).over(before)
    scan = scan.select(
        "path", "block", "ends", "head", "tail",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.lag("running").over(by) - last["running"] + last["tail"], F.lag("running").over(by), F.lit(0)).alias("open"),
        F.lead("block").over(by).isNull().alias("is_last"),
    )
    firsts = scan.where("ends > 0").select("path", F.col("docs_before").alias("nth"), (F.col("open") + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = found.where("ends > 1").select("path", "block", "inner").join(scan.select("path", "block", "docs_before"), ["path", "block"])
    rest = rest.select("path", "docs_before", F.posexplode("inner").alias("i", "n_tokens")).select("path", (F.col("docs_before") + F.col("i") + 1).alias("nth"), "n_tokens", F.lit(True).alias("ended"))
    left = scan.where("is_last").select(
        "path", (F.col("docs_before") + F.col("ends")).alias("nth"),
        F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head")).alias("n_tokens"), F.lit(False).alias("ended"),
    ).where("n_tokens > 0")
    return firsts.unionByName(rest).unionByName(left)


def count_document_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens) of ``docs``: flat files are written, then only they are searched.

    Every row of ``docs`` gives a row, those with equal or null doc_id too; null texts have 0.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "flat")
    names = settle(write_flat(docs, folder, tokenizer, end_id), "flat-names")
    vocabulary = encoder(tokenizer_path(tokenizer)).vocabulary
    counts = token_counts(spark, folder, end_id, _width(vocabulary, end_id))
    counts = counts.withColumn("file", F.regexp_extract("path", r"part-(\d+)\.ids$", 1).cast("bigint"))
    return names.join(counts, ["file", "nth"]).select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_document_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
