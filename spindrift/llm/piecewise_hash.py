"""Context-triggered piecewise hashing: fingerprints that stay alike when a part of a text changes.

A hash of the last seven bytes, computed at every byte, ends a chunk where its low bits are zero
(Kornblum, 2006), so boundaries depend on the text around them alone and fall in place again
behind an edit. A chunk's signature is two letters of its hash. The block size is a power of two
that gives about 64 to 128 chunks by the length of the text; a fingerprint holds the signatures
at that size and at the double, so texts whose sizes differ by a factor of two still compare, by
edit distance. Nothing is cut: a text of any length is hashed to its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, read, settle, text_slices

CHUNKS, WINDOW, LEAST_BLOCK = 128, 7, 2
#: Bytes of texts whose hashes are computed at once.
SLICE_BYTES = 4 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a 32-bit hash of it and the six before it (zeros before the first)."""
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)))
    h = np.zeros(len(data), np.uint32)
    for i in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += padded[i : i + len(data)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, hashes: np.ndarray, block: int) -> str:
    """Two letters for each chunk. Where a repetitive text ends chunks far too often, of each run of equal chunks three are kept."""
    ends = np.flatnonzero((hashes & np.uint32(block - 1)) == 0) + 1
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    codes = [xxhash.xxh32_intdigest(data[low:high]) & 0xFFF for low, high in zip(cuts, cuts[1:], strict=False)]
    if len(codes) > 4 * CHUNKS:
        codes = [c for i, c in enumerate(codes) if i < 3 or codes[i - 3 : i] != [c] * 3]
    return "".join(_LETTERS[c >> 6] + _LETTERS[c & 63] for c in codes)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at the double block``; of an empty or null text, the least block and empty signatures."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hashes = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    return f"{block}:{_signature(data, hashes, block)}:{_signature(data, hashes, 2 * block)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit for each chunk of ``a``."""
    places: dict[str, int] = {}
    for i, chunk in enumerate(a):
        places[chunk] = places.get(chunk, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for chunk in b:
        hit = row & places.get(chunk, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    one, two = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    edits = len(one) + len(two) - 2 * _common(one, two)
    return 1 - edits / (len(one) + len(two))


def likeness(a: str, b: str) -> float:
    """1 less insertions and deletions by chunk over the chunks of both, at a block size that both have; 0 if they have none."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    pairs = [(p, q) for i, p in ((int(x), x1), (2 * int(x), x2)) for j, q in ((int(y), y1), (2 * int(y), y2)) if i == j and (p or q)]
    return _alike(*pairs[0]) if pairs else 0.0  # the finest one


def edited_text(text: str, following: str) -> str:
    """``text`` whose last quarter of code points gives way to as many of the first of ``following``, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    edited = edited_text(text, following)
    changed = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): its fingerprint, and how alike it is to its edited text's and the next row's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Rows
    follow each other by doc_id, nulls first, those of one doc_id by a hash of their text; behind
    the last comes the first, and a lone row follows itself. Null texts count as empty. Other
    columns are left out; an empty table gives an empty one.

    Texts are dealt by ranges once. A task compares the rows of its range; where two ranges meet,
    the last row of one and the first of the next are written aside and compared in a second
    step, so no order over all rows is ever in one task.
    """
    spark = docs.sparkSession
    executors_can_import(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "row"]  # the row's number lets a doc_id that fills a third of the table be dealt, too
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = _ARROW.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        blank = (None,) * len(_ARROW)
        for batch in text_slices(batches, SLICE_BYTES):
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                here = doc_id, text, fingerprint(text)
                if held is None:
                    done.append((*blank, part, "first", text))
                else:
                    done.append((*_compared(*held, text, here[2]), part, None, None))
                held = here
            yield _batch(done, schema)
        if held is not None:
            yield _batch([(held[0], *blank[1:], part, "last", held[1])], schema)

    written = settle(rows.mapInArrow(within, f"{_ROW}, part int, edge string, text string"), "piecewise")
    edges = written.where(F.col("edge").isNotNull())
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())  # numbers of tasks
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    met = edges.where("edge = 'last'").select("doc_id", "text", "part").join(follows, "part").join(first, "next_part").select("doc_id", "text", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_compared(r["doc_id"], r["text"], fingerprint(r["text"]), r["following"], fingerprint(r["following"])) for r in batch.to_pylist()], _ARROW)

    names = _ARROW.names
    return written.where(F.col("edge").isNull()).select(*names).unionByName(met.mapInArrow(across, _ROW).select(*names))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
