"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

Method (odd sketches: Mitzenmacher, Pagh and Pham, 2014). Each distinct shingle set becomes one
*class* (exact copies and reorderings of equal shingles collapse here, however many there are).
A class has 128 MinHash samples in 32 bands of 4, and an odd sketch: every sample flips one bit
of a 512-bit map, so the XOR of two maps counts the samples in which two classes differ.

Classes are numbered once, when their table is written, so that all later joins and aggregations
run on single 64-bit numbers. Tables that a hot key is joined with are written first: both sides
of such a join are then plain shuffles, whose skewed partitions Spark splits.

Links are found in two passes that never emit all pairs of a band:

1. *Stars*: each member of a band is paired with the band's pivot (its least class). Pairs whose
   sizes or sketches rule out the similarity are dropped, the others confirmed on the full sets.
2. *Open bands*: a band whose members already lie in one component is finished. The classes of
   the others get a second, fine odd sketch of 2048 samples in 8192 bits, and are compared member
   against member inside tasks, in blocks of bounded size. Only pairs of different components
   whose fine estimate reaches ``FINE_FLOOR`` leave the task, to be confirmed on the full sets.
   Each member meets every block of its band. Where a band has so many blocks that it has more of
   them than a class has bands, as a passage shared by very many texts can make, its members are
   instead grouped by their rarest shingles, an exact way (prefix filtering: Chaudhuri, Ganti and
   Kaushik, 2006): of two linked sets, ordered alike, each holds a shingle of the other among its
   own first ``n - ceil(0.75 n) + 1``. Shingles that no other component holds come first in that
   order and need no group, so that texts that have only a passage in common seldom meet; those
   that meet do so in blocks, as many as there are. No group is cut or left out.
   An estimate of ``SURE`` or more joins its two components at once for the rest of the task, so
   that of the pairs between two components few leave it; should such a pair not be confirmed
   after all, the pass is repeated without this.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6, at 0.8 with
5e-8; one shared band is enough, however many members it has. The sketch filters keep estimates
more than four standard deviations below 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, release_memory, settle, text_slices, unused_name
from spindrift.llm.components import connected_components
from spindrift.llm.shingles import shingle_set

SHINGLE_WORDS = 5
MIN_PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_FLOOR = 0.52
FINE_SAMPLES, FINE_WORDS, FINE_FLOOR, SURE = 2048, 128, 0.69, 0.82
#: Members of an open band that one task compares with each other or with as many others.
BLOCK_ROWS = 1024

_random = np.random.default_rng(20240101)
_FACTORS = _random.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_FINE_FACTORS = _random.integers(0, 2**31, FINE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_OFFSETS = _random.integers(0, 2**32, FINE_SAMPLES, dtype=np.uint32)
_BAND_SALTS = _random.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BIT_SALTS = _random.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_FINE_SALTS = _random.integers(0, 2**64, FINE_SAMPLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def min_hashes(shingles: np.ndarray, factors: np.ndarray = _FACTORS, offsets: np.ndarray = _OFFSETS) -> np.ndarray:
    """The least of each of the hashes (128 of them, or as many as ``factors``) over a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for j in range(0, len(factors), 128):
        for i in range(0, len(low), 2048):  # bounds memory on very long texts
            part = low[i : i + 2048, None] * factors[j : j + 128]
            part += offsets[j : j + 128]
            np.minimum(least[j : j + 128], part.min(axis=0), out=least[j : j + 128])
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _BAND_SALTS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray, salts: np.ndarray = _BIT_SALTS, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of the samples that fall on each of ``64 * words`` bits, as 64-bit words."""
    at = _mix(samples.astype(np.uint64) ^ salts) % np.uint64(64 * words)
    parity = np.bincount(at.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def most_differing_bits(floor: float, samples: int = SAMPLES, words: int = SKETCH_WORDS) -> int:
    """Differing bits of two odd sketches whose estimated similarity is still ``floor``."""
    bits = 64 * words
    return int(bits * (1 - np.exp(-4 * samples * (1 - floor) / bits)) / 2)


MARKS = "doc_id bigint, row_key binary, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>, sketch array<bigint>"
#: UTF-8 bytes of texts that a task turns into sets at once.
TEXT_BYTES = 4 << 20


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long_list = pa.list_(pa.int64())
    for batch in text_slices(batches, TEXT_BYTES):
        sizes, digests, bands, sketches = [], [], [], []
        for text in batch.column("text"):
            found = shingle_set(text.as_py(), SHINGLE_WORDS)
            sizes.append(len(found))
            samples = min_hashes(found) if len(found) else None
            digests.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist() if len(found) else (None, None))
            bands.append(band_keys(samples) if len(found) else None)
            sketches.append(odd_sketch(samples) if len(found) else None)
        c1, c2 = zip(*digests, strict=True) if digests else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, long_list), pa.array(sketches, long_list)],
            names=["doc_id", "row_key", "n_shingles", "c1", "c2", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, TEXT_BYTES):
        found = [shingle_set(text.as_py(), SHINGLE_WORDS).view(np.int64) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(found, pa.list_(pa.int64()))], names=["cls", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs with 100 * intersection >= MIN_PERCENT * union; both lists are sorted as unsigned."""
    for batch in batches:
        keep = []
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = np.concatenate((a, b))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= MIN_PERCENT * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release_memory()


def _differing_bits(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def _sizes_allow(left: str, right: str) -> Column:
    return (100 * F.least(left, right)) >= (MIN_PERCENT * F.greatest(left, right))


def _not_ruled_out(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that sizes and sketches leave possible."""
    of = classes.select("cls", "n_shingles", "sketch")
    left = of.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = of.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(_sizes_allow("na", "nb") & (_differing_bits("sa", "sb") <= most_differing_bits(SKETCH_FLOOR)))
        .select("a", "b")
    )


def _row_key() -> Column:
    """A row's doc_id and text as one key; rows of equal keys are exact repeats of each other."""
    doc_id, text = F.col("doc_id").cast("bigint").cast("string"), F.col("text").cast("string")
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(doc_id, F.lit("null")), text)))


def _texts_of(named: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text) of one row for each class; repeats of a row are dropped by the tasks that read them."""
    wanted = named.join(classes.select("cls", "row_key"), "cls")
    return docs.dropDuplicates(["row_key"]).join(wanted, "row_key").select("cls", "text")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among ``pairs``, on the full shingle sets, which are computed for their classes only."""
    named = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _texts_of(named, classes, docs).mapInArrow(_sets, "cls bigint, shingles array<bigint>")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b"
    )
    return both.mapInArrow(_confirmed, "a bigint, b bigint")


def _fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, TEXT_BYTES):
        found = [shingle_set(text.as_py(), SHINGLE_WORDS) for text in batch.column("text")]
        made = [odd_sketch(min_hashes(x, _FINE_FACTORS, _FINE_OFFSETS), _FINE_SALTS, FINE_WORDS).tobytes() for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(made, pa.binary())], names=["cls", "fine"])


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A matrix of lists of one length."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _compare_blocks(prune: bool):
    coarse_most = most_differing_bits(SKETCH_FLOOR)
    fine_most = most_differing_bits(FINE_FLOOR, FINE_SAMPLES, FINE_WORDS)
    sure_most = most_differing_bits(SURE, FINE_SAMPLES, FINE_WORDS)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        """Pairs of different components within one block, or across two, that are not ruled out."""
        by_band, band, i, j = (x.as_py() for x in key)
        sketches, bands = _lists(rows["sketch"], SKETCH_WORDS).view(np.uint64), _lists(rows["bands"], BANDS)
        fine = np.frombuffer(b"".join(rows["fine"].to_pylist()), np.uint64).reshape(len(rows), FINE_WORDS)
        sizes, roots, classes, block = (rows[c].to_numpy() for c in ("n_shingles", "root", "cls", "block"))
        joined = np.unique(roots, return_inverse=True)[1]  # each row's component, merged on the way
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[tuple[int, int, bool]] = []
        for x in left:
            others = right[right > x] if i == j else right
            low, high = np.minimum(sizes[x], sizes[others]), np.maximum(sizes[x], sizes[others])
            others = others[(100 * low >= MIN_PERCENT * high) & (joined[others] != joined[x])]
            others = others[np.bitwise_count(sketches[others] ^ sketches[x]).sum(axis=1) <= coarse_most]
            differ = np.bitwise_count(fine[others] ^ fine[x]).sum(axis=1, dtype=np.int64)
            for k in differ.argsort(kind="stable"):
                if differ[k] > fine_most:
                    break
                y = others[k]
                if joined[x] != joined[y]:
                    sure = bool(differ[k] <= sure_most)
                    # bands shared by two components are all open: the first of them speaks for the pair, or the shingles if that is a large one
                    if not by_band or bands[x][bands[x] == bands[y]][0] == band:
                        found.append((min(classes[x], classes[y]), max(classes[x], classes[y]), sure))
                    if sure and prune:
                        joined[joined == joined[y]] = joined[x]
        a, b, sure = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return compare


def _open_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, prune: bool) -> DataFrame:
    """Possible pairs (a, b, sure) of different components in bands that hold more than one component."""
    labelled = members.join(roots, members.cls == roots.node, "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    opened = settle(_open_groups(labelled), "open-keys")
    rows = settle(labelled.join(opened, "key"), "open-bands")
    few, many = rows.where(F.col("blocks") < BANDS), rows.where(F.col("blocks") >= BANDS).select("cls", "root").distinct()
    columns = ["by_band", "key", "cls", "root", "blocks"]
    rows = few.withColumn("by_band", F.lit(True)).select(columns)
    if not many.isEmpty():
        rows = rows.unionByName(_by_rare_shingles(settle(many, "large-bands"), classes, docs).withColumn("by_band", F.lit(False)).select(columns))
    rows = settle(rows, "open-rows")
    fine = _texts_of(rows.select("cls").distinct(), classes, docs).mapInArrow(_fine_sketches, "cls bigint, fine binary")
    fine = fine.join(classes.select("cls", "n_shingles", "sketch", "bands"), "cls")
    rows = rows.join(settle(fine, "fine-sketches"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks"))
    # each row meets every block once: pairs of blocks (i, j) with i <= j
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.groupBy("by_band", "key", "i", "j").applyInArrow(_compare_blocks(prune), "a bigint, b bigint, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _open_groups(rows: DataFrame) -> DataFrame:
    """Bands with more than one component, and the number of blocks that each has."""
    groups = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return groups.where("low <> high").select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))


def _by_rare_shingles(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Groups (key, cls, root, blocks) of ``members`` (cls, root), such that any two linked ones of different components meet in one.

    A class comes under its first shingles in an order in which those of one component alone are
    first, then the rarest: ``n - ceil(MIN_PERCENT n / 100) + 1`` in all, less the former, which
    no other component has. A class that shares fewer shingles than a link takes is in no group.
    """
    sets = _texts_of(members.select("cls"), classes, docs).mapInArrow(_sets, "cls bigint, shingles array<bigint>")
    sets = settle(sets.join(members, "cls").select("cls", "root", F.size("shingles").alias("size"), "shingles"), "large-sets")
    held = sets.select("cls", "root", "size", F.explode("shingles").alias("key"))
    shared = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    ranked = held.join(settle(shared, "shared-shingles"), "key").groupBy("cls", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("ranked"))
    first = F.expr(f"size(ranked) - ({MIN_PERCENT} * size + 99) div 100 + 1").cast("int")
    rows = ranked.withColumn("first", first).where("first > 0").select("cls", "root", F.explode(F.slice("ranked", 1, F.col("first"))).alias("at"))
    rows = settle(rows.select("cls", "root", F.col("at.key").alias("key")), "rare-shingles")
    # the shingles of a passage have the same members: one of them is enough
    alike = [F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")]
    groups = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *alike).where("low <> high")
    groups = groups.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return rows.join(settle(groups.select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "open-shingles"), "key")


def _classes(marks: DataFrame) -> DataFrame:
    """One row for each shingle set: its number, digest, least doc_id, and the key of one row with it."""
    one = marks.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("least"), F.first("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    return settle(one.withColumn("cls", F.monotonically_increasing_id()), "classes")


def _links(classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) of classes, enough to connect all that are linked; and their components (node, root)."""
    rows = classes.select("cls", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("cls").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = settle(rows.join(settle(shared, "shared-bands"), "key"), "members")

    stars = members.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    links = settle(_confirm(settle(_not_ruled_out(stars, classes), "stars"), classes, docs), "links")
    roots = connected_components(links)
    for prune in (True, False):
        more = settle(_open_pairs(members, classes, roots, docs, prune), "open")
        if more.isEmpty():
            break
        found = settle(_confirm(more.select("a", "b"), classes, docs), "more-links")
        links = links.union(found)
        roots = connected_components(links)
        if more.where("sure").join(found, ["a", "b"], "left_anti").isEmpty():
            break
    return links, roots


def _judged(docs: DataFrame) -> DataFrame:
    """Each row of ``docs``: doc_id, row_key, n_shingles, cls, component (null without words), component_id."""
    executors_can_import(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), _row_key().alias("row_key"))
    marks = settle(docs.mapInArrow(_signatures, MARKS), "signatures")
    classes = _classes(marks)
    _, roots = _links(classes, docs)
    # least doc_ids by class, then by component: a component's rows never meet in one task
    linked = classes.select("cls", "least").join(roots, F.col("cls") == F.col("node")).select("cls", "root", "least")
    least = settle(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = roots.join(least, "root").select("node", "root", "component_id")
    named = classes.select("c1", "c2", "cls", "least").join(named, F.col("cls") == F.col("node"), "left").select(
        "c1", "c2", "cls", F.coalesce("root", "cls").alias("component"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    )
    rows = marks.select("doc_id", "row_key", "n_shingles", "c1", "c2").join(settle(named, "named-classes"), ["c1", "c2"], "left")
    return rows.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shingle count, class and component.

    Returns doc_id, n_shingles, cls (null for texts without words), component_id (the least
    doc_id of the component; its own doc_id for a text without words) and kept (doc_id equals
    component_id). Null texts count as empty. A null doc_id gets a component_id only from other
    rows and is kept only if there is none. Rows that repeat a doc_id are judged one by one.
    Other columns of ``docs`` are ignored; an empty table gives an empty table.
    """
    return _judged(docs).select("doc_id", "n_shingles", "cls", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: one of the least doc_id, nulls last.

    Texts without words are linked with nothing: all their rows stay. Repeated rows are one
    component; of rows that differ in other columns only, any stays. Other columns may have any
    names. An empty table gives an empty table.
    """
    key = unused_name(docs, "row_key")
    rows = _judged(docs).where("component IS NOT NULL AND doc_id <=> component_id")
    chosen = rows.groupBy("component").agg(F.min("row_key").alias(key)).select(key)
    # exact repeats of a row go first, within the tasks that read them
    named = docs.withColumn(key, _row_key()).dropDuplicates([key]).join(chosen, key).select(*docs.columns)
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return named.unionByName(docs.where(~words))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair that shares a shingle, and reachability by recursion: right at small sizes, as a check.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * n >= 75 * (na + nb - n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""
