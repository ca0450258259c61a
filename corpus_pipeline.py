"""A training corpus from raw documents: quality rules, near-dedup, decontamination, packing.

Every stage takes rows as they come: a null text counts as empty, a doc_id may be null or repeated
and names no row by itself, texts of any length are taken whole, and columns beside doc_id and
text may have any names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import read, settle
from spindrift.llm.decontaminate import drop_leaks
from spindrift.llm.near_dup import keep_representatives
from spindrift.llm.packing import pack_documents
from spindrift.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by its own text; null and empty texts go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id, nulls last.

    Rows that share the least doc_id, and repeats of a row, leave one; texts without words all stay.
    """
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, each row judged by its own text; empty texts stay, and null items match nothing."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences; an empty text is its end id alone."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Near-dedup's components and packing's plan have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
