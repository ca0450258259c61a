"""Updates of a result table in its place."""

from __future__ import annotations

import os

import pytest
from pyspark.sql.types import StructType

from spindrift.sources import updates

KIND = "day string, unit int, n bigint, note string"


@pytest.fixture
def path(spark, tmp_path):
    rows = [("01", 1, 10, "a"), ("01", 2, 20, None), ("01", None, 30, "c"), ("02", 1, 40, "d"), ("03", 1, 50, "e"), (None, 7, 60, "f")]
    spark.createDataFrame(rows, KIND).write.partitionBy("day").parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def read(spark, path):
    day = StructType.fromDDL("day string")
    return sorted(((r.day, r.unit, r.n, r.note) for r in updates.table_at(spark, path, day).collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "day=01" not in d and "day=__" not in d and "day=04" not in d}


def test_touched_partitions_only(spark, path):
    before = files(path)
    changes = spark.createDataFrame([("01", 1, 11), ("01", 1, 11), ("01", None, None), ("01", 9, 90), ("04", 1, 70), (None, 7, 61)], "day string, unit int, n bigint")
    wanted = sorted([("01", 1, 11, "a"), ("01", 2, 20, None), ("01", None, None, "c"), ("01", 9, 90, None), ("02", 1, 40, "d"), ("03", 1, 50, "e"), ("04", 1, 70, None), (None, 7, 61, "f")], key=str)
    staged = updates.update(spark, path, changes, ["unit"], ["day"])
    assert read(spark, path) == wanted and files(path) == before
    assert {r.day for r in staged.collect()} == {"01", "04", None}
    updates.update(spark, path, changes, ["unit"], ["day"])  # again
    updates.put(staged, path, ["day"])
    assert read(spark, path) == wanted and files(path) == before


def test_faulty_changes_write_nothing(spark, path):
    before = read(spark, path)
    with pytest.raises(Exception, match="changes differ for 01, 1"):
        updates.update(spark, path, spark.createDataFrame([("01", 1, 1), ("01", 1, 2)], "day string, unit int, n bigint"), ["unit"], ["day"])
    with pytest.raises(ValueError, match="no other"):
        updates.update(spark, path, spark.createDataFrame([("01", 1, 1)], "day string, unit int, other int"), ["unit"], ["day"])
    updates.update(spark, path, spark.createDataFrame([], "day string, unit int, n bigint"), ["unit"], ["day"])
    assert read(spark, path) == before
