"""Updates of a partitioned result table in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spindrift.functions.places import settled


def table_at(spark: SparkSession, path: str, partitions: StructType) -> DataFrame:
    """The Parquet table at ``path``, its partition columns of the types given rather than guessed from folder names."""
    kept = [f for f in spark.read.parquet(path).schema if f.name not in partitions.names]
    return spark.read.schema(StructType([*kept, *partitions])).parquet(path)


def update(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], partition_by: list[str]) -> DataFrame:
    """Set the columns of ``changes`` in the rows of the table at ``path`` with equal ``keys`` and ``partition_by``.

    Rows that the table lacks are added, their other columns null; columns it lacks are an error.
    Null keys equal each other. Repeats of a change count once, two changes of one row that differ
    are an error, before anything is written. A row doesn't move between partitions.

    Only the partitions that ``changes`` names are read and replaced. What will stand there is
    written to a place of its own first, and only then put in theirs, so the table is never read
    while it is written. Returned is that staged table: should the driver be lost between two
    partitions, writing it again completes the update, as does calling this again with the same
    changes where no partition is missing. Without changes nothing is written.
    """
    by = [*partition_by, *keys]
    table = table_at(spark, path, StructType([changes.schema[p] for p in partition_by]))
    if missing := sorted(set(changes.columns) - set(table.columns)):
        raise ValueError(f"the table has no {', '.join(missing)}")
    values = [c for c in changes.columns if c not in by]
    one = changes.distinct().groupBy(*by).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in values))
    name = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in by))
    sure = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("changes differ for "), name)).cast("boolean"))
    new = settled(one.select(*by, *values, sure.alias("_set")), "changes").select(*(F.col(c).alias(f"_new_{c}") for c in [*by, *values]), "_set")
    touched = new.select(*(f"_new_{p}" for p in partition_by)).distinct()
    same = lambda columns: [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns]
    old = table.join(touched, same(partition_by), "left_semi").withColumn("_old", F.lit(True))
    both = old.join(new, same(by), "full")

    def value(field: StructField):
        c = field.name
        if c in values:
            found = F.when(F.col("_set"), F.col(f"_new_{c}")).otherwise(F.col(c))
        elif c in by:
            found = F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        else:
            found = F.col(c)
        return found.cast(field.dataType).alias(c)

    staged = settled(both.select(*(value(f) for f in table.schema)), "staged")
    put(staged, path, partition_by)
    return staged


def put(staged: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace those partitions of the table at ``path`` that ``staged`` has rows of, and no others."""
    if not staged.isEmpty():
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
