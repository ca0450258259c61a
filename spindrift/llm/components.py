"""Connected components of a table of links, by large-star and small-star rounds.

Published as "Connected Components in MapReduce and Beyond" (Kiveris and others, 2014). Links
never reach the driver; each round is two aggregations, two joins and two written tables, from
which a lost executor's work is done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import settle


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that the join with a node of very many links is of two shuffles, which Spark can split
    least = settle(_least_neighbour(both).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that ``links`` (a, b) mentions; root is the component's least node.

    Any orderable type serves as a node. Self-links, repeated links and nulls add nothing; an
    empty table gives an empty table.
    """
    edges = (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = settle(edges, "links")
    before = None
    while True:
        edges = settle(_small_star(_large_star(edges).where("u <> v").distinct()).distinct(), "stars")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        now = (row[0], row[1])
        if now == before or not row[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
