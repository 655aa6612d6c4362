"""Connected components of a graph of long ids, by alternating large and small stars.

Each round is two joins and two pre-aggregated groupings over the edges, written to the
shared folder. Rounds grow with the logarithm of the component size; nothing but a
count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Written


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u points to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its neighbours, all below it, point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v) but the roots themselves; the root is a component's least id."""
    now, before = Written(edges.where("u != v"), "edges"), None
    while True:
        new = Written(_small(_large(now.read())), "edges")
        now.drop()
        now = new
        mark = now.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.read().select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
