"""Global row numbers and counts below bounds, without a single-partition window.

Rows are cut into ranges of a key at sampled quantiles, a window works within each range, and the ranges' sums, a
row each, carry over what lies before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for a range, and for all ranges.
SAMPLED, MOST_SAMPLED = 64, 65_536


def cuts(df: DataFrame, by: str, parts: int) -> list:
    """parts - 1 keys at most that cut a random sample of the keys, MOST_SAMPLED at most, into even parts."""
    keep = min(SAMPLED * parts, MOST_SAMPLED)
    sample = sorted(r[0] for r in df.select(by).where(F.col(by).isNotNull()).orderBy(F.rand(7)).limit(keep).collect())
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def range_of(key: str, at: list) -> Column:
    """How many of the sorted cuts are not above the key: a search in two steps over the square root of their number each."""
    if not at:
        return F.lit(0)
    step = math.isqrt(len(at) - 1) + 1
    rows = [at[k : k + step] for k in range(0, len(at), step)]
    literal = lambda xs: F.array(*map(F.lit, xs))
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col(key)))
    row = below(literal([r[0] for r in rows]))
    inside = below(F.element_at(F.array(*map(literal, rows)), row))
    return F.coalesce(F.when(row > 0, (row - 1) * step + inside), F.lit(0))


def _before(cut: DataFrame, n: Column) -> DataFrame:
    """_range and _before, the sum of n over all ranges below; a row for each range."""
    sums = cut.groupBy("_range").agg(n.alias("_n"))
    return sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, by: str, name: str, parts: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """df with name: the row's place from 1 in the order of by, then of the columns in then; nulls come first.

    Rows with one key fall in one range, so keys should repeat little. Ranges are parts, a row each on the driver.
    """
    cut = df.withColumn("_range", range_of(by, cuts(df, by, _parts(df, parts))))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by, *then))
    placed = cut.withColumn("_within", within).join(F.broadcast(_before(cut, F.count("*"))), "_range")
    return placed.withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_range", "_within", "_before")


def counted_below(rows: DataFrame, by: str, bounds: DataFrame, parts: int | None = None) -> DataFrame:
    """bounds (bound, inclusive) with n: how many rows have a key below the bound, or not above it where inclusive.

    One ordered pass over distinct keys and bounds; no row is paired with a bound.
    """
    keys = rows.groupBy(F.col(by).alias("_key")).agg(F.count("*").alias("_count")).withColumn("_order", F.lit(1))
    asked = bounds.withColumn("_key", F.col("bound")).withColumn("_order", F.when(F.col("inclusive"), 2).otherwise(0))
    at = cuts(keys, "_key", _parts(rows, parts))
    every = keys.unionByName(asked, allowMissingColumns=True).withColumn("_range", range_of("_key", at))
    running = F.coalesce(F.sum("_count").over(Window.partitionBy("_range").orderBy("_key", "_order").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    before = _before(every, F.coalesce(F.sum("_count"), F.lit(0)))
    placed = every.withColumn("_running", running).where("_order <> 1").join(F.broadcast(before), "_range")
    return placed.withColumn("n", (F.col("_running") + F.col("_before")).cast("long")).select(*bounds.columns, "n")
