"""Workloads: generated operations, their replay against a model, latency and throughput."""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Operations and their weights.
MIXES = {
    "commit": {"PUT": 40, "GET": 30, "DEL": 15, "SCAN": 10, "FLUSH": 4, "REOPEN": 1},
    "stress": {"SET": 40, "GET": 35, "DEL": 10, "EXISTS": 7, "SCAN": 8},
}
ZIPF = 1.1
PREFIX = "shared/prefix/of/many/keys/"


def generate(spark: SparkSession, n: int, keys: int, mix: dict[str, int], distribution: str = "uniform", seed: int = 1, value_bytes: int = 16) -> DataFrame:
    """n operations (op_id, kind, key, value, count) over a key space: uniform, zipf, sequential or prefix keys.

    Every row follows from a hash of the seed and its number, so any part can be made anywhere again.
    """
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "op_id"), F.lit(1 << 30)) / float(1 << 30)
    total = sum(mix.values())
    kind, r = F.lit(next(iter(mix))), unit("kind") * total
    for name, end in list(zip(mix, accumulate(mix.values()), strict=True))[::-1]:
        kind = F.when(r < end, F.lit(name)).otherwise(kind)
    u = unit("key")
    number = {
        "uniform": F.floor(u * keys),
        "prefix": F.floor(u * keys),
        "sequential": F.pmod(F.col("op_id"), F.lit(keys)),
        # The inverse of the continuous power law that a Zipf distribution follows.
        "zipf": F.floor(F.pow(1 + u * (keys ** (1 - ZIPF) - 1), F.lit(1 / (1 - ZIPF)))) - 1,
    }[distribution]
    key = F.concat(F.lit(PREFIX if distribution == "prefix" else "key:"), F.lpad(number.cast("long").cast("string"), 8, "0"))
    value = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "op_id"), 256), 1, value_bytes)
    ops = spark.range(n).select(F.col("id").alias("op_id")).withColumn("kind", kind)
    writes = F.col("kind").isin("PUT", "SET")
    return ops.select("op_id", "kind", key.alias("key"), F.when(writes, value).alias("value"), F.when(F.col("kind") == "SCAN", F.lit(10)).alias("count"))


def as_log(ops: DataFrame) -> DataFrame:
    """The mutations among operations: sequence op_id + 1."""
    rows = ops.where(F.col("kind").isin("PUT", "SET", "DEL"))
    return rows.select("key", (F.col("op_id") + 1).alias("seq"), (F.col("kind") == "DEL").alias("tombstone"), "value")


def replay_reads(ops: DataFrame) -> DataFrame:
    """What each GET must answer: op_id, key, value (null: absent) of the last write before it.

    Reads and writes of a key meet in one window over its operations.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("op_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.where(F.col("kind").isin("PUT", "SET", "DEL", "GET"))
    write = F.when(F.col("kind") != "GET", F.struct("value"))
    return rows.withColumn("_last", F.last(write, ignorenulls=True).over(w)).where("kind = 'GET'").select("op_id", "key", F.col("_last.value").alias("value"))


def first_divergence(expected: DataFrame, found: DataFrame) -> DataFrame:
    """No row, or the first operation whose answers differ."""
    other = found.select("op_id", F.col("value").alias("found"))
    return expected.join(other, "op_id", "full").where("not (value <=> found)").orderBy("op_id").limit(1)


def latency_percentiles(ops: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Exact p50, p95, p99, p99.9 and max."""
    grouped = ops.groupBy(*([by] if by else []))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return grouped.agg(*(F.percentile(column, p).alias(n) for n, p in points.items()), F.max(column).alias("max"))


def throughput(ops: DataFrame, ts: str, every: str = "1 second") -> DataFrame:
    """(at, n): operations in each tumbling window."""
    return ops.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("at"), "n")


def shrink(ops: list, still_fails: Callable[[list], bool]) -> list:
    """A short list of operations that still fails: parts are cut out, halves first, single ones last."""
    size = max(1, len(ops) // 2)
    while True:
        start = 0
        while start < len(ops):
            fewer = ops[:start] + ops[start + size :]
            if fewer and still_fails(fewer):
                ops = fewer
            else:
                start += size
        if size == 1:
            return ops
        size //= 2


def soak(spark: SparkSession, chunks: int, ops: int, check: Callable[[DataFrame], bool], seed: int = 1) -> int | None:
    """Runs check on generated chunks of operations; the seed of the first that fails, or None."""
    seeds = random.Random(seed)
    for _ in range(chunks):
        s = seeds.randrange(1 << 30)
        if not check(generate(spark, ops, 2048, MIXES["commit"], seed=s)):
            return s
    return None
