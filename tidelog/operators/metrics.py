"""Sizes, amplification and the info table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import ENTRY_OVERHEAD, user_bytes
from tidelog.operators import compact, layout, ranks
from tidelog.operators.state import live, newest


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def written_bytes(log: DataFrame) -> DataFrame:
    """bytes that users wrote: key and value, keys alone for deletes, absent keys included."""
    return log.agg(F.coalesce(F.sum(user_bytes(F.col("key"), F.col("value"))), F.lit(0)).alias("user_bytes"))


def live_bytes(log: DataFrame) -> DataFrame:
    """bytes of the live state, each key once."""
    return live(log).agg(F.coalesce(F.sum(user_bytes(F.col("key"), F.col("value"))), F.lit(0)).alias("live_bytes"))


def memtable_size(log: DataFrame) -> DataFrame:
    """bytes that all versions cost in memory."""
    return log.agg(F.coalesce(F.sum(user_bytes(F.col("key"), F.col("value")) + ENTRY_OVERHEAD), F.lit(0)).cast("long").alias("memtable_size"))


def rotations(log: DataFrame, threshold: int, group: str = "level") -> DataFrame:
    """How often a memtable of threshold bytes rotates: it is emptied before a write once it holds that much.

    A group's writes are sorted and read as a stream by one task, as each rotation follows from the one before; none are gathered.
    """
    size = (user_bytes(F.col("key"), F.col("value")) + ENTRY_OVERHEAD).cast("long").alias("size")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, some = None, 0, 0, False
        for b in batches:
            ended = []
            for g, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if some and g != now:
                    ended.append(n)
                if not some or g != now:
                    now, held, n, some = g, 0, 0, True
                if held >= threshold:
                    held, n = 0, n + 1
                held += x
            yield pa.record_batch([pa.array(ended, pa.int64())], ["rotations"])
        if some:
            yield pa.record_batch([pa.array([n], pa.int64())], ["rotations"])

    rows = log.select(F.col(group).alias("g"), "seq", size).repartition("g").sortWithinPartitions("g", "seq", "size")
    return rows.mapInArrow(fold, "rotations long")


def space_amplification(files: DataFrame, log: DataFrame) -> DataFrame:
    one = layout.disk_bytes(files).crossJoin(live_bytes(log))  # a row each
    return one.select(ratio(F.col("bytes"), F.col("live_bytes")).alias("space_amplification"))


def write_amplification(flushed: DataFrame, compacted: DataFrame, log: DataFrame) -> DataFrame:
    """Bytes of flushed and compacted files over user bytes."""
    a = layout.disk_bytes(flushed).withColumnRenamed("bytes", "flush_bytes").crossJoin(layout.disk_bytes(compacted).withColumnRenamed("bytes", "compaction_bytes"))
    one = a.crossJoin(written_bytes(log))  # a row each
    return one.select("flush_bytes", "compaction_bytes", "user_bytes", ratio(F.col("flush_bytes") + F.col("compaction_bytes"), F.col("user_bytes")).alias("write_amplification"))


def read_amplification(lookups: DataFrame, files: DataFrame) -> DataFrame:
    """Tables opened a lookup, if each candidate file is opened; every row of lookups counts.

    A file's lookups are those not above its largest key less those below its smallest: counts from one ordered pass, no pairs.
    """
    edges = files.select(F.explode(F.array(F.struct(F.col("largest").alias("bound"), F.lit(True).alias("inclusive")), F.struct(F.col("smallest").alias("bound"), F.lit(False).alias("inclusive")))).alias("x")).select("x.*")
    below = ranks.counted_below(lookups, "key", edges)
    opened = below.agg(F.coalesce(F.sum(F.when(F.col("inclusive"), F.col("n")).otherwise(-F.col("n"))), F.lit(0)).alias("table_reads"))
    one = lookups.agg(F.count("*").alias("gets")).crossJoin(opened)  # a row each
    return one.select("gets", "table_reads", ratio(F.col("table_reads"), F.col("gets")).alias("read_amplification"))


def unfiltered_lookups(entries: DataFrame, keys: DataFrame, files: DataFrame) -> DataFrame:
    """bloom.lookups() without filters, of every row of keys in each file whose range has it. No pairs are made.

    Without a filter each probe opens its file, so probes and opened are counts below the file's bounds. Found are the keys of a file's own entries that
    are asked, once for each row that asks. Files that nobody asks have no row.
    """
    asked = layout.candidate_counts(keys, files).where("n > 0").select("file_number", F.col("n").alias("probes"), F.lit(0).cast("long").alias("rejects"), F.col("n").alias("opened"))
    times = keys.groupBy("key").agg(F.count("*").alias("_times"))
    has = entries.select("key", "file_number").distinct().join(files.select("file_number", "smallest", "largest"), "file_number").where("key >= smallest and key <= largest")
    found = has.join(times, "key").groupBy("file_number").agg(F.sum("_times").alias("found"))
    return asked.join(found, "file_number", "left").select("file_number", "probes", "rejects", "opened", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def hit_rate(trace: DataFrame) -> DataFrame:
    """hits, misses and hit_rate of a replayed trace (column hit)."""
    return trace.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def compaction_stats(results: DataFrame) -> DataFrame:
    """Totals over compaction results (bytes_read, bytes_written)."""
    return results.agg(F.count("*").alias("compactions"), F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"), F.coalesce(F.sum("bytes_written"), F.lit(0)).alias("bytes_written"))


def spread(compacted_keys: DataFrame, key_number: str, low: int, high: int, buckets: int = 10) -> DataFrame:
    """(bucket, n): compacted keys in each of equal ranges of numbers from low to high."""
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col(key_number) - low) * buckets / (high - low))).cast("long")
    return compacted_keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def memtable_running(log: DataFrame) -> DataFrame:
    """Versions with the bytes held after each, in seq order within a file: the running size a rotation looks at."""
    w = Window.partitionBy("file_number").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("file_number", "seq", F.sum(user_bytes(F.col("key"), F.col("value")) + ENTRY_OVERHEAD).over(w).cast("long").alias("held"))


def info(log: DataFrame, files: DataFrame, options: compact.Options = compact.Options()) -> DataFrame:
    """(section, name, value) of every figure that data can tell; process facts are left out, not zeroed."""

    def rows(section: str, df: DataFrame, *names: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("x")).select("section", "x.name", "x.value")

    state = newest(log).agg(F.count_if(~F.col("tombstone")).alias("keys"))
    table = log.agg(F.max("seq").alias("last_sequence"), F.sum(user_bytes(F.col("key"), F.col("value")) + ENTRY_OVERHEAD).alias("memtable_size"), F.sum(user_bytes(F.col("key"), F.col("value"))).alias("user_bytes"))
    levels = compact.scores(files, options)
    per_level = levels.select(F.lit("levels").alias("section"), F.explode(F.array(*(F.struct(F.concat(F.lit("level"), F.col("level").cast("string"), F.lit(f"_{n}")).alias("name"), F.col(n).cast("double").alias("value")) for n in ("files", "bytes", "target_bytes")))).alias("x")).select("section", "x.name", "x.value")
    parts = [
        rows("keyspace", state, "keys"),
        rows("memtable", table, "memtable_size", "last_sequence"),
        rows("amplification", table, "user_bytes"),
        rows("amplification", layout.disk_bytes(files).withColumnRenamed("bytes", "disk_bytes_live"), "disk_bytes_live"),
        rows("amplification", live_bytes(log).withColumnRenamed("live_bytes", "logical_bytes_live"), "logical_bytes_live"),
        rows("amplification", space_amplification(files, log), "space_amplification"),
        rows("compaction", files.where("level = 0").agg(F.count("*").alias("l0_files")), "l0_files"),
        per_level,
    ]
    return reduce(DataFrame.unionByName, parts)
