"""The data model: one row for each version of a key.

mutations: key, seq, tombstone, value (null for a tombstone). Keys order as bytes; among versions of a key
the highest seq is the newest. All operators accept string or binary keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MUTATIONS = "key binary not null, seq bigint not null, tombstone boolean not null, value binary"
ENTRIES = f"file_number bigint, level int, {MUTATIONS}"
FILES = "level int, file_number bigint, size bigint, smallest binary, largest binary, smallest_seq bigint, largest_seq bigint, entry_count bigint, distinct_keys bigint"
EDITS = "edit_id bigint, ordinal int, kind string, level int, file_number bigint, size bigint, smallest binary, largest binary, smallest_seq bigint, largest_seq bigint, counter_value bigint"
OPS = "op_id bigint, kind string, key string, value string, count int, latency_ms double, ts timestamp_ntz"

#: Level layout. Fixed values.
LEVELS = 7


def events_log(spark: SparkSession, sf_dir: str, per_file: int = 500, events: DataFrame | None = None) -> DataFrame:
    """The events table (or a stream of it) as a mutation log: a version for each event, errors delete, files of per_file events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        gone.alias("tombstone"),
        F.when(~gone, F.col("props")).alias("value"),
        F.floor(F.col("event_id") / per_file).cast("long").alias("file_number"),
        F.lit(0).alias("level"),
    )


def orders_log(spark: SparkSession, sf_dir: str, per_file: int = 1000) -> DataFrame:
    """The orders table as a mutation log of customers: ten times more keys, half the versions delete."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.col("o_orderstatus") == "F"
    return o.select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderkey").alias("seq"),
        gone.alias("tombstone"),
        F.when(~gone, F.col("o_orderpriority")).alias("value"),
        F.floor(F.col("o_orderkey") / per_file).cast("long").alias("file_number"),
        F.lit(0).alias("level"),
    )


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of a version in a file, by the declared size model."""
    from tidelog.functions.keys import FILE_ENTRY_OVERHEAD, user_bytes

    return (user_bytes(key, value) + FILE_ENTRY_OVERHEAD).cast("long")


def explode_batches(batches: DataFrame) -> DataFrame:
    """Batches (seq, records array<struct<kind, key, value>>) as mutations: record i has sequence seq + i, kind 1 deletes."""
    rows = batches.select("seq", F.posexplode("records").alias("pos", "r"))
    gone = F.col("r.kind") == 1
    return rows.select(F.col("r.key").alias("key"), (F.col("seq") + F.col("pos")).alias("seq"), gone.alias("tombstone"), F.when(~gone, F.col("r.value")).alias("value"))
