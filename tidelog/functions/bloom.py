"""Bloom filters as DataFrames of bitmaps.

A filter is one row for each 32768 bits of it, built by a bitmap aggregate that combines before its exchange, and probed by
a join on (file, bucket). Hash values differ from other implementations; what holds is
that no key that is in is ever reported absent, and the rate of false positives. A file without a filter may contain any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PROBE_FACTOR = 0.69
MOST_PROBES = 30
LEAST_BYTES = 8


def optimal_probes(bits_per_key: Column) -> Column:
    return F.least(F.lit(MOST_PROBES), F.greatest(F.lit(1), F.floor(bits_per_key * PROBE_FACTOR + 0.5))).cast("int")


def false_positive_rate(bits_per_key: Column, probes: Column) -> Column:
    return F.pow(1 - F.exp(-probes / bits_per_key), probes)


def filter_bytes(keys: Column, bits_per_key: int) -> Column:
    return F.greatest(F.lit(LEAST_BYTES), F.ceil(keys * bits_per_key / 8)).cast("long")


def positions(key: Column, probes: int, bits: Column) -> Column:
    """The bits that a key's probes address, by double hashing in 32-bit arithmetic."""
    h = F.xxhash64(key)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    step = lambda i: F.pmod((low + i.cast("long") * high).bitwiseAND(0xFFFFFFFF), bits)
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), step)


#: Bits of one row's bitmap: that of bitmap_construct_agg.
BITMAP = 32_768


def build(entries: DataFrame, bits_per_key: int = 10, probes: int = 7) -> DataFrame:
    """(file_number, bits, bucket, bitmap) of each file's filter over its distinct keys."""
    keys = entries.select("file_number", "key").distinct()
    sizes = keys.groupBy("file_number").agg((8 * filter_bytes(F.count("*"), bits_per_key)).alias("bits"))
    bit = keys.join(sizes, "file_number").select("file_number", "bits", F.explode(positions(F.col("key"), probes, F.col("bits"))).alias("bit"))
    return bit.groupBy("file_number", "bits", F.floor(F.col("bit") / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def probe(filters: DataFrame, candidates: DataFrame, probes: int = 7) -> DataFrame:
    """The rows (key, file_number) of candidates whose file's filter may contain the key, those of files without a filter included."""
    sizes = filters.select("file_number", "bits").distinct()
    asked = candidates.select("key", "file_number").join(sizes, "file_number", "left")
    bits = asked.where("bits is not null").withColumn("at", F.explode(F.array_distinct(positions(F.col("key"), probes, F.col("bits")))))
    by_bucket = bits.groupBy("key", "file_number", F.floor(F.col("at") / BITMAP).alias("bucket")).agg(F.collect_list(F.col("at") % BITMAP).alias("at"))  # probes at most
    checked = by_bucket.join(filters.select("file_number", "bucket", "bitmap"), ["file_number", "bucket"], "left")
    hit = F.coalesce(F.forall("at", lambda x: _is_set(F.col("bitmap"), x)), F.lit(False))
    found = checked.groupBy("key", "file_number").agg(F.bool_and(hit).alias("hit")).where("hit").select("key", "file_number")
    return found.unionByName(asked.where("bits is null").select("key", "file_number"))


def lookups(entries: DataFrame, candidates: DataFrame, filtered: bool = True, bits_per_key: int = 10, probes: int = 7) -> DataFrame:
    """probes, rejects, opened and found of each file when candidates (key, file_number) are looked up, with or without filters."""
    asked = candidates.select("key", "file_number")
    opened = probe(build(entries, bits_per_key, probes), asked, probes) if filtered else asked
    has = entries.select("key", "file_number").distinct().withColumn("_found", F.lit(True))
    hits = opened.withColumn("_opened", F.lit(True)).join(has, ["key", "file_number"], "left")
    rows = asked.join(hits, ["key", "file_number"], "left")
    return rows.groupBy("file_number").agg(F.count("*").alias("probes"), F.count_if(F.col("_opened").isNull()).alias("rejects"), F.count("_opened").alias("opened"), F.count("_found").alias("found"))
