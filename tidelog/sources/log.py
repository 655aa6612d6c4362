"""The mutation log and file sets as Parquet: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.model import MUTATIONS


def append(mutations: DataFrame, path: str) -> None:
    """Adds mutations to a log. The job commits as a whole or not at all."""
    mutations.select("key", "seq", "tombstone", "value").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    """A log, as written; damaged files are errors, never skipped."""
    schema = MUTATIONS if binary else MUTATIONS.replace("binary", "string")
    return spark.read.schema(schema.replace(" not null", "")).option("ignoreCorruptFiles", "false").parquet(path)


def stream(spark: SparkSession, path: str, binary: bool = True, files: int = 1) -> DataFrame:
    """The log as a stream, so many files a micro-batch."""
    schema = MUTATIONS if binary else MUTATIONS.replace("binary", "string")
    return spark.readStream.schema(schema.replace(" not null", "")).option("maxFilesPerTrigger", files).parquet(path)


def highest_sequence(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def write_sorted(entries: DataFrame, path: str, files: int, bloom: bool = True) -> None:
    """A file set in comparator order: ranges of keys, sorted within, with statistics and key filters for point reads."""
    out = entries.repartitionByRange(files, "key").sortWithinPartitions("key", F.desc("seq")).write.mode("errorifexists")
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """A file set with the name of each entry's file."""
    return spark.read.parquet(path).withColumn("file_name", F.col("_metadata.file_name"))
