"""What the operators share: shared-folder tables, packed arrays, shards, words.

Large per-token data moves between tasks as packed numpy arrays: a map task
sorts what it has by shard and emits one row (shard, blob) for each shard, so
that Spark shuffles a few thousand compact rows instead of billions of tiny ones.
"""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes (as stored) of a shard, and shards that a small input has.
SHARD_BYTES, FEW_SHARDS = 4 << 20, 64
PARTITION_BYTES = 128 << 20
#: Groups among which one exchange deals; more shards than these are reached in further exchanges.
FAN = 128
#: Bytes of packed columns that a task opens at once on the way.
OPEN = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_MADE: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def folders() -> Iterator[list[str]]:
    """The folders of all tables that are made meanwhile, in order."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
    finally:
        _MADE.reset(token)


def made(path: str) -> None:
    if (at := _MADE.get()) is not None:
        at.append(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table's folder; only after the last read of it has run."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Written:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        made(self.path)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only after the last read of them has run."""
        remove(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of plans that nothing refers to any more; the JVM hears only after a while what Python has let go, hence two rounds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def shards(df: DataFrame, size: int = SHARD_BYTES) -> int:
    """Shards for a packed exchange of df: one for each size bytes of it, and a few more where it is small.

    A plan whose size Spark can only guess (joins, local rows) gets at most as many as full partitions of it would.
    """
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(min(FEW_SHARDS, 4 * partitions), -(-min(bytes_, partitions * PARTITION_BYTES) // size) if bytes_ < 1 << 60 else 0)


def texts(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and the text as bytes, null as empty."""
    return df.select("doc_id", F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text"))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def by_shard(shard: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The non-empty slices of each shard in a sorted array of shard numbers."""
    ends = np.searchsorted(shard, np.arange(n + 1))
    for s in np.flatnonzero(np.diff(ends)):
        yield int(s), slice(int(ends[s]), int(ends[s + 1]))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, texts) in groups of about size bytes at most, one document at least."""
    ids, found, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if found and n + len(t) > size:
                yield ids, found
                ids, found, n = [], [], 0
            ids.append(i)
            found.append(t)
            n += len(t)
    if found:
        yield ids, found
