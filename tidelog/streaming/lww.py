"""Last-writer-wins state of a stream of mutations.

The newest sequence of a key wins whatever order versions arrive in, so the state is max_by on seq and
needs no watermark. State grows with the number of keys, as the store itself does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_stream(log: DataFrame) -> DataFrame:
    """The newest version of each key so far; for update or complete mode."""
    order = F.struct("seq", (~F.col("tombstone")).alias("alive"), "value")
    best = log.groupBy("key").agg(F.max_by(F.struct("seq", "tombstone", "value"), order).alias("v"))
    return best.select("key", "v.seq", "v.tombstone", "v.value")


def start_state(log: DataFrame, name: str, checkpoint: str | None) -> StreamingQuery:
    """Reads what is there and keeps the state in a memory table (for small states and tests)."""
    out = newest_stream(log).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def start_flush(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes one sorted file set for each micro-batch, batch number as partition: memtables flushed to level 0.

    A batch that is run again overwrites its own set, so restarts leave no version twice.
    """

    def flush(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.sortWithinPartitions("key", F.desc("seq")).write.mode("overwrite").parquet(f"{path}/file_number={number}")

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
