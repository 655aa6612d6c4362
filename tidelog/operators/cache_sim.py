"""Replay of an access trace through a sharded least-recently-used cache.

Each shard is a sequential machine over its own accesses: one group a shard, rows in access order.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 16


def lru_replay(trace: DataFrame, capacity: int, shards: int = SHARDS) -> DataFrame:
    """trace (access_id, file, offset, size) with shard and hit.

    size is a block's bytes; a row with a null offset evicts all blocks of its file instead and is no access. A block larger
    than its shard's part of capacity is never kept.
    """
    room = capacity // shards

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("access_id")
        held: OrderedDict[tuple, int] = OrderedDict()
        used, hits = 0, []
        for file, offset, size in zip(rows["file"], rows["offset"], rows["size"], strict=True):
            if pd.isna(offset):
                for block in [b for b in held if b[0] == file]:
                    used -= held.pop(block)
                hits.append(None)
                continue
            block = (file, offset)
            if block in held:
                held.move_to_end(block)
                hits.append(True)
                continue
            hits.append(False)
            if size <= room:
                held[block] = size
                used += size
                while used > room:
                    used -= held.popitem(last=False)[1]
        return rows.assign(hit=pd.array(hits, dtype="boolean"))

    placed = trace.withColumn("shard", F.pmod(F.xxhash64("file", "offset"), F.lit(shards)).cast("int"))
    evict = trace.where("offset is null").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = placed.where("offset is not null").unionByName(evict).select("access_id", "file", "offset", "size", "shard")
    return every.groupBy("shard").applyInPandas(replay, "access_id long, file long, offset long, size long, shard int, hit boolean").where("hit is not null")
