"""Last-writer-wins state and what clients ask of it.

newest() keeps the version with the highest seq of each key by one aggregate, max_by on seq, whose partial
step runs before the exchange: a key with a third of all versions sends one row
from each task. A window would send every version of such a key to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, deleted or not. Ties on seq go to the version that is not deleted, then the larger value."""
    rest = [c for c in log.columns if c != "key"]
    order = F.struct("seq", (~F.col("tombstone")).alias("alive"), "value")
    best = log.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("v"))
    return best.select("key", *(F.col(f"v.{c}").alias(c) for c in rest)).select(*log.columns)


def live(log: DataFrame) -> DataFrame:
    """The newest versions that are no tombstones. The filter comes after newest(), never before: see early_drop()."""
    return newest(log).where(~F.col("tombstone"))


def early_drop(log: DataFrame) -> DataFrame:
    """The wrong order, kept to show what it does: dropping tombstones first brings deleted keys back."""
    return newest(log.where(~F.col("tombstone")))


def get(log: DataFrame, key: str | bytes) -> DataFrame:
    """No row or one: the live version of a key. The key's filter reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The live version of each row of keys (column key); repeats stay, absent keys have null values."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(live(wanted), "key", "left")


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    """n: how many rows of keys are live, repeats counted."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.select("key").join(live(wanted).select("key"), "key").agg(F.count("*").alias("n"))


def delete_effects(log: DataFrame, parts: int = 64) -> DataFrame:
    """deletes and existed: tombstones in the log, and those that hit a live key.

    Whether the version before was alive is a matter of neighbours in seq order. A key's versions are cut at its sequences' quantiles into parts
    at most, in place of one window over all of them: a part looks back within itself, and its first version at
    the last one of the parts before, a row for each part.
    """
    from pyspark.sql import Window

    from tidelog.operators.ranks import cuts, range_of

    rows = log.select("key", "seq", "tombstone").withColumn("part", range_of("seq", cuts(log, "seq", parts)))
    last = rows.groupBy("key", "part").agg(F.max_by("tombstone", "seq").alias("last"))
    earlier = last.withColumn("earlier", F.lag("last").over(Window.partitionBy("key").orderBy("part"))).select("key", "part", "earlier")  # parts rows a key at most
    before = F.lag("tombstone").over(Window.partitionBy("key", "part").orderBy("seq"))
    found = rows.withColumn("before", before).where("tombstone").join(earlier, ["key", "part"])
    return found.agg(F.count("*").alias("deletes"), F.count_if(~F.coalesce("before", "earlier")).alias("existed"))


def put(log: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """The log with rows (key, value) appended after its highest sequence, in the order of the column order.

    Without one, rows follow by key, and rows of one key by value, so that the largest value is the newest whatever way the rows lie.
    """
    columns = ["key", "value", *([order] if order else [])]
    return _append(log, rows.select(*columns).withColumn("tombstone", F.lit(False)), order)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with a tombstone for every row of keys, absent ones included."""
    return _append(log, keys.select("key", F.lit(None).cast(log.schema["value"].dataType).alias("value"), F.lit(True).alias("tombstone")))


def _append(log: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    from tidelog.operators.ranks import ranked

    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = ranked(rows, order or "key", "place", then=("key", "value")).join(F.broadcast(last), F.lit(True))  # one row
    new = new.withColumn("seq", F.col("last") + F.col("place"))
    return log.select("key", "seq", "tombstone", "value").unionByName(new.select("key", "seq", "tombstone", "value"))


def dbsize(log: DataFrame) -> DataFrame:
    return live(log).agg(F.count("*").alias("n"))


def truncate(log: DataFrame) -> DataFrame:
    """No keys at all, with the log's columns."""
    return log.where(F.lit(False))


def reload(log: DataFrame, highest: int) -> DataFrame:
    """What recovery keeps: the newest version of each key, with new sequences after highest in key order."""
    from tidelog.operators.ranks import ranked

    return ranked(newest(log), "key", "place").withColumn("seq", F.lit(highest) + F.col("place")).drop("place")


def is_live(column: Column) -> Column:
    return F.coalesce(~column, F.lit(False))
