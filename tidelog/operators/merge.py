"""Merging any number of sources of versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.state import newest


def merge(sources: list[DataFrame], keep_tombstones: bool) -> DataFrame:
    """The newest version of each key over all sources; tombstones hide older versions and then stay or go."""
    every = newest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources))
    return every if keep_tombstones else every.where(~F.col("tombstone"))


def ordered(versions: DataFrame) -> DataFrame:
    """Versions in comparator order: key ascending, seq descending."""
    return versions.orderBy(F.col("key").asc(), F.col("seq").desc())


def layered_get(layers: list[DataFrame], key: str | bytes) -> DataFrame:
    """A key looked up through layers, newest first: the version of the highest layer that has it, if alive.

    Layers hold ever older sequences, so the first match is the highest sequence.
    """
    return merge([x.where(F.col("key") == F.lit(key)) for x in layers], keep_tombstones=False)
