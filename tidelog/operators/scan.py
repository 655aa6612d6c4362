"""Ordered scans by pages of keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import CommandError, matches
from tidelog.operators.ranks import ranked
from tidelog.operators.state import live

DEFAULT_COUNT = 10


@dataclass
class Page:
    keys: list
    cursor: str | bytes | None  # the last key, None when the scan is over


def page(log: DataFrame, cursor: str | bytes | None = None, count: int = DEFAULT_COUNT) -> DataFrame:
    """The next count live keys after cursor, in order. The bound on the key reaches the scan; the limit is a top-k."""
    after = log if cursor is None else log.where(F.col("key") > F.lit(cursor))
    return live(after).select("key").orderBy("key").limit(count if count > 0 else DEFAULT_COUNT)


def match_page(log: DataFrame, pattern: str, cursor: str | bytes | None = None, count: int = DEFAULT_COUNT) -> DataFrame:
    """A page, then the pattern: MATCH filters what the page holds, so a page may be empty while the scan goes on."""
    if count < 1:
        raise CommandError("ERR value is not an integer or out of range")
    return page(log, cursor, count).where(matches(F.col("key"), pattern))


def read_page(log: DataFrame, cursor: str | bytes | None = None, count: int = DEFAULT_COUNT, pattern: str | None = None) -> Page:
    """One page on the driver. The cursor is None exactly when no key is left."""
    count = count if count > 0 else DEFAULT_COUNT
    keys = [r.key for r in page(log, cursor, count + 1).collect()]
    more, keys = len(keys) > count, keys[:count]
    at = keys[-1] if more else None
    if pattern is not None and keys:
        shown = log.sparkSession.createDataFrame([(k,) for k in keys], log.select("key").schema).where(matches(F.col("key"), pattern))
        keys = sorted(r.key for r in shown.collect())
    return Page(keys, at)


def walk(log: DataFrame, count: int = DEFAULT_COUNT) -> DataFrame:
    """(page_no, key) of a full scan by pages of count keys: one ordered pass, not a chain of pages."""
    rows = ranked(live(log).select("key"), "key", "place")
    return rows.select(F.floor((F.col("place") - 1) / count).cast("long").alias("page_no"), "key")
