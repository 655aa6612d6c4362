"""Structural checks. Each is a query for violations: (invariant, detail), empty on a healthy tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _found(df: DataFrame, invariant: str, *detail: str) -> DataFrame:
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in detail))
    return df.select(F.lit(invariant).alias("invariant"), text.alias("detail"))


def version_structure(files: DataFrame) -> DataFrame:
    """A file in two places, ranges below level 0 that meet, or, where files have their place in level 0's list (position), numbers there that do not fall."""
    twice = files.groupBy("file_number").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("level").orderBy("smallest", "file_number")
    before = files.where("level > 0").withColumn("_before", F.lag("largest").over(order))
    found = _found(twice, "version-structure", "file_number").union(_found(before.where("_before >= smallest"), "version-structure", "level", "file_number"))
    if "position" in files.columns:
        above = F.lag("file_number").over(Window.partitionBy("level").orderBy("position"))
        found = found.union(_found(files.where("level = 0").withColumn("_above", above).where("_above <= file_number"), "version-structure", "level", "file_number"))
    return found


def file_exists(files: DataFrame, disk: DataFrame) -> DataFrame:
    return _found(files.join(disk.select("file_number"), "file_number", "left_anti"), "manifest-file-exists", "file_number")


def file_size(files: DataFrame, disk: DataFrame) -> DataFrame:
    other = disk.select("file_number", F.col("size").alias("_size"))
    return _found(files.join(other, "file_number").where("size <> _size"), "manifest-file-size", "file_number")


def no_orphans(files: DataFrame, disk: DataFrame) -> DataFrame:
    return _found(disk.join(files.select("file_number"), "file_number", "left_anti"), "no-orphan-tables", "file_number")


def one_version_per_level(entries: DataFrame) -> DataFrame:
    """Below level 0 a key is in one file of a level at most."""
    rows = entries.where("level > 0").select("level", "key", "file_number").distinct().groupBy("level", "key").agg(F.count("*").alias("n"))
    return _found(rows.where("n > 1"), "one-version-per-key-per-level", "level", "key")


def no_empty_tables(files: DataFrame, entries: DataFrame) -> DataFrame:
    return _found(files.join(entries.select("file_number").distinct(), "file_number", "left_anti"), "no-empty-tables", "file_number")


def comparator_order(entries: DataFrame, position: str = "position") -> DataFrame:
    """Entries of a file rise strictly by key, then fall by seq, along their positions. One file's entries are a bounded group."""
    order = Window.partitionBy("file_number").orderBy(position)
    rows = entries.withColumn("_key", F.lag("key").over(order)).withColumn("_seq", F.lag("seq").over(order))
    bad = rows.where("_key is not null and not (_key < key or (_key = key and _seq > seq))")
    return _found(bad, "comparator-order", "file_number", position)


def sequence_issued(entries: DataFrame, last_sequence: int) -> DataFrame:
    bad = entries.where(F.lit(last_sequence > 0) & (F.col("seq") > last_sequence))
    return _found(bad, "sequence-within-issued-range", "file_number", "seq")


def _outside(entries: DataFrame, files: DataFrame, bad: Column, invariant: str, detail: str) -> DataFrame:
    bounds = files.select("file_number", "smallest", "largest", "smallest_seq", "largest_seq")
    return _found(entries.select("file_number", "key", "seq").join(bounds, "file_number").where(bad), invariant, "file_number", detail)


def key_bounds(entries: DataFrame, files: DataFrame) -> DataFrame:
    return _outside(entries, files, F.expr("key < smallest or key > largest"), "metadata-key-bounds", "key")


def sequence_bounds(entries: DataFrame, files: DataFrame) -> DataFrame:
    return _outside(entries, files, F.expr("seq < smallest_seq or seq > largest_seq"), "metadata-sequence-bounds", "seq")


def l0_recency(files: DataFrame) -> DataFrame:
    """On level 0 a higher number never has a lower largest sequence."""
    order = Window.partitionBy("level").orderBy("file_number", "largest_seq")
    rows = files.where("level = 0").withColumn("_before", F.lag("largest_seq").over(order))
    return _found(rows.where("_before > largest_seq"), "l0-number-tracks-recency", "file_number")


def metadata_valid(files: DataFrame) -> DataFrame:
    return _found(files.where("smallest > largest or smallest_seq > largest_seq"), "metadata-valid", "file_number")


def table_readable(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose Parquet data cannot be read whole: paths (file_number, path). One task reads one file."""
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs
        import pyarrow.parquet

        for b in batches:
            bad = []
            for number, path in zip(b["file_number"], b["path"], strict=True):
                try:
                    system, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
                    for _ in pyarrow.parquet.ParquetFile(at, filesystem=system).iter_batches():
                        pass
                except (OSError, pyarrow.ArrowException) as e:
                    bad.append((number, type(e).__name__))
            yield pd.DataFrame(bad, columns=["file_number", "error"])

    known = files.select("file_number").join(paths.select("file_number", "path"), "file_number")
    return _found(known.mapInPandas(read, "file_number long, error string"), "table-readable", "file_number")


def tombstones_have_no_value(entries: DataFrame) -> DataFrame:
    return _found(entries.where("tombstone <> (value is null)"), "tombstone-value", "file_number", "seq")


def report(files: DataFrame, entries: DataFrame, disk: DataFrame, last_sequence: int, at_rest: bool = True) -> DataFrame:
    """Every violation that files, entries and disk show together; orphans only count at rest."""
    parts = [
        version_structure(files), file_exists(files, disk), file_size(files, disk), one_version_per_level(entries), no_empty_tables(files, entries),
        sequence_issued(entries, last_sequence), key_bounds(entries, files), sequence_bounds(entries, files), l0_recency(files), metadata_valid(files),
    ]
    if "position" in entries.columns:
        parts.append(comparator_order(entries))
    if at_rest:
        parts.append(no_orphans(files, disk))
    return reduce(DataFrame.union, parts)


def acknowledged(acked: DataFrame, live: DataFrame) -> DataFrame:
    """Acknowledged writes (key, value) that the live state lacks or holds otherwise."""
    now = live.select("key", F.col("value").alias("_now"), F.lit(True).alias("_there"))
    return acked.join(now, "key", "left").where("_there is null or not (value <=> _now)").select("key", "value", F.col("_now").alias("found"))
