"""Command line over Parquet file sets: levels, validate, dump, manifest.

python -m tidelog.cli levels ENTRIES        files and bytes of each level, last sequence
python -m tidelog.cli validate ENTRIES EDITS
python -m tidelog.cli dump ENTRIES          versions in comparator order
python -m tidelog.cli manifest EDITS        edits in order
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import check, layout
from tidelog.operators.merge import ordered
from tidelog.sources import edits as edit_log


def levels(entries: DataFrame) -> DataFrame:
    """level, files, bytes, last_sequence of each level that has files."""
    last = entries.groupBy("level").agg(F.max("seq").alias("last_sequence"))
    return layout.level_stats(layout.file_metadata(entries)).join(last, "level").orderBy("level")


def validate(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Violations that the entries and the files that the edits name show together."""
    files = layout.replay(edits)
    disk = layout.file_metadata(entries).select("file_number", "size")
    sequence = layout.counters(edits).where("kind = 'SET_LAST_SEQUENCE'").first()
    return check.report(files, entries, disk, sequence.value if sequence else 0)


def dump(entries: DataFrame) -> DataFrame:
    return ordered(entries)


def manifest(edits: DataFrame) -> DataFrame:
    return edits.orderBy("edit_id", "ordinal")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["levels", "validate", "dump", "manifest"])
    parser.add_argument("paths", nargs="+")
    found = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if len(found.paths) != (2 if found.command == "validate" else 1):
        parser.error("wrong number of paths")
    if found.command == "validate":
        bad = validate(spark.read.parquet(found.paths[0]), edit_log.read(spark, found.paths[1], binary=False))
        rows = bad.collect()
        for r in rows:
            print(f"{r.invariant}: {r.detail}")
        return int(bool(rows))
    if found.command == "manifest":
        rows = manifest(edit_log.read(spark, found.paths[0], binary=False))
    else:
        rows = {"levels": levels, "dump": dump}[found.command](spark.read.parquet(found.paths[0]))
    names, n = rows.columns, 0
    for r in rows.toLocalIterator():  # a partition at a time, in order
        print("\t".join(f"{c}={r[c]!r}" for c in names))
        n += 1
    if not n and found.command != "manifest":
        print("the tree is empty")
    return 0


if __name__ == "__main__":
    sys.exit(main())
