"""Files, levels and the versions that an edit log describes.

Files are few beside entries (a row for some megabytes), so what only concerns files
may order or pair them freely; what touches entries never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import file_number
from tidelog.operators.model import entry_size


def assign_levels(entries: DataFrame, files: int) -> DataFrame:
    """entries in files disjoint ranges of keys at level 1, numbered from 1."""
    from tidelog.operators.ranks import ranked

    keys = entries.select("key").distinct()
    total = keys.agg(F.count("*").alias("total"))
    placed = ranked(keys, "key", "place").join(F.broadcast(total), F.lit(True))  # one row
    placed = placed.select("key", (F.floor((F.col("place") - 1) * files / F.col("total")) + 1).cast("long").alias("file_number"))
    return entries.drop("file_number", "level").join(placed, "key").withColumn("level", F.lit(1))


def file_metadata(entries: DataFrame) -> DataFrame:
    """One row for each file: key and sequence bounds, entries, distinct keys and modelled size."""
    by_key = entries.groupBy("level", "file_number", "key").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes")
    )
    return by_key.groupBy("level", "file_number").agg(
        F.sum("bytes").alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("low").alias("smallest_seq"), F.max("high").alias("largest_seq"),
        F.sum("n").alias("entry_count"), F.count("*").alias("distinct_keys"),
    )


def level_stats(files: DataFrame) -> DataFrame:
    """Files and bytes of each level that has any."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def disk_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def containing(files: DataFrame, key: str | bytes) -> DataFrame:
    return files.where(F.lit(key).between(F.col("smallest"), F.col("largest")))


def overlapping(files: DataFrame, low: str | bytes, high: str | bytes) -> DataFrame:
    return files.where((F.col("largest") >= F.lit(low)) & (F.col("smallest") <= F.lit(high)))


def overlap_pairs(files: DataFrame, bins: int = 256) -> DataFrame:
    """(level, a, b) for files a < b of a level whose key ranges meet. Files meet in the bin where the later one of the two begins."""
    from tidelog.operators.ranks import cuts, range_of

    at = cuts(files, "smallest", bins)
    a = files.select("level", F.col("file_number").alias("x"), F.col("smallest").alias("x_low"), F.col("largest").alias("x_high"), F.explode(F.sequence(range_of("smallest", at), range_of("largest", at))).alias("bin"))
    b = files.select("level", F.col("file_number").alias("y"), F.col("smallest").alias("y_low"), range_of("smallest", at).alias("bin"))
    later = "(x_low < y_low or (x_low = y_low and x < y)) and x_high >= y_low and x <> y"
    return a.join(b, ["level", "bin"]).where(later).select("level", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


#: Keys of a bin at least, pairs that a task compares about, and tasks at most.
KEYS_A_BIN, PAIRS_A_TASK, MOST_TASKS = 64, 1_000_000, 4096


def candidates(keys: DataFrame, files: DataFrame, bins: int = 1024) -> DataFrame:
    """(key, level, file_number) for every file whose range has the key.

    The key space is cut at sampled keys into at most bins ranges. A key is in one bin, a file in each that it meets, and they join by bin: keys are
    paired with the files near them, not with all. Files of level 0 may hold any key, so that there are nearly keys x files pairs from two small
    tables: a bin's files are dealt into shares that meet the bin's keys apart, and as many tasks join as the pairs need, whatever the bytes that they read.
    """
    from tidelog.operators.ranks import cuts, range_of

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.select("key").where("key is not null").repartition(parts, "key")  # both tables grow in the next steps, which few tasks would do otherwise
    files = files.select("level", "file_number", "smallest", "largest").repartition(parts, "level", "file_number")
    at = cuts(keys, "key", max(1, min(bins, keys.count() // KEYS_A_BIN)))
    placed = keys.withColumn("bin", range_of("key", at))
    spread = files.select("level", "file_number", "smallest", "largest", F.explode(F.sequence(range_of("smallest", at), range_of("largest", at))).alias("bin"))
    sizes = placed.groupBy("bin").agg(F.count("*").alias("k")).join(spread.groupBy("bin").agg(F.count("*").alias("f")), "bin").collect()  # a row for each bin
    shares, pairs = [1] * (len(at) + 1), sum(x.k * x.f for x in sizes)
    for x in sizes:
        shares[x.bin] = min(x.f, -(-x.k * x.f // PAIRS_A_TASK))
    n = F.element_at(F.array(*map(F.lit, shares)), F.col("bin") + 1)
    tasks = min(MOST_TASKS, max(parts, -(-pairs // PAIRS_A_TASK)))
    left = placed.withColumn("share", F.explode(F.sequence(F.lit(0), n - 1))).repartition(tasks, "bin", "share")
    right = spread.withColumn("share", F.pmod(F.xxhash64("level", "file_number"), n).cast("int")).repartition(tasks, "bin", "share")
    return left.join(right, ["bin", "share"]).where("key >= smallest and key <= largest").select("key", "level", "file_number")


def candidate_counts(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(level, file_number, n): of each file, how many rows candidates() has, 0 included.

    They are the keys not above its largest less those below its smallest: counts from one ordered pass over keys and distinct bounds, no pairs.
    """
    from tidelog.operators.ranks import counted_below

    edge = lambda c, inclusive: F.struct(F.col(c).alias("bound"), F.lit(inclusive).alias("inclusive"))
    edges = files.select("level", "file_number", F.explode(F.array(edge("largest", True), edge("smallest", False))).alias("x")).select("level", "file_number", "x.*")
    below = counted_below(keys.where("key is not null"), "key", edges.select("bound", "inclusive").distinct())
    counted = edges.join(below, ["bound", "inclusive"]).groupBy("level", "file_number")
    return counted.agg(F.sum(F.when(F.col("inclusive"), F.col("n")).otherwise(-F.col("n"))).alias("n"))


def replay(edits: DataFrame) -> DataFrame:
    """The live files after all edits: of each file the last action, deletes of an edit before its adds."""
    moves = edits.where(F.col("kind").isin("ADD", "DELETE"))
    order = Window.partitionBy("level", "file_number").orderBy(F.desc("edit_id"), F.desc(F.when(F.col("kind") == "ADD", 1).otherwise(0)), F.desc("ordinal"))
    last = moves.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return last.where("kind = 'ADD'").select("level", "file_number", "size", "smallest", "largest", "smallest_seq", "largest_seq")


def bad_deletes(edits: DataFrame) -> DataFrame:
    """Edits that delete a file which is not live at that point: corruption."""
    moves = edits.where(F.col("kind").isin("ADD", "DELETE")).withColumn("_add", F.when(F.col("kind") == "ADD", 1).otherwise(0))
    order = Window.partitionBy("level", "file_number").orderBy("edit_id", "_add", "ordinal")
    return moves.withColumn("_before", F.lag("kind").over(order)).where("kind = 'DELETE' and coalesce(_before, 'DELETE') = 'DELETE'").select("edit_id", "level", "file_number")


KINDS = ("ADD", "DELETE", "SET_LAST_SEQUENCE", "SET_NEXT_FILE_NUMBER", "SET_LOG_NUMBER")


def unknown_kinds(edits: DataFrame) -> DataFrame:
    """Rows of the edit log of no known kind: corruption."""
    return edits.where(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).select("edit_id", "ordinal", "kind")


def replay_strict(edits: DataFrame) -> DataFrame:
    """replay(), refused with an error where the log has unknown kinds or deletes files that are not live."""
    for what, bad in (("kinds", unknown_kinds(edits)), ("deletes", bad_deletes(edits))):
        if row := bad.first():
            raise ValueError(f"corrupt edit log: bad {what}, first {row.asDict()}")
    return replay(edits)


def counters(edits: DataFrame) -> DataFrame:
    """(kind, value): the last value set of each counter."""
    sets = edits.where(F.col("kind").startswith("SET_"))
    return sets.groupBy("kind").agg(F.max_by("counter_value", F.struct("edit_id", "ordinal")).alias("value"))


def next_file_number(names: DataFrame) -> DataFrame:
    """n: one more than the highest number among file names (column name) of any kind."""
    n = F.col("name")
    number = F.coalesce(file_number(n, ".sst"), file_number(n, ".wal"), F.regexp_extract(n, "^MANIFEST-([0-9]{6,})$", 1).try_cast("long"))
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n"))


def orphans(disk: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk (column file_number) that the version does not name. Reported, never deleted."""
    return disk.join(live.select("file_number"), "file_number", "left_anti")


def obsolete(versions: DataFrame, held: DataFrame) -> DataFrame:
    """Files of past versions (version, file_number) that no held version (column version) has."""
    still = versions.join(held, "version", "left_semi").select("file_number")
    return versions.select("file_number").distinct().join(still, "file_number", "left_anti")


def file_refs(versions: DataFrame, held: DataFrame) -> DataFrame:
    """(file_number, refs): how many held versions have each file."""
    return versions.join(held, "version", "left_semi").groupBy("file_number").agg(F.count("*").alias("refs"))


def seed_edits(files: DataFrame, edit_id: int) -> DataFrame:
    """A checkpoint: one edit that adds all live files."""
    order = Window.orderBy("level", "file_number")
    return files.select(F.lit(edit_id).cast("long").alias("edit_id"), (F.row_number().over(order) - 1).alias("ordinal"), F.lit("ADD").alias("kind"), "level", "file_number", "size", "smallest", "largest", "smallest_seq", "largest_seq", F.lit(None).cast("long").alias("counter_value"))
