"""Planning and running compaction.

Planning works on files (few); running works on entries, and is the merge of merge.py with
the tombstone rule: a tombstone may go only if no file below could hold an older version.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import layout
from tidelog.operators.model import LEVELS, entry_size
from tidelog.operators.state import newest


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values."""

    base_bytes: int = 8 << 20
    multiplier: int = 10
    l0_trigger: int = 4
    output_bytes: int = 2 << 20
    most_input: int = 64 << 20
    soft_files: int = 8
    hard_files: int = 12
    soft_delay_ms: float = 0.5


def level_target(level: Column, options: Options = Options()) -> Column:
    return F.when(level == 0, F.lit(0)).otherwise(F.lit(options.base_bytes) * F.pow(F.lit(options.multiplier), level - 1)).cast("long")


def scores(files: DataFrame, options: Options = Options()) -> DataFrame:
    """level, files, bytes, target_bytes, score of each level that has files."""
    level = F.col("level")
    score = F.when(level == 0, F.col("files") / F.lit(options.l0_trigger)).otherwise(F.col("bytes") / level_target(level, options)).cast("double")
    return layout.level_stats(files).select("level", "files", "bytes", level_target(level, options).alias("target_bytes"), score.alias("score"))


def worst_level(files: DataFrame, options: Options = Options()) -> DataFrame:
    """The level most over budget, the upper one on ties; the last level is never compacted."""
    return scores(files, options).where((F.col("score") >= 1) & (F.col("level") < LEVELS - 1)).orderBy(F.desc("score"), "level").limit(1)


def seed(files: DataFrame, level: int, pointer: str | bytes | None = None) -> DataFrame:
    """The file where the level's last compaction left off: the first whose largest key is beyond pointer, else the first."""
    at = files.where(F.col("level") == level)
    passed = [] if pointer is None else [F.when(F.col("largest") > F.lit(pointer), 0).otherwise(1)]
    return at.orderBy(*passed, "smallest", "file_number").limit(1)


def islands(files: DataFrame) -> DataFrame:
    """files with island, numbering groups of ranges that overlap, touching ones included, through any chain."""
    order = Window.partitionBy("level").orderBy("smallest", "largest", "file_number")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = files.withColumn("_cut", F.when(reach.isNull() | (F.col("smallest") > reach), 1).otherwise(0))
    return cut.withColumn("island", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def l0_closure(files: DataFrame, seed_number: int) -> DataFrame:
    """All files of level 0 that a chain of overlaps links to the seed."""
    zero = islands(files.where("level = 0"))
    return zero.join(zero.where(F.col("file_number") == seed_number).select("island"), "island", "left_semi").drop("island")


def hull(files: DataFrame) -> DataFrame:
    """smallest, largest and total bytes of files."""
    return files.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def parents(files: DataFrame, base: DataFrame, level: int) -> DataFrame:
    """The files one level down that the base's range overlaps."""
    bounds = hull(base).select(F.col("smallest").alias("_low"), F.col("largest").alias("_high"))
    return files.where(F.col("level") == level + 1).join(F.broadcast(bounds), F.expr("largest >= _low and smallest <= _high")).drop("_low", "_high")


def grow_base(files: DataFrame, base: DataFrame, parent: DataFrame, level: int, options: Options = Options()) -> DataFrame:
    """base and the files after it that bring in no new parent, while all inputs stay within the cap.

    A fold over the sorted later files of one level, as it stops at the first that fails.
    """
    edge = hull(base).select(F.col("largest").alias("_edge"), F.col("bytes").alias("_base"))
    below = hull(parent).select(F.col("largest").alias("_parent_edge"), F.col("bytes").alias("_parent"))
    later = files.where(F.col("level") == level).join(F.broadcast(edge), F.expr("smallest > _edge"))
    under = files.where(F.col("level") == level + 1).select(F.col("smallest").alias("_s"), F.col("largest").alias("_l"))
    touches = later.join(under, F.expr("_l >= smallest and _s <= largest"), "left_semi").select("file_number", F.lit(True).alias("_touches"))
    later = later.join(touches, "file_number", "left").join(F.broadcast(below), F.lit(True))
    fails = F.when(F.col("_parent_edge").isNotNull(), F.col("largest") > F.col("_parent_edge")).otherwise(F.coalesce("_touches", F.lit(False)))
    order = Window.orderBy("smallest").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("_base") + F.col("_parent") + F.sum("size").over(order) <= options.most_input
    stopped = F.max(F.when(fails | ~room, 1).otherwise(0)).over(order)
    return base.unionByName(later.withColumn("_stop", stopped).where("_stop = 0").select(*base.columns))


def bottom_most(files: DataFrame, inputs: DataFrame, output: int) -> bool:
    """Whether no file below the output level meets the inputs' whole range: coarse, in the safe direction."""
    bounds = hull(inputs).select(F.col("smallest").alias("_low"), F.col("largest").alias("_high"))
    return files.where(F.col("level") > output).join(F.broadcast(bounds), F.expr("largest >= _low and smallest <= _high")).isEmpty()


@dataclass
class Plan:
    level: int
    score: float
    base: DataFrame
    parent: DataFrame
    bottom: bool
    pointer: str | bytes

    @property
    def inputs(self) -> DataFrame:
        return self.base.unionByName(self.parent)


def pick(files: DataFrame, options: Options = Options(), pointers: dict | None = None) -> Plan | None:
    """The next compaction, or None where no level is over budget. Advances the level's pointer in pointers."""
    worst = worst_level(files, options).first()
    if worst is None:
        return None
    level, pointers = worst.level, {} if pointers is None else pointers
    start = seed(files, level, pointers.get(level))
    base = l0_closure(files, start.first().file_number) if level == 0 else start
    parent = parents(files, base, level)
    if level > 0:
        base = grow_base(files, base, parent, level, options)
    pointers[level] = hull(base).first().largest
    return Plan(level, worst.score, base, parent, bottom_most(files, base.unionByName(parent), level + 1), pointers[level])


def run(entries: DataFrame, bottom: bool) -> DataFrame:
    """The newest version of each key; tombstones go only where nothing can lie below."""
    kept = newest(entries)
    return kept.where(~F.col("tombstone")) if bottom else kept


def accounting(entries: DataFrame, bottom: bool) -> DataFrame:
    """keys, entries_written, tombstones_dropped: written and dropped add up to keys."""
    dropped = F.col("tombstone") & F.lit(bottom)
    return newest(entries).agg(F.count("*").alias("keys"), F.count_if(~dropped).alias("entries_written"), F.count_if(dropped).alias("tombstones_dropped"))


def roll(sorted_keys: DataFrame, threshold: int) -> DataFrame:
    """file (from 0) of each key when files close as soon as they reach threshold bytes, range by range.

    Column size is a key's bytes. The fold starts anew at each close, which no window expresses: a task streams the keys
    of its ranges (column range) in order and holds none of them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, file = None, 0, 0
        for b in batches:
            files = []
            for r, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if r != now:
                    now, held, file = r, 0, 0
                elif held >= threshold:
                    held, file = 0, file + 1
                held += size
                files.append(file)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(files, pa.int64())], ["range", "key", "file"])

    kind = sorted_keys.schema["key"].dataType.simpleString()
    range_kind = sorted_keys.schema["range"].dataType.simpleString()
    rows = sorted_keys.select("range", "key", F.col("size").cast("long")).repartition("range").sortWithinPartitions("range", "key")
    return rows.mapInArrow(fold, f"range {range_kind}, key {kind}, file long")


def rolled(entries: DataFrame, options: Options = Options(), first: int = 0, apart: tuple = ()) -> DataFrame:
    """entries (one version a key) with file_number, numbered from first + 1: files of output_bytes, closed on a change of key.

    The key space is cut into ranges of some files each, so that ranges are rolled side by side; a range's last file may be smaller.
    A file has keys of one side only of each key in apart.
    """
    from tidelog.operators.ranks import cuts, range_of

    sized = entries.drop("file_number").withColumn("_size", entry_size(F.col("key"), F.col("value")))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    ranges = max(1, total // (FILES_A_RANGE * options.output_bytes))
    cut = sized.withColumn("_range", range_of("key", sorted({*cuts(sized, "key", ranges), *apart})))
    files = roll(cut.select(F.col("_range").alias("range"), "key", F.col("_size").alias("size")), options.output_bytes)
    last = files.groupBy("range").agg((F.max("file") + 1).alias("n"))
    before = last.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    numbered = files.join(F.broadcast(before), "range").select("key", (F.lit(first + 1) + F.col("before") + F.col("file")).cast("long").alias("file_number"))
    return cut.drop("_range", "_size").join(numbered, "key")


#: Output files that one task rolls.
FILES_A_RANGE = 64


@dataclass
class Round:
    """Compactions of a level that run side by side: no two of them meet."""

    level: int
    inputs: list[tuple[int, int, bool]]  # level, file_number, whether its compaction is bottom-most
    apart: tuple  # keys that no output file may cross


def pick_round(files: DataFrame, options: Options = Options(), pointers: dict | None = None) -> Round | None:
    """All compactions that the level most over budget needs, or None where no level is. Advances the level's pointer in pointers.

    The base is all of level 0, or below it the files from the level's pointer on, around its end, until the rest is within budget. Its parents are
    the files one level down that it overlaps, and each chain of overlaps is a compaction. A fold over files, a row each on the driver.
    """
    worst = worst_level(files, options).first()
    if worst is None:
        return None
    level, pointers = worst.level, {} if pointers is None else pointers
    key = lambda k: bytes(k) if isinstance(k, bytearray) else k
    every = [(f.level, f.file_number, key(f.smallest), key(f.largest), f.size) for f in files.where(F.col("level") >= level).select("level", "file_number", "smallest", "largest", "size").collect()]
    base = sorted((f for f in every if f[0] == level), key=lambda f: f[2:4] + f[1:2])
    if level > 0:
        from_pointer = base if pointers.get(level) is None else sorted(base, key=lambda f: f[3] <= pointers[level])
        held, n = worst.bytes, 0
        while held >= worst.target_bytes and n < len(from_pointer):
            held, n = held - from_pointer[n][4], n + 1
        pointers[level] = from_pointer[n - 1][3]
        base = from_pointer[:n]
    below = [f for f in every if f[0] == level + 1]
    met = _meeting(below, _islands(base))
    inputs = [f for f, m in zip(below, met, strict=True) if m] + base
    hulls = _islands(inputs)
    deep = _meeting(hulls, _islands([f for f in every if f[0] > level + 1]))
    stay = _islands([f for f, m in zip(below, met, strict=True) if not m])
    starts = [h[2] for h in hulls]
    bottom = [not deep[bisect_right(starts, f[2]) - 1] for f in inputs]
    apart = tuple(b[2] for a, b in pairwise(hulls) if _meeting([(0, 0, a[3], b[2])], stay)[0])
    return Round(level, [(f[0], f[1], x) for f, x in zip(inputs, bottom, strict=True)], apart)


def _islands(files: list[tuple]) -> list[tuple]:
    """The ranges (0, 0, smallest, largest) that files cover, in order: chains of overlaps, touching ones included, as islands() has them."""
    out: list[list] = []
    for low, high in sorted(f[2:4] for f in files):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(0, 0, low, high) for low, high in out]


def _meeting(files: list[tuple], ranges: list[tuple]) -> list[bool]:
    """Whether each file meets one of the ranges, which are in order and apart."""
    ends = [r[3] for r in ranges]
    at = [bisect_left(ends, f[2]) for f in files]
    return [k < len(ranges) and ranges[k][2] <= f[3] for f, k in zip(files, at, strict=True)]


def settle(entries: DataFrame, options: Options = Options(), most: int = 1024) -> DataFrame:
    """Compacts until no level is over budget; entries carry level and file_number. A tree that most rounds don't settle is an error.

    A round runs all compactions of a level, so there are about as many rounds as levels, whatever the input.
    """
    from tidelog.sources.scratch import written

    pointers: dict = {}
    for _ in range(most):
        files = written(layout.file_metadata(entries), "files")
        plan = pick_round(files, options, pointers)
        if plan is None:
            return entries
        kinds = {c: entries.schema[c].dataType.simpleString() for c in ("level", "file_number")}
        inputs = F.broadcast(entries.sparkSession.createDataFrame(plan.inputs, f"level {kinds['level']}, file_number {kinds['file_number']}, _bottom boolean"))  # a row for each file
        chosen = entries.join(inputs, ["level", "file_number"])
        rest = entries.join(inputs, ["level", "file_number"], "left_anti")
        kept = written(run(chosen, False).where(~(F.col("tombstone") & F.col("_bottom"))).drop("_bottom"), "merged")
        last = files.agg(F.max("file_number")).first()[0]
        out = rolled(kept, options, last, plan.apart).withColumn("level", F.lit(plan.level + 1))
        entries = written(rest.unionByName(out.select(*rest.columns)), "entries")
    raise RuntimeError(f"the tree is not settled after {most} compactions")


def commit(plan_inputs: DataFrame, outputs: DataFrame, edit_id: int, path: str | None = None) -> DataFrame:
    """The one edit that replaces a compaction's inputs by its outputs and moves the file counter beyond them; appended to the log at path in one job.

    outputs are the files' metadata, so they are written before the edit names them: a crash between leaves orphans, never missing files.
    """
    rows = edit_rows(plan_inputs, outputs, edit_id)
    top = plan_inputs.select("file_number").unionByName(outputs.select("file_number")).agg((F.max("file_number") + 1).alias("counter_value"), F.count("*").alias("n"))
    counter = top.select(*(F.lit("SET_NEXT_FILE_NUMBER").alias(c) if c == "kind" else F.lit(edit_id).cast("long").alias(c) if c == "edit_id" else F.col("n").cast("int").alias(c) if c == "ordinal" else F.col(c) if c == "counter_value" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    every = rows.unionByName(counter)
    if path:
        every.coalesce(1).write.mode("append").parquet(path)
    return every


def edit_rows(plan_inputs: DataFrame, outputs: DataFrame, edit_id: int) -> DataFrame:
    """One edit: a DELETE for each input, then an ADD for each output."""
    columns = ["level", "file_number", "size", "smallest", "largest", "smallest_seq", "largest_seq"]
    gone = plan_inputs.select(F.lit("DELETE").alias("kind"), *columns)
    new = outputs.select(F.lit("ADD").alias("kind"), *columns)
    order = Window.orderBy(F.desc("kind"), "level", "file_number")
    return gone.unionByName(new).select(F.lit(edit_id).cast("long").alias("edit_id"), (F.row_number().over(order) - 1).alias("ordinal"), "kind", *columns, F.lit(None).cast("long").alias("counter_value"))


def backpressure(flushes: DataFrame, options: Options = Options()) -> DataFrame:
    """flushes (l0_files) with delay_ms and stalled: writers slow down from soft_files on and stop at hard_files."""
    n = F.col("l0_files")
    delay = F.when((n >= options.soft_files) & (n < options.hard_files), options.soft_delay_ms * (n - (options.soft_files - 1))).otherwise(0.0)
    return flushes.withColumn("delay_ms", delay.cast("double")).withColumn("stalled", n >= options.hard_files)
