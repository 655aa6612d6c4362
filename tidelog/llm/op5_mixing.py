"""Mixing sources to target weights by multinomial draws over blocks.

The words of a source's documents, one after the other, form a stream that is packed into
blocks of BLOCK words. Each output shard draws how many of its slots each source fills from a
multinomial over what the targets still ask for, so the counts of all shards add up to
the targets. A source's slots, numbered through all shards, map to its blocks through a
pseudorandom permutation of block indexes, one permutation after the other, so no block
is used twice before all are used once. Blocks join documents by (source, index). The targets fix how much
of a source the mix takes in all; the draws fix which shard takes which block, and so each shard's composition and the order of the mix.

Streams are never gathered: a document's place follows from sums over hash buckets of its
source, the buckets' sums from a window over at most BUCKETS rows a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Written

#: Relative weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0  # of all words; of a source's words
BLOCK = 64
#: Least output shards among which the multinomial draws are made, and most slots of a shard.
SHARDS, SHARD_SLOTS = 256, 1 << 22
BUCKETS = 4096
SEED = 17
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict[str | None, float]:
    """Words asked of each source: shares of total by weight, none above most times its size, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, left = dict(order), total * sum(n for _, n in order)
    got, free = dict.fromkeys(size, 0.0), set(size)
    while free:
        by = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * by >= most * size[s]}
        for s in full or free:
            got[s] = most * size[s] if full else weight[s] * by
        if not full:
            break
        left -= sum(got[s] for s in full)
        free -= full
    return got


def draw(slots: dict[int, int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source (column) in each shard (row): multinomial draws by what is still to be filled, exact in total."""
    rng, left = np.random.default_rng(seed), np.array([slots[k] for k in sorted(slots)], np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        room = -(-int(left.sum()) // (shards - k))
        while room and left.sum():
            got = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[k] += got
            left -= got
            room -= int(got.sum())
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at x: a four-round Feistel network over the next even power of two, walked until below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> half, x[todo] & mask
            for r in range(4):
                f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(29)) & mask)
            x[todo] = left << half | right
            todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def wanted_blocks(size: int, target: float, block: int = BLOCK) -> int:
    """Blocks of a source of size words that come closest to target words; one at least where both are above zero.

    Whole passes count the words that the last, shorter block has; a rest that nearly makes a pass is one.
    """
    if size <= 0 or target <= 0:
        return 0
    n = -(-size // block)
    passes, rest = divmod(target, size)
    last = size - (n - 1) * block
    more = n if rest >= size - last / 2 else min(n - 1, round(rest / block))
    return max(1, int(passes) * n + more)


def placed(sized: DataFrame) -> DataFrame:
    """sized (doc_id, name, known, size, ...) with start, the words before the document in its source's stream."""
    within = Window.partitionBy("name", "known", "bucket").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("name", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)))
    sums = bucketed.groupBy("name", "known", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(across), F.lit(0))).drop("words")
    local = bucketed.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(before, ["name", "known", "bucket"]).withColumn("start", F.col("local") + F.col("before")).drop("local", "before", "bucket")


def _taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their place and target; the parts of them that are taken: first word, words, and the slots (shard, slot) that take it; and all slots.

    A source's slots are numbered through all shards; slot n is a block's (n div blocks)-th use.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNotNull().alias("known"), size.alias("size"), F.xxhash64(text).alias("row"))
    sized = Written(sized, "sizes")
    totals = [((r.name if r.known else None), r.n) for r in sized.read().groupBy("name", "known").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, weights, total, most)
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    blocks = [-(-n // block) for _, n in order]
    wanted = {k: min(int(most) * blocks[k], wanted_blocks(n, goal[s], block)) for k, (s, n) in enumerate(order)}
    shards = max(shards, -(-sum(wanted.values()) // SHARD_SLOTS))
    drawn = draw(wanted, shards, seed)
    ends = np.cumsum(drawn, axis=0)
    facts = [(s or "", s is not None, k, int(n), float(goal[s]), blocks[k]) for k, (s, n) in enumerate(order)]
    schema = "name string, known boolean, source long, source_size long, target double, blocks long"
    facts = F.broadcast(spark.createDataFrame(facts, schema))  # a row for each source

    spans = [(k, shard, int(ends[shard][k] - drawn[shard][k]), int(ends[shard][k]), blocks[k]) for k in range(len(order)) for shard in range(shards) if drawn[shard][k]]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, shard, start, end, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in range(start, end, 1 << 20):
                    slot = np.arange(a, min(end, a + (1 << 20)))
                    index = np.empty(len(slot), np.int64)
                    for turn in np.unique(slot // n).tolist():
                        of = slot // n == turn
                        index[of] = permuted(slot[of] % n, n, seed * 1_000_003 + source * 1009 + turn)
                    yield pa.record_batch([pa.array(np.full(len(slot), source)), pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(index)], ["source", "shard", "slot", "index"])

    listed = spark.createDataFrame(spans, "source long, shard long, start long, end long, blocks long")
    listed = listed.repartition(max(1, min(len(spans), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    every = listed.mapInArrow(slots, "source long, shard long, slot long, index long")
    used = every.groupBy("source", "index").agg(F.sort_array(F.collect_list(F.struct("slot", "shard"))).alias("slots"))  # one for each pass, most at most

    d = placed(sized.read()).join(facts, ["name", "known"])
    spread = d.where("size > 0").select("doc_id", "row", "source", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("index"))
    words = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("start"), F.col("index") * block)
    first = F.greatest(F.lit(0), F.col("index") * block - F.col("start"))
    # Blocks grow with the corpus: a merge join, as small shuffle files are no bound on what a broadcast would hold.
    return d, spread.join(used.hint("merge"), ["source", "index"]).select("doc_id", "row", "source", "start", first.alias("first"), words.alias("words"), "slots"), every.join(facts.select("source", "name", "known"), "source")


def plan(docs: DataFrame, **settings: object) -> DataFrame:
    """Which block of which source each slot of each output shard takes: shard, slot (numbered through a source's shards), source, index."""
    every = _taken(docs, **settings)[2]
    return every.select("shard", "slot", F.when(F.col("known"), F.col("name")).alias("source"), "index")


def mix(docs: DataFrame, **settings: object) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard of every row of docs.

    taken counts the words that the mix takes from the document, repeats counted; first_shard is the least output shard that
    takes any, null if none does. A source's
    taken words differ from its target by less than a block, or by what the last, shorter
    block of its stream lacks. Needs columns doc_id, text and source; others are ignored. A null or empty
    text has size 0 and gives nothing; a null source is one source, last in order. Repeated rows
    each take part. Empty tables give empty results. Sources are few (their totals are
    gathered); documents, words and blocks are not. settings are those of _taken.
    """
    d, parts, _ = _taken(docs, **settings)
    taken = parts.groupBy("doc_id", "row", "source", "start").agg(F.sum(F.col("words") * F.size("slots")).alias("taken"), F.min(F.array_min("slots.shard")).alias("first_shard"))
    taken = taken.select(*(F.col(c).alias(f"of_{c}") for c in ("doc_id", "row", "source", "start")), "taken", "first_shard")
    on = F.expr("of_doc_id <=> doc_id and of_row = row and of_source = source and of_start = start and size > 0")
    return d.join(taken, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed(docs: DataFrame, sharded: bool = False, **settings: object) -> DataFrame:
    """The mix itself, with the columns of docs: for each document and pass over its source, the words that the pass takes.

    A text taken whole stays as it is; of others the taken words remain, in order, with single
    spaces; n_chars, if there, follows. What no pass takes is gone, as are null and empty texts. Null ids and sources, repeated rows and empty tables
    are as in mix(); further columns may have any name and type. With sharded, rows are a struct doc of these columns and the
    output shard that they belong to, the one that drew the first of the row's blocks.
    """
    _, parts, _ = _taken(docs, **settings)
    lists = parts.groupBy("doc_id", "row", "start").agg(F.sort_array(F.collect_list(F.struct("first", "words", "slots"))).alias("parts"))  # blocks of one document
    copies = F.sort_array(F.collect_list(F.struct("start", "parts"))).alias("copies")  # rows of one id and text
    lists = lists.groupBy(F.struct("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(copies)
    # The row travels as a struct, so that no column of docs can meet one of these names. Copies are counted and joined by the same keys, null ids
    # as equal structs, so that texts are shuffled once.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.struct("doc_id").alias("id"), F.xxhash64(text).alias("row"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "row").orderBy(F.lit(0))))
    joined = rows.join(lists, F.expr("of_id = id and of_row = row")).withColumn("parts", F.get("copies", F.col("copy") - 1)["parts"]).where("parts is not null").drop("copies")
    joined = joined.withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: F.size(p["slots"]))))))
    joined = joined.withColumn("taken", F.filter("parts", lambda p: F.size(p["slots"]) >= F.col("pass"))).withColumn("words", F.array_remove(F.split("doc.text", "[\\x20\\x09-\\x0D]+"), ""))
    some = F.array_join(F.flatten(F.transform("taken", lambda p: F.slice("words", (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    whole = F.aggregate("taken", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.size("words")
    out = joined.withColumn("left", F.when(whole, F.col("doc.text")).otherwise(some))
    of = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("left")}
    if "n_chars" in of:
        of["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    if not sharded:
        return out.select(*(x.alias(c) for c, x in of.items()))
    first = F.array_min(F.transform("taken", lambda p: F.element_at(p["slots"], F.col("pass")))).getField("shard")
    return out.select(F.struct(*(x.alias(c) for c, x in of.items())).alias("doc"), first.alias("shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
