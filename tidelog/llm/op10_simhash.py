"""SimHash near-duplicates by bit-sliced comparison.

Two fingerprints of 64 bits that differ in at most RADIUS = 3 bits agree on three of six
bit blocks at least, so each distinct fingerprint enters 20 tables, one for each choice of three
blocks, keyed by those 31 to 33 bits. Fingerprints that share a key are compared
bit-sliced: bit planes are stored vertically, 64 fingerprints to a word; XOR with a
query's bit gives the differing lanes of a plane; carry-save counters add them up for
64 pairs at a time; a word is abandoned once all its lanes exceed the radius.

A key with more than HOT fingerprints is refined before anything is gathered: its other bits are
cut into eight parts, of which five agree, so the members move on to 56 finer keys
of at least 51 bits. At most 2**13 distinct fingerprints can share one, so tasks stay bounded with no
cap on candidates. Within a bucket only a spanning forest of the links is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.common import Written
from tidelog.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints that share a key beyond which the key is refined.
HOT = 2048
#: (query, word) pairs compared at once.
PAIRS = 1 << 18


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of the given bit positions."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _masks(radius: int) -> list[tuple[int, list[int]]]:
    """The mask of each table, and the masks of its finer keys."""
    out = []
    for kept in combinations(_cut(list(range(64)), 2 * radius), radius):
        mask = sum(kept)
        rest = _cut([b for b in range(64) if not mask >> b & 1], radius + 5)
        out.append((mask, [mask | sum(part) for part in combinations(rest, 5)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(joined))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in common.chunks(batches, 4 << 20):
            h = np.array([fingerprint(t, shingle) for t in found], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(h)], ["doc_id", "h"])

    return common.texts(docs).mapInArrow(run, "doc_id long, h long")


def planes_of(h: np.ndarray) -> np.ndarray:
    """The 64 bit planes of fingerprints, each with 64 of them to a word."""
    n = -(-len(h) // 64) * 64
    bits = np.unpackbits(np.r_[h, np.zeros(n - len(h), np.uint64)].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compares queries[k] with the 64 lanes of word[k], for all k at once.

    Returns the k and the lane masks of those words that have a lane within the radius.
    """
    alive, full = np.arange(len(queries)), np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    counters, over = [np.zeros(len(queries), np.uint64) for _ in range(digits)], np.zeros(len(queries), np.uint64)
    q, w = queries, word
    for p in range(64):
        carry = planes[p][w] ^ (np.uint64(0) - (q >> np.uint64(p) & np.uint64(1)))  # lanes whose bit p differs
        for digit in range(digits):
            counters[digit], carry = counters[digit] ^ carry, counters[digit] & carry
        over |= carry
        if p % 8 == 7:
            keep = np.flatnonzero(over != full)
            if len(keep) < 0.7 * len(over):
                alive, q, w, over = alive[keep], q[keep], w[keep], over[keep]
                counters = [c[keep] for c in counters]
    above, equal = np.zeros(len(over), np.uint64), np.full(len(over), full)
    for digit in reversed(range(digits)):
        bit = full if radius >> digit & 1 else np.uint64(0)
        above |= equal & counters[digit] & ~bit
        equal &= ~(counters[digit] ^ bit)
    hit = ~(over | above)
    some = np.flatnonzero(hit)
    return alive[some], hit[some]


def forest(key: np.ndarray, h: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints that share a key. Both arrays are sorted by key."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    planes, root = planes_of(h), np.arange(n)
    query = np.flatnonzero(end - np.arange(n) > 1)
    first, last = (query + 1) // 64, (end[query] - 1) // 64
    at = 0
    ends = np.cumsum(last - first + 1)
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        many = (last - first + 1)[at:to]
        q = np.repeat(query[at:to], many)
        word = np.repeat(first[at:to], many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
        k, lanes = near(h[q], planes, word, radius)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        a, b = q[k[row]], word[k[row]] * 64 + lane
        own = (b > a) & (b < end[a])
        _union(root, a[own], b[own])
        at = to
    child = np.flatnonzero(root != np.arange(n))
    return h[child], h[root[child]]


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[k] and b[k]; root keeps pointing to the least index of each tree."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_h = np.empty(0, np.int64), np.empty(0, np.int64)

        def link(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            u, v = forest(key, h.view(np.uint64), radius)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            key, h = np.r_[held_key, b.column(0).to_numpy()], np.r_[held_h, b.column(1).to_numpy()]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if whole:
                yield link(key[:whole], h[:whole])
            held_key, held_h = key[whole:], h[whole:]
        if len(held_key) > 1:
            yield link(held_key, held_h)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints h within the radius of each other."""
    spark, masks = distinct.sparkSession, _masks(radius)
    h = F.col("h")
    keyed = distinct.select("h", F.posexplode(F.array(*(h.bitwiseAND(F.lit(_signed(m))) for m, _ in masks))).alias("t", "m")).select(F.xxhash64("t", "m").alias("key"), "h", "t")
    often = Written(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
    if often.read().isEmpty():
        fine = keyed.select("key", "h")
    else:
        # finer masks as literals of the table that a row is in
        finer = spark.createDataFrame([(t, s, _signed(m)) for t, (_, ms) in enumerate(masks) for s, m in enumerate(ms)], "t int, s int, mask long")
        moved = keyed.join(often.read(), "key", "left_semi").join(F.broadcast(finer), "t")  # masks: 20 x 56 rows, always
        moved = moved.select(F.xxhash64("t", "s", h.bitwiseAND(F.col("mask"))).alias("key"), "h")
        fine = keyed.join(often.read(), "key", "left_anti").select("key", "h").unionByName(moved)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.rdd.getNumPartitions())
    return fine.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Needs columns
    doc_id and text; others are ignored. A null or empty text has fingerprint zero, which
    links like any other. Rows with equal fingerprints are one node; null ids never
    are a component's smallest unless it has no other. Empty tables give empty results.
    """
    marked = Written(fingerprints(docs, shingle), "fingerprints")
    nodes = _rooted(marked, radius, hot)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("h", "component_id")
    return marked.read().join(nodes, "h").select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(marked: Written, radius: int, hot: int) -> DataFrame:
    """h, least doc_id and root of every distinct fingerprint; the root is one fingerprint of its component."""
    distinct = Written(marked.read().groupBy("h").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.read().select("h"), radius, hot))
    common.release(marked.spark)
    return distinct.read().join(roots, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("root", "h").alias("root"))


def survivors(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The rows of docs that stay: one of each group of near-duplicates, the one with the least (doc_id, fingerprint, text hash).

    A null id comes after all others. Groups are of texts, whatever ids their rows have: rows that share an
    id, or have none, but not a fingerprint's neighbourhood all stay. Rows with equal texts are one group's; of those
    that have its least id too, one stays. A null or empty text has fingerprint zero and groups like any other. Empty tables give
    empty results; further columns may have any name and type.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = Written(fingerprints(docs.select(text.alias("doc_id"), "text"), shingle), "fingerprints")  # an id for each text
    nodes = _rooted(marked, radius, hot).select("h", "root")
    ids = docs.groupBy(text.alias("doc_id")).agg(F.min("doc_id").alias("least"))
    found = marked.read().distinct().join(nodes, "h").join(ids, "doc_id")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h", F.col("doc_id").alias("text")))
    stay = found.groupBy("root").agg(first.alias("x")).select(F.col("x.text").alias("stays"), F.col("x.least").alias("least"))
    # The row travels as a struct, so that no column of docs can meet one of these names.
    rows = docs.select(text.alias("hash"), F.col("doc_id").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    kept = rows.join(stay, F.expr("hash = stays and id <=> least"), "left_semi").dropDuplicates(["hash"])
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
