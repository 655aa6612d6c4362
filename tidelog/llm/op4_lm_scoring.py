"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is a bigram model that backs off with Witten-Bell weights. With c the count of a
context u and T the number of its distinct successors, BACK_OFF times,

    p(w | u) = c(u w) / (c + T)           if u w was seen,
               T / (c + T) * p(w)         if only u was seen,
               p(w)                       otherwise,      p(w) = (c(w) + 1) / (N + V + 1).

Every text begins in one common context and ends with an end token.

Nothing that grows with the corpus is broadcast. Documents are packed into cells; a cell
sends each shard its distinct (context, word) pairs, hashed and with their training counts, once. A
shard sums the counts, builds its part of the trie of quantised probabilities, asks it for every pair it was sent and
answers one byte for each pair and the counts of each context. As every word of a text
is the context of its next token, the contexts' counts are the words' own, and
one exchange serves both the model and the base score.

Contexts with a HEAVY share of a bounded sample, taken by a hash of the rows, spread their pairs over all shards
by word. Their c and T then are sums over shards: at most 1 / HEAVY rows that the last step gets. Their part of the trie
holds counts, which the last step turns into the same probabilities by the same formula and quantises on the
same grid, so scores don't depend on which contexts are heavy, nor on how files are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.cells import Cells, exchange, opened, parcel_batch, parcels, together
from tidelog.llm.common import Written
from tidelog.llm.elias_fano import Trie

#: Share of the sample's tokens from which on a context is spread; rows in the sample, about.
HEAVY, SAMPLE = 0.001, 8192
#: Weight of a context's distinct successors against its count.
BACK_OFF = 4
#: Quantised log10 of probabilities: LEVELS steps of STEP from 0 down, to 10**-15.9, less than any corpus can hold a pair.
STEP, LEVELS = 1 / 16, 254
#: Input bytes of a shard.
SHARD = 2 << 20
BEGIN, END = np.uint64(1), np.uint64(2)  # hashes of the begin context and the end token; words hash above them
SPACE = "[\\x20\\x09-\\x0D]+"


def word_hash(word: bytes) -> int:
    return common.word_hash(word) >> 2 | 4


class Tokens:
    """The distinct (context, word) pairs of a cell, in the order in which shards get them."""

    def __init__(self, blobs: list[bytes], n: int, heavy: np.ndarray):
        self.ids, texts, rest = opened(blobs)
        self.held = rest.column(0).to_numpy() if rest else np.empty(0, bool)
        number: dict[bytes, int] = {}
        flat, sizes = [], []
        for t in texts:
            words = t.lower().split()
            for w in words:
                if w not in number:
                    number[w] = len(number) + 2
            flat.append(0)
            flat += map(number.__getitem__, words)
            flat.append(1)
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.hashes = np.r_[BEGIN, END, np.fromiter(map(word_hash, number), np.uint64, len(number))]
        flat = np.array(flat, np.int64)
        u, w = flat[:-1], flat[1:]
        inside = u != 1
        u, w = u[inside], w[inside]
        self.w = w
        pairs, self.pair = np.unique(u * len(self.hashes) + w, return_inverse=True)
        pu, pw = pairs // len(self.hashes), pairs % len(self.hashes)
        hu, hw = self.hashes[pu], self.hashes[pw]
        seen = np.bincount(self.pair[~np.repeat(self.held, self.sizes)], minlength=len(pairs))
        with np.errstate(over="ignore"):
            shard = common.mix(np.where(np.isin(hu, heavy), hu + common.mix(hw), hu)) % np.uint64(n)
        order = np.lexsort((hw, hu, shard))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.u, self.hu, self.hw, self.seen, self.shard = pu[order], hu[order], hw[order], seen[order], shard[order].astype(np.int32)


def _heavy(docs: DataFrame, share: float, sample: int) -> np.ndarray:
    """Hashes of the contexts with so large a share of a sample's tokens, and the begin context.

    The sample is of rows whose id and text hash below a bound, the same however rows lie in files.
    """
    part = min(1.0, sample / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    some = docs.where(chosen).select(F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).alias("w"))
    counts = some.select(F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w")).groupBy("w").count()
    least = share * max(1, (some.count()))
    found = counts.where(F.col("count") >= least).select("w").collect()  # at most 1 / share rows
    return np.unique(np.array([BEGIN, *(np.uint64(word_hash(r.w.encode())) for r in found)], np.uint64))


def _quantised(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The code of count / context, from 1; 0 for pairs that never occur."""
    steps = np.rint((np.log10(np.maximum(context, 1)) - np.log10(np.maximum(count, 1))) / STEP)
    return np.where(count > 0, 1 + np.clip(steps, 0, LEVELS), 0).astype(np.uint8)


def _counted(u: np.ndarray, w: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs that training has, in order, and their counts."""
    some = np.flatnonzero(seen)
    some = some[np.lexsort((w[some], u[some]))]
    u, w, seen = u[some], w[some], seen[some]
    new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.empty(0, np.int64)
    return u[new], w[new], np.add.reduceat(seen, new) if len(new) else seen


def score(docs: DataFrame, held: str, heavy_share: float = HEAVY, sample: int = SAMPLE) -> DataFrame:
    """Scores every row of docs with the model of those rows whose boolean column held is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Needs columns doc_id (bigint), text and
    held; others are ignored. A null or empty text has one token, the end. A null held
    counts as false. Repeated rows each train and each get a row; null ids keep theirs. Empty tables
    give empty results; with no training row every p(w) is 1. Texts are
    scored whole. Words are compared by 62-bit hashes, successors of one context by the
    top 40 bits or more; probabilities are quantised to 16 steps a decade. Scores follow from the rows alone.
    """
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    n, fan = common.shards(docs, SHARD), common.FAN
    heavy = _heavy(docs, heavy_share, sample)
    cells = Cells(docs, n, ["held"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = Tokens(blobs, n, heavy)
                # Contexts rise within a shard and words within a context, so their differences compress.
                yield parcel_batch(parcels([t.shard, np.full(len(t.u), number, np.int32), t.hu, t.hw, t.seen.astype(np.int32)], n, fan))

    def answer(table: pa.Table) -> pa.Table:
        shard, cell, u, w, seen = together(table.column("blob").to_pylist())
        x, y, c = _counted(u, w, seen.astype(np.int64))
        contexts, rank = np.unique(x, return_inverse=True)
        count, kinds = np.bincount(rank, c, len(contexts)).astype(np.int64), np.bincount(rank, minlength=len(contexts))
        spread = np.isin(contexts, heavy)
        codes, counts, types = np.zeros(len(u), np.uint8), np.zeros(len(u), np.int64), np.zeros(len(u), np.int32)
        first = np.r_[True, (u[1:] != u[:-1]) | (cell[1:] != cell[:-1])]
        single = np.isin(u, heavy)
        for of, asks, values in ((spread, single, c), (~spread, ~single, _quantised(c, (count + BACK_OFF * kinds)[rank]))):
            own = of[rank]
            if not own.any() or not asks.any():
                continue
            renumbered = np.cumsum(of) - 1
            trie = Trie(contexts[of], renumbered[rank[own]], y[own], values[own])
            r, place = trie.find(u[asks], w[asks])
            found = np.where(place >= 0, trie.values[np.maximum(place, 0)], 0)
            if of is spread:
                counts[asks] = found
            else:
                codes[asks] = found
                known = first[asks] & (r >= 0)
                at = np.flatnonzero(asks)[known]
                counts[at], types[at] = count[of][r[known]], kinds[of][r[known]]
        rows = [(g, x, None, None, None) for g, x in parcels([cell, shard, codes, counts, types], n, fan)]
        rows += [(None, None, int(h) - (1 << 63), int(a), int(b)) for h, a, b in zip(contexts[spread], count[spread], kinds[spread], strict=True)]
        own = ~spread & (contexts != BEGIN)
        rows.append((None, None, None, int(count[own].sum()), int(own.sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["group", "blob", "h", "c", "t"])

    sent = exchange(cells.read().select("cell", "docs").mapInArrow(asked, "group int, blob binary"), n, fan)
    answers = Written(sent.groupBy("group").applyInArrow(answer, "group int, blob binary, h long, c long, t long"), "answers")
    common.release(docs.sparkSession)
    stats = {r.h: (r.c, r.t) for r in answers.read().where("group is null").groupBy("h").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()}
    tokens, kinds = stats.pop(None, (0, 0))
    table = {h + (1 << 63): ct for h, ct in stats.items()}
    train_docs = table.get(int(BEGIN), (0, 0))[0]  # each training text begins once and ends once
    tokens += sum(c for h, (c, _) in table.items() if h != int(BEGIN)) + train_docs
    kinds += sum(h != int(BEGIN) and c > 0 for h, (c, _) in table.items()) + (train_docs > 0)
    heavy_h = np.array(sorted(table), np.uint64)
    heavy_c, heavy_t = (np.array([table[int(h)][k] for h in heavy_h], np.float64) for k in range(2))
    space = float(tokens + kinds + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blobs, found in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                t = Tokens(blobs, n, heavy)
                if not len(t.ids):
                    continue
                _, shard, codes, counts, types = together(found)
                order = np.argsort(shard, kind="stable")  # a shard's answers are in the order of the questions
                codes, counts, types = codes[order], counts[order], types[order]
                c, kinds_of = np.zeros(len(t.hashes)), np.zeros(len(t.hashes))
                spread = np.isin(t.hashes, heavy)
                single = spread[t.u]
                has = np.flatnonzero(~single & (counts > 0))
                c[t.u[has]], kinds_of[t.u[has]] = counts[has], types[has]
                k = np.minimum(np.searchsorted(heavy_h, t.hashes), max(0, len(heavy_h) - 1))
                if len(heavy_h):
                    is_in = heavy_h[k] == t.hashes
                    c[is_in], kinds_of[is_in] = heavy_c[k[is_in]], heavy_t[k[is_in]]
                total, context_total = c.copy(), np.maximum(c + BACK_OFF * kinds_of, 1)
                codes[single] = _quantised(counts[single], context_total[t.u[single]])
                total[0], total[1] = 0, train_docs
                alone = np.log10(total + 1) - np.log10(space)
                back = np.where(c > 0, np.log10(np.maximum(BACK_OFF * kinds_of, 1) / context_total), 0.0)
                pair = t.rank[t.pair]
                token = np.where(codes[pair] > 0, (1 - codes[pair].astype(np.float64)) * STEP, back[t.u[pair]] + alone[t.w])
                starts = np.cumsum(t.sizes) - t.sizes
                sums = [np.add.reduceat(x, starts) for x in (alone[t.w], token, (total[t.w] > 0).astype(np.int64))]
                yield pa.record_batch(
                    [pa.array(t.ids, pa.int64()), pa.array(t.held), pa.array(t.sizes), pa.array(sums[2]), pa.array(np.full(len(t.ids), tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    replies = exchange(answers.read().where("group is not null").select("group", "blob"), n, fan)
    return cells.with_answers(replies).select("docs", "answers0").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs.select("doc_id", "text", out.alias("out")), "out")
