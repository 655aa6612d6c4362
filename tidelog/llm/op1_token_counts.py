"""Token counts without materialising ids.

A text is cut at ASCII white space, which no token crosses, and its chunks into pre-tokens. The distinct pre-tokens of
all documents are a table, and the pieces of each are counted once. A document's count is the join of its
pre-token frequencies with that table, summed. The join is in two parts, as frequencies are most of a corpus: the HEAD most
frequent pre-tokens, of SHORT bytes at most, are a table of bounded size that every task holds (by classes of uses, counted over the whole table, so that no task sends candidates); the others' frequencies
go to the distributed table by key, and only their sums come back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.common import Written
from tidelog.llm.pretokens import PreTokens

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens that every task holds, and their bytes at most: 16 MB of keys.
HEAD, SHORT = 1 << 18, 64
#: Entries of a worker's tables. Beyond it a table is sent or starts anew; results don't depend on it.
KEPT = 300_000

_made: dict[str, PreTokens] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pretokens(path: str) -> PreTokens:
    return _made.get(path) or _made.setdefault(path, PreTokens(path))


def pretoken_table(docs: DataFrame, path: str) -> DataFrame:
    """part, uses and pieces of every distinct pre-token of docs; pieces are counted after the rows of a pre-token have met."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, uses = _pretokens(path).parts, Counter()

        def sent() -> pa.RecordBatch:
            out = Counter()
            for chunk, n in uses.items():
                for p in parts(chunk.decode()):
                    out[p] += n
            uses.clear()
            return pa.record_batch([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["part", "n"])

        for _, texts in common.chunks(batches, 4 << 20):
            for t in texts:
                uses.update(t.split())
            if len(uses) > KEPT:
                yield sent()
        if uses:
            yield sent()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _pretokens(path).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(count, b.column(0).to_pylist()), pa.int64())], ["part", "uses", "pieces"])

    distinct = common.texts(docs).mapInArrow(found, "part string, n long").groupBy("part").agg(F.sum("n").alias("uses"))
    return distinct.mapInArrow(counted, "part string, uses long, pieces long")


def _head(table: DataFrame, most: int) -> DataFrame:
    """The most frequent short pre-tokens, most at most: all of the highest classes of uses that fit whole. An eighth of a doubling is a class."""
    known = table.where(F.octet_length("part") <= SHORT).withColumn("often", F.floor(F.log2("uses") * 8))
    room, least = most, 1 << 10
    for r in sorted(known.groupBy("often").count().collect(), reverse=True):  # 512 classes at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r.often
    return known.where(F.col("often") >= least).select("part", "pieces")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    Needs columns doc_id (bigint) and text; others, whatever their names, are ignored. A null
    or empty text counts 0 bytes and 0 tokens. Null ids and repeated rows stay, one
    result for each row. Empty tables give empty results. Texts of any length are
    counted whole, one white-space chunk at a time.
    """
    path, spark = path or vocabulary_path(), docs.sparkSession
    table = Written(pretoken_table(docs, path), "pretokens").read()
    often = _head(table, head).toArrow()  # HEAD entries of SHORT bytes at most
    known = spark.sparkContext.broadcast(dict(zip(often["part"].to_pylist(), often["pieces"].to_pylist(), strict=True)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pieces_of = _pretokens(path).parts, known.value
        chunks: dict[bytes, int] = {}  # pieces of a chunk, -1 where a part of it is not in the head
        row = TaskContext.get().partitionId() << 40
        for ids, texts in common.chunks(batches, 4 << 20):
            if len(chunks) > KEPT:
                chunks.clear()
            sums, tails = [], []
            for t in texts:
                n, tail = 0, Counter()
                for chunk, times in Counter(t.split()).items():
                    pieces = chunks.get(chunk)
                    if pieces is None:
                        counts = [pieces_of.get(p, -1) for p in parts(chunk.decode())]
                        pieces = chunks[chunk] = -1 if -1 in counts else sum(counts)
                    if pieces >= 0:
                        n += pieces * times
                    else:
                        for p in parts(chunk.decode()):
                            tail[p] += times
                sums.append(n)
                tails.append(list(tail.items()) or None)
            rows = range(row, row + len(ids))
            row += len(ids)
            kind = pa.list_(pa.struct([("part", pa.string()), ("times", pa.int64())]))
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(sums, pa.int64()), pa.array(_structs(tails), kind)], ["row", "doc_id", "n_bytes", "n", "tail"])

    # Written, so that rows keep their numbers whatever is computed again.
    found = Written(common.texts(docs).mapInArrow(joined, "row long, doc_id long, n_bytes long, n long, tail array<struct<part: string, times: long>>"), "frequencies").read()
    rare = found.where("tail is not null").select("row", F.explode("tail").alias("x")).select("row", "x.part", "x.times")
    # A rare pre-token has few rows, by its place behind the head: its join needs no salt.
    more = rare.join(table.select("part", "pieces").hint("merge"), "part").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = found.where("tail is null").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    rest = found.where("tail is not null").select("row", "doc_id", "n_bytes", "n").join(more.hint("merge"), "row")
    counted = out.unionByName(rest.select("doc_id", "n_bytes", (F.col("n") + F.col("more")).alias("n_tokens")))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _structs(tails: list) -> list:
    return [t and [{"part": p, "times": n} for p, n in t] for t in tails]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
