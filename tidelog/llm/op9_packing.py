"""Packing into fixed windows by minimum bin slack.

Each task packs its own partition, so nothing is shuffled: at any scale the only
cost of locality is one tail for each task. Documents longer than a window give full
windows; the remainders wait in a pool. A window is filled by a bitset subset-sum
over the pool's lengths: bit s of the bitset says that s tokens can be made up
exactly; the highest bit up to the window names the least slack, and walking the
bitsets back gives how many documents of each length to take. What slack is left is filled with the
start of a longer document. A tail shorter than a window is cut at powers of two,
where no padding is due.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import common
from tidelog.llm.op1_token_counts import vocabulary_path
from tidelog.llm.pretokens import PreTokens

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker keeps. Beyond it the table starts anew; results don't depend on it.
KEPT = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ids: dict[str, WordIds] = {}


class WordIds(dict):
    """Ids of white-space chunks, each worked out once while it is kept."""

    def __init__(self, path: str):
        super().__init__()
        self.pretokens = PreTokens(path)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.pretokens.of(chunk.decode())
        return ids

    def of(self, text: bytes) -> bytes:
        if len(self) > KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


class Packer:
    """Packs documents, given as id bytes, into sequences; bounded by the pool of remainders it holds."""

    def __init__(self, window: int, first_sequence: int, with_ids: bool = False):
        self.window, self.sequence, self.with_ids = window, first_sequence, with_ids
        self.pool: dict[int, deque] = defaultdict(deque)  # length: (document, start) of each remainder
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n, doc = len(ids) // 4, (doc_id, ids)
        for start in range(0, n - n % self.window, self.window):
            self.emit([(doc, start, self.window)])
        if n % self.window:
            self.wait(doc, n - n % self.window)

    def wait(self, doc: tuple, start: int) -> None:
        n = len(doc[1]) // 4 - start
        self.pool[n].append((doc, start))
        self.waiting += n

    def take(self, n: int) -> tuple:
        doc, start = self.pool[n].popleft()
        if not self.pool[n]:
            del self.pool[n]
        self.waiting -= n
        return doc, start, n

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for (doc_id, ids), start, n in pieces:
            piece = memoryview(ids)[4 * start : 4 * (start + n)]
            self.rows.append((doc_id, start, n, zlib.crc32(piece), len(ids) // 4, self.sequence, at, *([bytes(piece)] if self.with_ids else [])))
            at += n
        self.sequence += 1

    def closest(self, room: int) -> list[int]:
        """Lengths in the pool whose sum comes closest to room from below; the longest is one of them."""
        lengths = sorted(self.pool, reverse=True)
        full = (1 << (room + 1)) - 1
        reach, steps = 1 << lengths[0], []
        for k, n in enumerate(lengths):
            for _ in range(min(len(self.pool[n]) - (k == 0), room // n)):
                more = (reach | reach << n) & full
                if more == reach:
                    break
                steps.append((n, reach))
                reach = more
            if reach >> room:
                break
        left, chosen = reach.bit_length() - 1, [lengths[0]]
        for n, before in reversed(steps):
            if not before >> left & 1:
                chosen.append(n)
                left -= n
        return chosen

    def fill(self, keep: int) -> None:
        """Emits windows while keep tokens at least stay in the pool, so that later windows have a choice."""
        while self.waiting >= max(self.window, keep):
            pieces = [self.take(n) for n in self.closest(self.window)]
            slack = self.window - sum(n for _, _, n in pieces)
            if slack:
                doc, start, _ = self.take(max(self.pool))
                pieces.append((doc, start, slack))
                self.wait(doc, start + slack)
            self.emit(pieces)

    def finish(self) -> None:
        self.fill(0)
        while self.waiting:
            room, pieces = 1 << (self.waiting.bit_length() - 1), []
            while room:
                doc, start, n = self.take(max(self.pool))
                used = min(n, room)
                pieces.append((doc, start, used))
                if n > used:
                    self.wait(doc, start + used)
                room -= used
            self.emit(pieces)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence of at most window tokens.

    A document's tokens are its text's ids and end_id. Every token is in one piece;
    the pieces of a sequence follow each other from offset 0. All sequences are full but
    at most log2(window) in each partition, whose sizes are powers of two.

    Needs columns doc_id and text; others are ignored. A null or empty text has
    one token, end_id. Repeated rows and null ids are packed like any other. An empty
    table gives no rows. Texts of any length are packed whole. Sequence ids are the
    partition's number times 2**32 and a running number, alike in reruns over the same files. With
    with_ids a last column ids has each piece's tokens, little-endian unsigned 32-bit: the packed sequences themselves.
    """
    path, schema = path or vocabulary_path(), SCHEMA + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids.get(path) or _ids.setdefault(path, WordIds(path))
        end = array("I", [end_id]).tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 32, with_ids)

        def rows() -> pa.RecordBatch:
            out, packer.rows = packer.rows, []
            return pa.record_batch([pa.array(c, pa.int64() if k < 7 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], [c.split()[0] for c in schema.split(", ")])

        for ids, found in common.chunks(batches, 4 << 20):
            for i, t in zip(ids, found, strict=True):
                packer.add(i, words.of(t) + end)
            packer.fill(64 * window)
            if packer.rows:
                yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return common.texts(docs).mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
