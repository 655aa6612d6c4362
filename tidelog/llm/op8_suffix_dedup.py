"""Exact substring deduplication over a sparse, distributed suffix array.

Every string of LENGTH bytes has an anchor: the place of its least-hashed GRAM bytes. Equal
strings have equal anchors at equal places, so a string can only occur twice if its anchor does.
Round one sends each cell's distinct anchor hashes (one byte in ten has an anchor) and learns which occur elsewhere;
round two builds the suffix array of the strings that those anchors stand for: splitters sampled from the corpus range-partition them by the leading
GRAM bytes of their anchors, so that equal strings meet in one bucket and no neighbours across a
boundary share as much as an anchor; a bucket sorts the suffixes by multikey quicksort over 8-byte characters, compares neighbours, and
gives each run that shares LENGTH bytes the least doc_id that has it.

The corpus is first packed into cells, tables of whole documents bucketed by a hash of id and text.
Exact copies of a text with a smaller id are found by a hash of the whole text and take no part
in what follows: nothing is left of them. Suffixes travel as contexts, the text that an anchor's strings span, once for each cell and distinct context. What a cell sends of
any one string is a single entry, so a passage in a third of all documents
is no larger to its bucket than the number of cells. An anchor that more than HOT cells have is sent as
its single strings, spread by their hash: a frequent short phrase with ever other
surroundings does not gather in one bucket. Where the contexts of all buckets are more than PASS times the cells as stored, ranges of
buckets take their turns: a pass makes the contexts of its own anchors only, and what it has sent goes before the next.
The last step applies the answers to the cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidelog.llm import common
from tidelog.llm.cells import PARCEL, Cells, exchange, opened, parcel_batch, parcels, together, widths
from tidelog.llm.common import Written, unpack
from tidelog.llm.suffixes import groups, least_places, numbered, row_hash

LENGTH, GRAM = 50, 32
#: Cells that an anchor may occur in before its strings are spread singly.
HOT = 64
#: Anchors from which splitters are taken, over all cells.
SAMPLE = 65_536
#: Bytes whose anchors are found at once.
STEP = 1 << 16
#: Strings that a bucket sorts at once; those of one anchor are never parted.
SORTED = 1 << 17
#: Contexts whose bytes are held twice at once.
ROWS = 1 << 15
#: Bytes that a context takes when packed; contexts that a pass sends, all rounds together, as a share of the cells as stored; slices of which passes are made.
CONTEXT, PASS, SLICES = 34, 1.8, 64
NO_ID = np.iinfo(np.int64).max  # a null doc_id is larger than any other
SHARED_NAMES = ["group", "blob", "part", "sent"]
WHOLE = -1  # instead of a start: all strings of a context

_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text: hash, place, and the first and last start of the strings that each stands for."""
    return _anchors(np.frombuffer(text, np.uint8), np.ones(max(0, len(text) - length + 1), bool), length, gram)


def _anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors() of the strings that begin where starts is true."""
    found = []
    for at in range(0, len(starts), STEP):
        own = np.flatnonzero(starts[at : at + STEP])
        if len(own):
            h = _gram_hashes(data[at : at + STEP + length - 1], gram)
            where = least_places(h, length - gram + 1)[own]
            new = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            found.append((h[where[new]], where[new] + at, own[new] + at, own[np.r_[new[1:], len(own)] - 1] + at))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    h, place, first, last = map(np.concatenate, zip(*found, strict=True))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # an anchor's strings may begin in two steps
    return h[new], place[new], first[new], last[np.r_[new[1:], len(place)] - 1]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = _BYTE[data]
        sums, width, have, parts = one, 1, None, 0
        while width <= gram:  # hashes of 1, 2, 4 ... bytes make up those of gram bytes
            if gram & width:
                have = sums if have is None else sums[: len(sums) - parts] * _power(parts) + have[width:][: len(sums) - parts]
                parts += width
            if 2 * width <= gram:
                sums = sums[:-width] * _power(width) + sums[width:]
            width *= 2
        return common.mix(have[: len(data) - gram + 1])


class Cell:
    """The documents of a cell, one after the other, and the anchors of them all."""

    def __init__(self, blobs: list[bytes], copies: list | None, length: int, gram: int):
        self.length, self.gram = length, gram
        self.width = -(-(2 * length - gram) // 8) * 8  # the longest context, in whole characters
        self.ids, self.texts, self.rest = opened(blobs)
        self.id_of = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        least = {bytes(h): i for x in copies or [] for h, i in x}
        self.copies = {d for d, t in enumerate(self.texts) if least and len(t) >= length and least.get(text_hash(t), NO_ID) < self.id_of[d]}
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(self.texts) + bytes(self.width), np.uint8)
        own = np.flatnonzero((sizes >= length) & ~np.isin(np.arange(len(sizes)), list(self.copies)))
        edges = np.zeros(len(self.data), np.int8)
        edges[self.begin[own]] = 1
        edges[self.begin[own] + sizes[own] - length + 1] = -1
        self.h, self.place, self.first, self.last = _anchors(self.data, np.cumsum(edges, dtype=np.int8) > 0, length, gram)
        self.h >>= np.uint64(16)
        self.doc = np.searchsorted(self.begin, self.first, side="right") - 1

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, width)[at] if len(at) else np.empty((0, width), np.uint8)

    def grams(self, anchor: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.rows(self.place[anchor], self.gram)).view(f"S{self.gram}").ravel()

    def contexts(self, elsewhere: np.ndarray, hot: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Contexts:
        """The contexts of anchors that another document may have, of wanted grams only; each string alone where the anchor is hot."""
        order = np.lexsort((self.id_of[self.doc], self.h)) if len(self.h) else np.empty(0, np.int64)
        h, i = self.h[order], self.id_of[self.doc[order]]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        ends = np.r_[start[1:], len(h)] - 1
        here = h[start[i[start] != i[ends]]] if len(h) else h
        at = np.flatnonzero(np.isin(self.h, np.union1d(elsewhere, here)))
        if wanted:
            at = at[wanted(self.grams(at))]
        alone = np.isin(self.h[at], hot)
        many = np.where(alone, self.last[at] - self.first[at] + 1, 1)
        anchor = np.repeat(at, many)
        single = np.repeat(alone, many)
        first = self.first[anchor] + np.where(single, np.arange(len(anchor)) - np.repeat(np.cumsum(many) - many, many), 0)
        size = np.where(single, self.length, self.last[anchor] - first + self.length)
        return Contexts(self, self.doc[anchor], first, size, np.where(single, -1, self.place[anchor] - first))


class Contexts:
    """The distinct contexts of a cell, and where each occurs in it."""

    def __init__(self, cell: Cell, doc: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray):
        self.cell, self.id, self.at = cell, cell.id_of[doc], first
        parts = [slice(k, k + ROWS) for k in range(0, len(doc), ROWS)]
        found = [_hashes(masked(cell.rows(self.at[p], cell.width), size[p]), size[p]) for p in parts]
        one, self.number = numbered(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.begin, self.size, self.anchor = self.at[one], size[one].astype(np.int16), anchor[one].astype(np.int16)
        self.least = np.full(len(one), NO_ID)
        np.minimum.at(self.least, self.number, self.id)

    def rows(self) -> np.ndarray:
        """The contexts' bytes, zeros after each."""
        out = np.empty((len(self.begin), self.cell.width), np.uint8)
        for k in range(0, len(out), ROWS):
            out[k : k + ROWS] = masked(self.cell.rows(self.begin[k : k + ROWS], self.cell.width), self.size[k : k + ROWS])
        return out


def text_hash(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def masked(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """rows with zeros from each row's size on."""
    return rows * (np.arange(rows.shape[1]) < size[:, None])


def _hashes(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each context. The size tells apart texts that end in zero bytes; the anchor's place follows from the text."""
    with np.errstate(over="ignore"):
        return tuple(common.mix(row_hash(rows.view(">u8"), seed) * np.uint64(0xD1342543DE82EF95) + size.astype(np.uint64)) for seed in (0, 1))


def _windows(rows: np.ndarray, row: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width bytes of the given rows, from at on in each."""
    if not len(row):
        return np.empty((0, width), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(rows.reshape(-1), width)[row * rows.shape[1] + at]


def _anchor_keys(rows: np.ndarray, anchor: np.ndarray, gram: int) -> np.ndarray:
    """The gram bytes of each row from its anchor on; from its begin where it is a single string."""
    return _windows(rows, np.arange(len(rows)), np.maximum(anchor, 0).astype(np.int64), gram)


def _judge(rows: np.ndarray, size: np.ndarray, anchor: np.ndarray, ids: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start) of every string of an entry that a smaller id has too; start is WHOLE where it has them all."""
    parts = [slice(k, k + ROWS) for k in range(0, len(rows), ROWS)]
    one, number = numbered(*(np.concatenate(x) for x in zip(*(_hashes(rows[p], size[p]) for p in parts), strict=True)))
    least = np.full(len(one), NO_ID)
    np.minimum.at(least, number, ids)
    # All strings of a context that a smaller id has, and of others those that other contexts of its anchor have.
    whole = np.flatnonzero(least[number] < ids)
    entry, start = [whole], [np.full(len(whole), WHOLE, np.int16)]
    key = [row_hash(_windows(rows, one[p], np.maximum(anchor[one[p]], 0).astype(np.int64), gram).view(np.uint64)) | np.uint64(1) for p in (slice(k, k + ROWS) for k in range(0, len(one), ROWS))]
    key = np.where(anchor[one] < 0, np.uint64(0), np.concatenate(key))
    kinds, of = np.unique(key, return_inverse=True)
    compared = np.flatnonzero((np.bincount(of)[of] > 1) & (key > 0))
    compared = compared[np.argsort(of[compared], kind="stable")]
    sizes = size[one][compared].astype(np.int64) - length + 1
    ends = np.cumsum(sizes)
    lost_of, lost_at = [], []
    a = 0
    while a < len(compared):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SORTED, side="right")))
        while b < len(compared) and of[compared[b]] == of[compared[b - 1]]:
            b += 1
        own = compared[a:b]
        n = sizes[a:b]
        context = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
        strings = np.zeros((len(context), -(-length // 8) * 8), np.uint8)
        for k in range(0, len(context), ROWS):
            strings[k : k + ROWS, :length] = _windows(rows, one[own[context[k : k + ROWS]]], at[k : k + ROWS], length)
        run = groups(strings.view(">u8"))
        low = np.full(run.max() + 1, NO_ID)
        np.minimum.at(low, run, least[own][context])
        lost = low[run] < least[own][context]
        lost_of.append(own[context[lost]])
        lost_at.append(at[lost].astype(np.int16))
        a = b
    if lost_of:
        # back to the entries of each context that keep it, the others lose it whole already
        lost_of, lost_at = np.concatenate(lost_of), np.concatenate(lost_at)
        firsts = np.flatnonzero(least[number] == ids)
        firsts = firsts[np.argsort(number[firsts], kind="stable")]
        begin, end = np.searchsorted(number[firsts], lost_of), np.searchsorted(number[firsts], lost_of, side="right")
        times = end - begin
        entry.append(firsts[np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])
        start.append(np.repeat(lost_at, times))
    return np.concatenate(entry), np.concatenate(start)


def _splitters(cells: Cells, n: int, length: int, gram: int) -> np.ndarray:
    """n - 1 leading grams that cut a sample of at most SAMPLE anchors into even parts."""
    count = cells.read().select("cell").count()
    each = max(1, SAMPLE // max(1, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for blobs in b.column(0).to_pylist():
                ids, texts, _ = unpack(sorted(blobs)[0])
                taken: list[bytes] = []
                for t in texts[: max(4, each // 8)]:
                    _, place, _, _ = anchors(t[:65_536], length, gram)
                    taken += [t[p : p + gram] for p in place.tolist()]
                    if len(taken) > 8 * each:
                        break
                out += taken[:: max(1, -(-len(taken) // each))]
            yield pa.record_batch([pa.array(out, pa.binary())], ["gram"])

    some = cells.read() if count <= SAMPLE else cells.read().where(F.pmod(F.xxhash64("cell"), F.lit(count)) < F.lit(SAMPLE))
    sample = np.sort(np.array([bytes(r.gram) for r in some.select("docs").mapInArrow(run, "gram binary").collect()], f"S{gram}"))
    return sample[(np.arange(1, n) * len(sample)) // n] if len(sample) else sample


def copies(cells: Cells, length: int = 1) -> DataFrame:
    """cell and its whole texts, by hash, that another document has too, each with the least id of all. A cell sends a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, texts, _ = opened(blobs)
                found: dict[bytes, list[int]] = {}
                for i, t in zip(ids, texts, strict=True):
                    if len(t) >= length:
                        i, h = NO_ID if i is None else i, text_hash(t)
                        had = found.setdefault(h, [i, i])
                        found[h] = [min(had[0], i), max(had[1], i)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())],
                        ["cell", "hash", "low", "high"],
                    )

    found = Written(cells.read().select("cell", "docs").mapInArrow(run, "cell int, hash binary, low long, high long"), "texts").read()
    least = found.groupBy("hash").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("hash", "least")
    return found.join(least, "hash").where("high > least").groupBy("cell").agg(F.collect_list(F.struct("hash", "least")).alias("copies"))  # texts of one cell


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a string of length bytes that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes as text, without characters that removal has cut) of every row of docs. Needs columns doc_id (bigint) and text; others are ignored.
    A null text is empty. Texts shorter than length lose nothing. Rows with the same
    id never take from each other; null ids count as larger than all others. Empty tables give empty
    results. Texts of any length are read whole, as UTF-8 bytes.
    """
    return _repeats(docs, [], length, gram, hot)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows of docs with all their columns, of whatever names and types, text without what repeats() removes, and n_chars, if there, to match.

    A null text becomes an empty one. Rows stay even where nothing is left of their texts.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = _repeats(docs, rest, length, gram, hot)
    of = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"_{k}") for k, c in enumerate(rest)}
    if "n_chars" in of:
        of["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*(of[c].alias(c) for c in docs.columns))


def _repeats(docs: DataFrame, carried: list[str], length: int, gram: int, hot: int) -> DataFrame:
    """repeats() with the carried columns as _0, _1, ... after its own."""
    n, fan = common.shards(docs), common.FAN
    slices, passes = min(n, SLICES), []  # passes are known when the anchors are counted
    cells = Cells(docs, n, carried)
    splitters = _splitters(cells, n, length, gram)
    copied = Written(copies(cells, length), "copies").read()

    def bucket(grams: np.ndarray) -> np.ndarray:
        return np.searchsorted(splitters, grams, side="right").astype(np.int32)

    def sent_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, docs_of, copies_of in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                cell = Cell(docs_of, _pairs(copies_of), length, gram)
                h, at = np.unique(cell.h, return_index=True)
                yield parcel_batch(parcels([bucket(cell.grams(at)), np.full(len(h), number, np.int32), h], n, fan))

    def shared(table: pa.Table) -> pa.Table:
        _, cell, h = together(table.column("blob").to_pylist())
        part = table.column("group")[0].as_py() * slices // n
        order = np.argsort(h, kind="stable")
        h, cell = h[order], cell[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.diff(np.r_[start, len(h)])
        often = np.repeat(many, many)
        keep = often > 1
        out = parcel_batch(parcels([cell[keep], h[keep], often[keep] > hot, np.full(int(keep.sum()), part, np.uint8)], n, fan))
        # a hot anchor's ten strings or so go singly
        sent = [int(keep.sum() + 9 * (often > hot).sum()) if k == 0 else 0 for k in range(len(out))]
        return pa.Table.from_arrays([*out.columns, pa.array([part] * len(out), pa.int32()), pa.array(sent, pa.int64())], SHARED_NAMES)

    def range_of(k: int) -> tuple[int, int]:
        """The buckets of pass k."""
        return tuple(-(-at * n // slices) for at in passes[k])

    def known(cell: Cell, answers: list[bytes] | None, k: int) -> Contexts:
        """The contexts of pass k."""
        h, spread = np.empty(0, np.uint64), np.empty(0, bool)
        if answers:
            _, h, spread, part = together(answers)
            own = (part >= passes[k][0]) & (part < passes[k][1])
            h, spread = h[own], spread[own]
        lo, hi = range_of(k)
        return cell.contexts(h, h[spread], (lambda grams: (bucket(grams) >= lo) & (bucket(grams) < hi)) if len(passes) > 1 else None)

    def sent_contexts(k: int) -> Callable:
        lo, hi = range_of(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, docs_of, copies_of, answers in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    c = known(Cell(docs_of, _pairs(copies_of), length, gram), answers, k)
                    if not len(c.begin):
                        continue
                    rows = c.rows()
                    to = bucket(_anchor_keys(rows, c.anchor, gram).view(f"S{gram}").ravel()) - lo
                    to = np.where(c.anchor < 0, row_hash(rows.view(np.uint64)) % np.uint64(hi - lo), to).astype(np.int32)
                    yield parcel_batch(parcels([to, np.full(len(to), number, np.int32), np.arange(len(to), dtype=np.int32), c.anchor, c.least, c.size, rows], hi - lo, fan, level=3))

        return run

    def judged(k: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            _, cell, number, anchor, ids, size, rows = together(table.column("blob").to_pylist())
            entry, start = _judge(rows, size, anchor, ids, length, gram)
            return pa.Table.from_batches([parcel_batch(parcels([cell[entry], np.full(len(entry), k, np.uint8), number[entry], start], n, fan))])

        return run

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs_of, copies_of, shared_of, answers in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                cell = Cell(docs_of, _pairs(copies_of), length, gram)
                marks = np.zeros(len(cell.data) + 1, np.int32)
                lost = together(answers)[1:] if answers else None
                for k in range(len(passes)):
                    c = known(cell, shared_of, k)
                    later = np.flatnonzero(c.id > c.least[c.number])
                    np.add.at(marks, c.at[later], 1)
                    np.add.at(marks, c.at[later] + c.size[c.number[later]], -1)
                    if lost:
                        number, start = (x[lost[0] == k] for x in lost[1:])
                        firsts = np.flatnonzero(c.id == c.least[c.number])
                        firsts = firsts[np.argsort(c.number[firsts], kind="stable")]
                        begin, end = np.searchsorted(c.number[firsts], number), np.searchsorted(c.number[firsts], number, side="right")
                        times = end - begin
                        place = firsts[np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                        start = np.repeat(start, times)
                        where = c.at[place] + np.maximum(start, 0)
                        np.add.at(marks, where, 1)
                        np.add.at(marks, where + np.where(start == WHOLE, c.size[c.number[place]], length), -1)
                gone = np.cumsum(marks) > 0
                rows = []
                for d, (i, text, at) in enumerate(zip(cell.ids, cell.texts, cell.begin.tolist(), strict=True)):
                    spans, kept, own = 0, text, gone[at : at + len(text)]
                    if d in cell.copies:
                        spans, kept = 1, b""
                    elif own.any():
                        spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0])
                        kept = np.frombuffer(text, np.uint8)[~own].tobytes()
                    rows.append((i, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
                if rows:
                    found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    rest = [x.combine_chunks() for x in cell.rest.columns] if carried else []
                    yield pa.RecordBatch.from_arrays(found + rest, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(f"_{k}" for k in range(len(carried)))]
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]
    own = [StructField(c, LongType()) for c in names[:4]] + [StructField(c, StringType()) for c in names[4:6]]
    schema = StructType(own + [StructField(f"_{k}", docs.schema[c].dataType) for k, c in enumerate(carried)])
    with_copies = cells.read().hint("merge").join(copied, "cell", "left")
    sent = exchange(with_copies.select("cell", "docs", "copies").mapInArrow(sent_anchors, PARCEL), n, fan)
    elsewhere = Written(sent.groupBy("group").applyInArrow(shared, f"{PARCEL}, part int, sent long"), "shared")
    common.release(docs.sparkSession)
    counts = {r.part: r.sent for r in elsewhere.read().groupBy("part").agg(F.sum("sent").alias("sent")).collect()}  # a row for each slice
    passes += _passes([CONTEXT * len(widths(n, fan)) * counts.get(k, 0) for k in range(slices)], PASS * cells.stored())
    removed = []
    for k, (a, b) in enumerate(passes):
        lo, hi = range_of(k)
        own = elsewhere.read().where(F.col("part").between(a, b - 1)).select("group", "blob")
        asked = cells.with_answers(exchange(own, n, fan)).join(copied, "cell", "left").select("cell", "docs", "copies", "answers0").mapInArrow(sent_contexts(k), PARCEL)
        removed.append(Written(exchange(asked, hi - lo, fan, level=3).groupBy("group").applyInArrow(judged(k), PARCEL), "removed"))
        common.release(docs.sparkSession)
    every = reduce(DataFrame.unionByName, [x.read() for x in removed])
    answers = cells.with_answers(exchange(elsewhere.read().select("group", "blob"), n, fan), exchange(every, n, fan))
    return answers.join(copied, "cell", "left").select("docs", "copies", "answers0", "answers1").mapInArrow(applied, schema)


def _passes(sizes: list[float], most: float) -> list[tuple[int, int]]:
    """Ranges of neighbouring slices, of at most so many bytes together; a slice that has more is a pass of its own."""
    cuts, held = [0], 0.0
    for k, x in enumerate(sizes):
        if held and held + x > most:
            cuts.append(k)
            held = 0.0
        held += x
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True))


def _pairs(copies_of: list | None) -> list:
    return [[(x["hash"], x["least"]) for x in copies_of]] if copies_of else []


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
