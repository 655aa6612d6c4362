"""Binary write-ahead logs: framing, batches, and a Spark source over files of them.

A log is a row of 32 KiB blocks of fragments: checksum of type and payload (4 bytes), length (2),
type (1), payload. A record is one FULL fragment or FIRST, MIDDLE ..., LAST. Damage is the
torn end of a crash if no valid fragment follows it in the newest log, and corruption anywhere else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
BLOCK = 32_768
HEADER = 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
SET, DELETE = 0, 1
CASTAGNOLI = 0x82F63B78  # reflected


class Corruption(ValueError):
    pass


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def put_uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def uvarint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it. Numbers that are too long or not minimal are corruption."""
    n = 0
    for k in range(10):
        if at + k >= len(data):
            raise Corruption("number runs past the end")
        b = data[at + k]
        n |= (b & 127) << 7 * k
        if b < 128:
            if k and not b:
                raise Corruption("number is not minimal")
            return n, at + k + 1
    raise Corruption("number is too long")


def encode_batch(seq: int, records: list[tuple[int, bytes, bytes | None]]) -> bytes:
    out = [struct.pack("<QI", seq, len(records))]
    for kind, key, value in records:
        out += [bytes([kind]), put_uvarint(len(key)), key]
        if kind == SET:
            out += [put_uvarint(len(value or b"")), value or b""]
    return b"".join(out)


def decode_batch(payload: bytes) -> list[tuple[bytes, int, bool, bytes | None]]:
    """(key, seq, tombstone, value) of each record."""

    def piece(at: int) -> tuple[bytes, int]:
        n, at = uvarint(payload, at)
        if at + n > len(payload):
            raise Corruption("record runs past the end")
        return payload[at : at + n], at + n

    if len(payload) < 12:
        raise Corruption("batch is too short")
    (seq, count), at, out = struct.unpack_from("<QI", payload), 12, []
    for i in range(count):
        if at >= len(payload) or payload[at] > DELETE:
            raise Corruption("no record where one is due")
        kind = payload[at]
        key, at = piece(at + 1)
        value = None
        if kind == SET:
            value, at = piece(at)
        out.append((key, seq + i, kind == DELETE, value))
    if at != len(payload):
        raise Corruption("bytes after the last record")
    return out


def frame(records: list[bytes], begin: int = 0) -> bytes:
    """The bytes of records that follow begin bytes of a log."""
    out = bytearray()
    for record in records:
        rest, first = record, True
        while first or rest:
            room = BLOCK - (begin + len(out)) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part, rest = rest[: room - HEADER], rest[room - HEADER :]
            kind = (FULL if not rest else FIRST) if first else (MIDDLE if rest else LAST)
            body = bytes([kind]) + part
            out += struct.pack("<IH", crc32c(body), len(part)) + body
            first = False
    return bytes(out)


def _fragment(data: bytes, at: int) -> tuple[int, bytes, int] | None:
    """Type, payload and end of the fragment at a place, or None where there is no valid one."""
    end = min(len(data), at - at % BLOCK + BLOCK)
    if at + HEADER > end:
        return None
    crc, n, kind = struct.unpack_from("<IHB", data, at)
    stop = at + HEADER + n
    if not FULL <= kind <= LAST or stop > end or crc32c(data[at + 6 : stop]) != crc:
        return None
    return kind, data[at + HEADER : stop], stop


def _valid_after(data: bytes, at: int) -> bool:
    """Whether any valid fragment starts after a place: in its block by chained lengths, or at any block's start."""
    step = at
    while len(data) - step >= HEADER and BLOCK - step % BLOCK >= HEADER:
        n = struct.unpack_from("<H", data, step + 4)[0]
        nxt = step + HEADER + n
        if nxt // BLOCK != at // BLOCK or nxt >= len(data):
            break
        if _fragment(data, nxt):
            return True
        step = nxt
    return any(_fragment(data, b) for b in range(at - at % BLOCK + BLOCK, len(data), BLOCK))


def records(data: bytes, newest: bool = True) -> Iterator[bytes]:
    """The records of a log up to its clean end."""
    at, held = 0, None
    while at < len(data):
        if BLOCK - at % BLOCK < HEADER:
            at += BLOCK - at % BLOCK
            continue
        got = _fragment(data, at)
        if got is None:
            whole_header = len(data) - at >= HEADER
            kind = data[at + 6] if whole_header else FULL
            ok_crc = whole_header and crc32c(data[at + 6 : at + HEADER + struct.unpack_from("<H", data, at + 4)[0]]) == struct.unpack_from("<I", data, at)[0]
            if not newest or _valid_after(data, at) or (ok_crc and not FULL <= kind <= LAST):
                raise Corruption(f"damage at byte {at}")
            return
        kind, part, at = got
        if (kind in (FULL, FIRST)) != (held is None):
            raise Corruption("fragments out of order")
        held = part if held is None else held + part
        if kind in (FULL, LAST):
            yield held
            held = None
    if held is not None and not newest:
        raise Corruption("record is cut off")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The mutations of all .wal files of a folder, a log a row at a time; only the highest-numbered may end torn. Empty files count as absent."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    numbered = files.select(F.regexp_extract("path", "([0-9]+)\\.wal$", 1).cast("long").alias("number"), "content")
    last = numbered.agg(F.max("number").alias("last"))
    rows = numbered.join(F.broadcast(last), F.lit(True))  # one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, content, newest in zip(b["number"], b["content"], b["last"], strict=True):
                found = [r for payload in records(content, number == newest) for r in decode_batch(payload)]
                yield pd.DataFrame(found, columns=["key", "seq", "tombstone", "value"])

    return rows.mapInPandas(run, "key binary, seq long, tombstone boolean, value binary")


def write(entries: DataFrame, path: str) -> None:
    """entries as write-ahead logs under path, one NNNNNN.wal for each file_number; a run of sequences is a batch.

    A task streams its files' entries in sequence order and writes a file when its last entry has passed, under
    its final name in one rename, so a task that runs again replaces what it wrote.
    """
    from itertools import groupby
    from operator import itemgetter

    from pyspark.sql.types import BinaryType

    as_binary = lambda c: F.col(c) if isinstance(entries.schema[c].dataType, BinaryType) else F.col(c).cast("binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        system, at = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
        system.create_dir(at)
        rows = (r for b in batches for r in zip(b["file_number"], b["seq"], b["key"], b["tombstone"], b["value"], strict=True))
        for number, own in groupby(rows, itemgetter(0)):
            name = f"{at}/{number:06d}"
            with system.open_output_stream(f"{name}.tmp") as out:
                size, batch, first = 0, [], None
                for _, seq, key, dead, value in [*own, (None,) * 5]:
                    if batch and (seq is None or seq != first + len(batch) or len(batch) == 64):
                        data = frame([encode_batch(first, batch)], size)
                        out.write(data)
                        size, batch = size + len(data), []
                    if seq is not None:
                        if not batch:
                            first = seq
                        batch.append((DELETE if dead else SET, bytes(key), b"" if dead else bytes(value)))
            system.move(f"{name}.tmp", f"{name}.wal")
            yield pd.DataFrame({"number": [number]})

    rows = entries.select("file_number", "seq", as_binary("key").alias("key"), "tombstone", as_binary("value").alias("value"))
    rows.repartition("file_number").sortWithinPartitions("file_number", "seq").mapInPandas(run, "number long").write.format("noop").mode("overwrite").save()
