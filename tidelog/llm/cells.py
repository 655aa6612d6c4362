"""Whole documents packed into cells, and packed columns dealt from cells to shards and back.

An operator that asks a distributed table about all documents' parts sends each
cell's distinct questions once and reads the answers beside the cell again: the cells are a
table bucketed by cell number, so that joining answers to them moves answers only.

A cell's questions are columns of equal length, the shard of each first. One exchange deals
them among FAN groups of shards at most; where there are more shards, tasks open what
came for a group, some cells' at a time, and deal it on among the group's parts. So an exchange has at most FAN rows
for each cell or OPEN bytes, whatever the number of shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.common import pack, unpack

PARCEL = "group int, blob binary"


def opened(blobs: list[bytes]) -> tuple[list, list[bytes], pa.Table | None]:
    """The ids, texts and carried columns of a cell, in the same order whenever it is read."""
    ids, texts, rest = [], [], []
    for x in sorted(blobs):
        more = unpack(x)
        ids += more[0]
        texts += more[1]
        if more[2]:
            rest.append(pa.ipc.open_stream(more[2]).read_all())
    return ids, texts, pa.concat_tables(rest) if rest else None


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Cells:
    """documents packed by a hash of id and text, in a table bucketed by cell. Carried columns may have any type."""

    def __init__(self, docs: DataFrame, n: int, carried: list[str] = ()):
        self.spark, self.name = docs.sparkSession, f"cells_{uuid.uuid4().hex}"
        self.path = f"{common.shared_dir(self.spark)}/{self.name}"
        common.made(self.path)
        names = [str(k) for k in range(len(carried))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, ids, found = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
                rest = pa.RecordBatch.from_arrays(b.columns[3:], names) if names else None
                order = np.argsort(cell, kind="stable")
                out = []
                for s, at in common.by_shard(cell[order], n):
                    own = order[at]
                    out.append((s, pack([ids[k] for k in own], [found[k] for k in own], _stream(rest.take(pa.array(own))) if names else b"", level=3)))
                if out:
                    yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["cell", "blob"])

        text = F.coalesce("text", F.lit("")).cast("binary")
        cell = F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("cell")
        packed = docs.select(cell, F.col("doc_id").alias("id"), text.alias("text"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carried))).mapInArrow(run, "cell int, blob binary")
        whole = packed.groupBy("cell").agg(F.collect_list("blob").alias("docs"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        whole.write.bucketBy(buckets, "cell").option("path", self.path).option("compression", "none").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        self.spark.sql(f"DROP TABLE {self.name}")  # the files stay where the result reads them; the name has done its work
        common.release(self.spark)

    def read(self) -> DataFrame:
        return self.table

    def stored(self) -> int:
        """Bytes of the table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """Cells with a list of what came for each from every one of answers (cell or group, blob)."""
        out = self.read().hint("merge")
        for k, a in enumerate(answers):
            a = a.toDF("cell", "blob")
            out = out.join(a.groupBy("cell").agg(F.collect_list("blob").alias(f"answers{k}")), "cell", "left")
        return out


def _coded(column: np.ndarray) -> np.ndarray:
    """Unsigned longs as byte planes of their differences, modulo 2**64: what rises or repeats leaves planes of zeros."""
    if column.dtype != np.uint64 or column.ndim > 1:
        return column
    return np.ascontiguousarray(np.diff(column, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _decoded(column: np.ndarray, coded: bool) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(column.T).view(np.uint64).ravel(), dtype=np.uint64) if coded else column


def packed_columns(columns: list[np.ndarray], level: int = 1) -> bytes:
    return pack([c.dtype == np.uint64 and c.ndim == 1 for c in columns], *map(_coded, columns), level=level)


def unpacked_columns(blob: bytes) -> list[np.ndarray]:
    coded, *columns = unpack(blob)
    return [_decoded(c, x) for c, x in zip(columns, coded, strict=True)]


def together(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of several blobs, one after the other."""
    return [np.concatenate(c) for c in zip(*map(unpacked_columns, blobs), strict=True)]


def widths(n: int, fan: int) -> list[int]:
    """How many shards a group has after each exchange; one after the last."""
    out = [1]
    while out[0] * fan < n:
        out.insert(0, out[0] * fan)
    return out


def parcels(columns: list[np.ndarray], n: int, fan: int | None = None, level: int = 1, width: int | None = None) -> list[tuple[int, bytes]]:
    """(group, blob) of columns of equal length, the first of them the shard; entries of a shard keep their order."""
    width = width or widths(n, fan or common.FAN)[0]
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    group = columns[0] // width
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.empty(0, np.int64)
    return [(int(group[a]), packed_columns([c[a:b] for c in columns], level)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def parcel_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["group", "blob"])


def exchange(sent: DataFrame, n: int, fan: int | None = None, level: int = 1) -> DataFrame:
    """Parcels (group, blob) dealt on until group is the shard. sent has the parcels that parcels() gives with the same n and fan."""
    fan = fan or common.FAN
    partitions = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for width in widths(n, fan)[1:]:

        def run(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            held, group, size = [], None, 0
            for b in batches:
                for g, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if held and (g != group or size > common.OPEN):
                        yield parcel_batch(parcels(together(held), n, fan, level, width))
                        held, size = [], 0
                    held.append(blob)
                    group, size = g, size + len(blob)
            if held:
                yield parcel_batch(parcels(together(held), n, fan, level, width))

        salted = sent.repartition(partitions, "group", F.pmod(F.xxhash64("blob"), F.lit(max(1, partitions // fan))))
        sent = salted.sortWithinPartitions("group").mapInArrow(run, PARCEL)
    return sent
