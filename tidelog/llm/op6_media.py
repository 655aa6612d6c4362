"""Media columns over a store of content-defined chunks.

The media form of a payload is a WAVE file of 8-bit samples. It is cut, header and all, where a rolling gear hash of its last 32 bytes has its top bits clear,
so an edit moves only the cuts near it. Chunks are named by their SHA-256 digest, and a
digest exchange keeps one compressed copy of each in the chunk store, a table bucketed
by digest. A manifest is the ordered list of a file's digests, kept once for each distinct
file. Reading back joins manifests with the store, puts the chunks in order, checks the
file's digest and only then takes the payload and its features from the stored bytes.

Chunks move twice (into the store, out to their files), compressed both times; the
bucketed store spares the join an exchange. Files that repeat are read back once. A chunk of more than HOT
files is joined under several salted keys, with as many copies of it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

PADDING = 64
SAMPLE_RATE = 8000
#: Chunk sizes in bytes: cuts are looked for beyond LEAST, one in 2**AVERAGE_BITS bytes is one, MOST forces one.
LEAST, AVERAGE_BITS, MOST = 1024, 12, 16384
#: Compression: level, and chunks from which the dictionary is made (its only input; results don't depend on it).
LEVEL, SAMPLE, DICTIONARY = 15, 2048, 112_640
#: Distinct files that have a chunk under one key of the join.
HOT = 1 << 16
HEADER = 44
_GEAR = np.random.default_rng(0x6EA5).integers(0, 1 << 32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << AVERAGE_BITS) - 1) << (32 - AVERAGE_BITS))


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of PADDING."""
    return data.ljust(max(PADDING, -(-len(data) // PADDING) * PADDING), b"\0")


def wave_header(n: int) -> bytes:
    """The 44 bytes before n 8-bit mono samples in a WAVE file."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def wave(payload: bytes) -> bytes:
    """The media form: a WAVE file whose samples are the payload's bytes."""
    return wave_header(len(payload)) + payload


def cuts(payload: bytes) -> list[int]:
    """The ends of the payload's chunks."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted gear values: the rolling hash at every byte
        h[shift:] += h[:-shift] << np.uint32(shift)
    ends, start = [], 0
    for end in (np.flatnonzero((h & _MASK) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST and end < n:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n]


def chunks(payload: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(payload):
        yield payload[start:end]
        start = end


def features(payload: bytes) -> str:
    """Mean, root mean square about it, zero crossings and a histogram of the samples in 16 bins."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    above = x >= mean
    bins = np.bincount(x >> 4, minlength=16)
    return f"mean={mean:.4f};rms={x.std():.4f};crossings={np.count_nonzero(above[1:] != above[:-1])};bins={','.join(map(str, bins))}"


class ChunkStore:
    """Chunks by digest, each stored once, in files of the shared folder bucketed by digest."""

    def __init__(self, chunk_rows: DataFrame):
        self.spark = chunk_rows.sparkSession
        self.name = f"chunks_{uuid.uuid4().hex}"
        self.path = f"{common.shared_dir(self.spark)}/{self.name}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        once = chunk_rows.groupBy("digest").agg(F.first("data").alias("data"))
        once.write.bucketBy(n, "digest").option("path", self.path).option("compression", "none").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, content (SHA-256 of the media form), n_bytes and the ordered chunk digests of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in common.chunks(batches, 4 << 20):
            files = [wave(padded(t)) for t in found]
            digests = [[hashlib.sha256(c).digest() for c in chunks(f)] for f in files]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([hashlib.sha256(f).digest() for f in files], pa.binary()), pa.array(map(len, found), pa.int64()), pa.array(digests, pa.list_(pa.binary()))],
                ["doc_id", "content", "n_bytes", "digests"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id long, content binary, n_bytes long, digests array<binary>")


def dictionary(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A compression dictionary from at most sample chunks of sampled documents; empty where they are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in common.chunks(batches, 4 << 20):
            yield pa.record_batch([pa.array([c for t in found for c in chunks(wave(padded(t)))], pa.binary())], ["chunk"])

    some = docs.sample(min(1.0, sample / max(1, docs.count())), seed=6)
    found = [bytes(r.chunk) for r in common.texts(some).mapInArrow(run, "chunk binary").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:
        return b""


def chunk_rows(docs: DataFrame, common_parts: bytes = b"") -> DataFrame:
    """digest and data, compressed with a dictionary, of the chunks, once for each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes of each digest; cleared at a million, as the store drops repeats anyway
        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(common_parts)).compress
        for _, found in common.chunks(batches, 4 << 20):
            digests, data = [], []
            for c in (c for t in found for c in chunks(wave(padded(t)))):
                d = hashlib.sha256(c).digest()
                if d[:16] not in seen:
                    seen.add(d[:16])
                    digests.append(d)
                    data.append(compress(c))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return common.texts(docs).mapInArrow(run, "digest binary, data binary")


def _with_data(parts: DataFrame, store: ChunkStore, hot: int) -> DataFrame:
    """parts (content, pos, digest) with data. Digests of more than hot parts are joined under salted keys, so that no task gets all of one."""
    often = common.Written(parts.groupBy("digest").count().where(F.col("count") > hot).select("digest", F.ceil(F.col("count") / hot).cast("int").alias("salts")), "hot").read()
    if often.isEmpty():
        return parts.join(store.read().hint("merge"), "digest").select("content", "pos", "data")
    plain = parts.join(often, "digest", "left_anti").join(store.read().hint("merge"), "digest").select("content", "pos", "data")
    salted = parts.join(often, "digest").withColumn("salt", F.pmod(F.xxhash64("content", "pos"), F.col("salts")).cast("int"))
    copies = store.read().join(often, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return plain.unionByName(salted.join(copies, ["digest", "salt"]).select("content", "pos", "data"))


def read_back(store: ChunkStore, found: DataFrame, common_parts: bytes = b"", hot: int = HOT, whole: bool = False) -> DataFrame:
    """What the stored bytes of each distinct file say: content, payload and media columns, feature, and with whole the bytes themselves (media).

    Raises if a file does not have the digest it was stored under.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common_parts)).decompress
        for b in batches:
            rows = []
            for content, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                media = b"".join(expand(p["data"]) for p in sorted(parts, key=lambda p: p["pos"]))
                digest = hashlib.sha256(media)
                if digest.digest() != content:
                    raise ValueError(f"stored file {content.hex()} reads back as {digest.hexdigest()}")
                payload = media[HEADER:]
                rows.append((content, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), digest.hexdigest(), features(payload), *([media] if whole else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * whole
    names = ["content", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * whole
    once = found.groupBy("content").agg(F.first("digests").alias("digests"))
    parts = _with_data(once.select("content", F.posexplode("digests").alias("pos", "digest")), store, hot)
    ordered = parts.groupBy("content").agg(F.collect_list(F.struct("pos", "data")).alias("parts"))
    return ordered.mapInArrow(run, "content binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * whole)


@dataclass
class MediaTable:
    """Documents stored as media files: one manifest for each row, and the chunks that they share."""

    store: ChunkStore
    manifests: DataFrame
    common_parts: bytes

    def columns(self, hot: int = HOT) -> DataFrame:
        """What the stored bytes say, for every row: media_columns()."""
        read = common.Written(read_back(self.store, self.manifests, self.common_parts, hot), "media").read()
        out = self.manifests.select("doc_id", "content", "n_bytes").join(read, "content")
        return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def media(self, hot: int = HOT) -> DataFrame:
        """doc_id and media, the stored file's bytes, of every row."""
        return self.manifests.select("doc_id", "content").join(read_back(self.store, self.manifests, self.common_parts, hot, whole=True), "content").select("doc_id", "media")

    def drop(self) -> None:
        self.store.drop()


def stored(docs: DataFrame) -> MediaTable:
    """Stores every text's media form in the shared folder. Cases are those of media_columns()."""
    common_parts = dictionary(docs)
    store = ChunkStore(chunk_rows(docs, common_parts))
    common.release(docs.sparkSession)
    return MediaTable(store, common.Written(manifests(docs), "manifests").read(), common_parts)


def media_columns(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Stores every text as a file of 8-bit samples, reads it back, and returns what the stored bytes say.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; one row for each row of docs. Needs columns doc_id (bigint) and text;
    others are ignored. A null or empty text is a payload of 64 zero bytes. Null ids and repeated
    rows keep their rows; equal texts have equal values. Empty tables give empty results. The chunks are dropped once
    all are read back; stored() keeps them.
    """
    table = stored(docs)
    out = table.columns(hot)
    table.drop()
    common.release(docs.sparkSession)
    return out


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
