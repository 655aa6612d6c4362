"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's profile bundles (adds)
the vectors of its n-grams; a language's prototype bundles the profiles of its
training texts. A text gets the language whose prototype has the largest cosine with
its profile.

Profiles are linear in n-gram counts, so training only counts n-grams for each language,
map-side, and sends one vector for each task and language; the driver sees
languages x dimensions numbers whatever the corpus. Prediction is map-only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

#: A multiple of 64.
DIMENSIONS = 1024
#: Letters of an n-gram, 3 at most: a code has 21 bits for each.
N = 3
SEED = 20_240_601
#: Texts whose profiles are computed by one matrix product.
BLOCK = 64
#: n-grams that training counts before it bundles them, and letter vectors that a worker keeps; results don't depend on either.
PENDING, LETTERS = 1 << 21, 1 << 14
BITS, MASK = 21, (1 << 21) - 1

_models: dict[tuple[int, int], Profiles] = {}


def _letters() -> np.ndarray:
    """The lower-case code point of every letter, 0 of what is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


class Profiles:
    """n-gram codes of texts, and the vectors that these codes stand for."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N):
        self.n, self.dimensions = n, dimensions
        self.lower = _letters()
        self._clear()

    def _clear(self) -> None:
        self.row = np.full(0x110000, -1, np.int32)  # of a letter in places
        self.places = [np.empty((0, self.dimensions), np.int8)] * self.n

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The vector of each code point (0: the gap between words), a function of nothing else."""
        words = np.arange(self.dimensions // 64, dtype=np.uint64) + np.uint64(SEED << 8)
        bits = common.mix(common.mix(words) ^ common.mix(points.astype(np.uint64) + np.uint64(1))[:, None])
        return (np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(points), self.dimensions)

    def codes(self, text: str) -> np.ndarray:
        """The n-gram codes of a text: letters, with one gap between words and at both ends."""
        letters = self.lower[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        gap = letters == 0
        letters = np.r_[np.uint32(0), letters[~gap | np.r_[False, ~gap[:-1]]], np.uint32(0)].astype(np.int64)
        if not letters.any():
            return np.empty(0, np.int64)
        codes = letters[: len(letters) - self.n + 1]
        for k in range(1, self.n):
            codes = codes << BITS | letters[k : len(letters) - self.n + 1 + k]
        return codes

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vector of each code, of 4096 distinct codes or so at a time."""
        points = [codes >> BITS * (self.n - 1 - place) & MASK for place in range(self.n)]
        new = np.unique(np.concatenate([p[self.row[p] < 0] for p in points]))
        if len(new):
            if len(new) + len(self.places[0]) > LETTERS:
                self._clear()
                new = np.unique(np.concatenate(points))
            self.row[new] = np.arange(len(new)) + len(self.places[0])
            made = self.letters(new)
            self.places = [np.concatenate([rows, np.roll(made, place, axis=1)]) for place, rows in enumerate(self.places)]
        out = self.places[0][self.row[points[0]]]
        for place in range(1, self.n):
            out *= self.places[place][self.row[points[place]]]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of counts x vectors, exact below 2**53."""
        total = np.zeros(self.dimensions)
        for k in range(0, len(codes), 4096):
            total += counts[k : k + 4096] @ self.vectors(codes[k : k + 4096]).astype(np.float64)
        return total

    def bundles(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The profile of each text, given its distinct codes and their counts."""
        every = np.unique(np.concatenate([c for c, _ in counted]))
        out = np.zeros((len(counted), self.dimensions), np.float32)
        for k in range(0, len(every), 4096):
            some = every[k : k + 4096]
            weights = np.zeros((len(counted), len(some)), np.float32)
            for i, (codes, n) in enumerate(counted):
                part = slice(*np.searchsorted(codes, (some[0], some[-1] + 1)))
                weights[i, np.searchsorted(some, codes[part])] = n[part]
            out += weights @ self.vectors(some).astype(np.float32)
        return out


def profiles(dimensions: int, n: int) -> Profiles:
    return _models.get((dimensions, n)) or _models.setdefault((dimensions, n), Profiles(dimensions, n))


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, dimensions: int = DIMENSIONS, n: int = N) -> dict[str, np.ndarray]:
    """The prototype of each language in docs (columns text, lang); rows without text or lang teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, totals, pending, held = profiles(dimensions, n), {}, {}, 0

        def bundled() -> None:
            for lang, parts in pending.items():
                totals[lang] = totals.get(lang, 0) + model.bundle(*np.unique(np.concatenate(parts), return_counts=True))
            pending.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = model.codes(text)
                pending.setdefault(lang, []).append(codes)
                held += len(codes)
                if held > PENDING:
                    bundled()
                    held = 0
        bundled()
        for lang, total in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return {r.lang: np.array([x for _, x in r.xs]) for r in sums.collect()}  # languages x dimensions


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, n: int = N) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of every row of docs; score ties go to the first language by name.

    Needs columns doc_id and text; others are ignored. A null text or one without a letter
    gets `und` with score 0, as does every text if there are no prototypes. Repeated rows and
    null ids each get their row; empty tables give empty results; texts are read whole.
    """
    langs = sorted(prototypes)
    unit = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in langs]).reshape(len(langs), dimensions).T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = profiles(dimensions, n)
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            counted, at = [], []

            def judge() -> None:
                if not counted or not langs:
                    return
                found = model.bundles(counted)
                cosines = found @ unit / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(1)
                for k, i in enumerate(at):
                    pred[i], score[i] = langs[best[k]], min(1.0, max(0.0, float(cosines[k, best[k]])))

            for i, text in enumerate(texts):
                codes = model.codes(text or "")
                if len(codes):
                    counted.append(np.unique(codes, return_counts=True))
                    at.append(i)
                if len(counted) == BLOCK:
                    judge()
                    counted, at = [], []
            judge()
            yield pa.record_batch([b.column(0), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = predict(docs, train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
