"""The corpus pipeline: five operators, each working on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import op5_mixing, op7_quality, op8_suffix_dedup, op9_packing, op10_simhash
from tidelog.llm.common import Written, folders, release, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines."""
    return op7_quality.cleaned(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Rows of a repeated or null id stay if they are in no group."""
    return op10_simhash.survivors(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that a document with a smaller id has too."""
    return op8_suffix_dedup.deduplicated(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's words as often as the target weights take them."""
    return op5_mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return op9_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_to_weights", mix_to_weights),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither a fingerprint's hashes nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written to the shared folder and read again, and then the tables that its stage has read go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    written = None
    for name, stage in before:
        with folders() as made:
            new = Written(stage(spark, docs, sf_dir), name)
        for path in made:
            if path != new.path:
                remove(spark, path)
        if written:
            written.drop()
        written, docs = new, new.read()
        release(spark)
    return last(spark, docs, sf_dir)
