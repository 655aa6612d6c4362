"""The edit log as Parquet. An edit is atomic: all rows of one edit_id are written by one job, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.model import EDITS


def append(edits: DataFrame, path: str) -> None:
    edits.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    return spark.read.schema(EDITS if binary else EDITS.replace("binary", "string")).parquet(path)


def current(edits: DataFrame) -> int | None:
    """The edit that the current version ends with."""
    return edits.agg(F.max("edit_id")).first()[0]


def as_of(edits: DataFrame, edit_id: int) -> DataFrame:
    """The log up to an edit: any past version."""
    return edits.where(F.col("edit_id") <= edit_id)
