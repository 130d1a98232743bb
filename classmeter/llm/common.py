"""What the operators of this package share: reading, folds, tables kept for a later step."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from classmeter.session import shared_folder

# Fixed by the contracts: what separates words, and a word.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """`df`, written once to the shared folder and read back with its schema.

    Later steps then read the table instead of computing `df` again, also
    after an executor is lost, and Spark knows its size.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library

    def _trim(keep: int) -> int:
        return 0


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on between stages, and what they keep counts there."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def each(batches: Iterator) -> Iterator:
    """The batches one by one; memory that the last one took is handed back."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is in the fold that no model learns from; a null id is in it."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text) % folds == 0
