"""From documents to token ids: quality, line dedup, near-dedup, source mix, byte-level BPE.

Each stage takes what its predecessor kept; `run` writes it to the shared
folder in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from classmeter.llm import bpe, linededup, mixing, quality, simhash
from classmeter.llm.common import saved, table
from classmeter.llm.queries import RANKS, SEED

# SQL cannot express the classifier, the hashes and the merges.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= 0.3)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 of them share; n_chars follows the text."""
    cut = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs, words=3, max_bits=2)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three times."""
    narrow = saved(mixing.measured(docs, SEED), "measured")
    mix = mixing.plan_mix(narrow)
    taken = mix.apply(mixing.measured(docs, SEED, F.struct("*").alias("row")))
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    return taken.select("row", F.explode(times).alias("time")).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document (packed, four bytes each), and the digests of ids and decoded bytes."""
    # Workers of the earlier stages are still there, so this one makes do with less memory.
    coder = bpe.ByteBpe(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, chunk=600_000)
    done = docs.select("doc_id", "source", coder.round_trip(F.col("text")).alias("done"))
    return done.select(
        "doc_id",
        "source",
        bpe.count(F.col("done.ids")).alias("n_tokens"),
        "done.ids",
        F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2("done.decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_common_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
