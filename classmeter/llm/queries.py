"""One query for each operator over its whole table, as the contracts state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from classmeter.llm import bpe, conversations, divergence, linededup, mixing, neardup, pii, quality, secrets, simhash, topk, toxicity, urlfilter
from classmeter.llm.common import held_out, saved, table

SEED = 7
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = saved(mixing.measured(table(spark, sf_dir, "documents"), SEED, "doc_id", "source"), "measured")
    mix = mixing.plan_mix(docs)
    out = mix.apply(docs).join(mix.side(mix.sources.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.ByteBpe(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    done = table(spark, sf_dir, "documents").select("doc_id", coder.round_trip(F.col("text")).alias("done"))
    return done.select(
        "doc_id",
        bpe.count(F.col("done.ids")).alias("n_tokens"),
        F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2("done.decoded", 256).alias("decoded_sha256"),
    )


def _judged(docs: DataFrame, score, least: float) -> DataFrame:
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, toxicity.score(model, F.col("text")), 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, quality.score(model, F.col("text")), 0.3)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "embeddings"), least=0.95)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256")
    return found.select("doc_id", "start", "length", digest, F.col("label"), "score", "predicted")


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit(rows, conversations.damaged(rows))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.as_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_source_mix,
        op2_byte_bpe,
        op3_toxicity,
        op4_quality,
        op5_top_k,
        op6_embedding_dedup,
        op7_simhash,
        op8_line_dedup,
        op9_secrets,
        op10_url_filter,
        op11_source_divergence,
        op12_conversation_repair,
        op13_personal_data,
    )
}
