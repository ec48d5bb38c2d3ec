"""The operators' queries over the bundled tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, fingerprints, jaccard_join, language_id, manifest, mixing, repeats, secrets, sentences, suffix_dedup, toxicity
from .tables import load


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(load(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(load(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(load(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(repeats.dedup(load(spark, sf_dir, "documents"), repeats.LINE_WINDOWS), "n_lines")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(sentences.dedup(load(spark, sf_dir, "documents").select("doc_id", "text")), "n_sentences")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(load(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(chat.PROBE, "conv_id bigint, turn bigint, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(rows.unionByName(probe)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.manifest(manifest.tampered(load(spark, sf_dir, "documents")))
    out = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"), manifest.folded(F.coalesce("changed", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _digest(rows: DataFrame, pieces: str) -> DataFrame:
    kept = F.sha2(F.coalesce("_gs_kept", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", F.col("_gs_pieces").alias(pieces), F.col("_gs_removed").alias("n_removed"), kept.alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_document_fingerprints": fingerprints.SQL,
        "op3_benchmark_decontamination": decontaminate.SQL,
        "op5_source_mixing": mixing.SQL,
        "op6_line_dedup": repeats.LINE_SQL,
        "op12_chat_formatting": chat.SQL,
        "op13_merkle_manifest": manifest.SQL,
    }
