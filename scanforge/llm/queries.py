"""The registered queries of the training-data operators: thin callers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, decontaminate, divergence, embed_dedup, html_extract, license_scan, line_dedup, lm_score, mixing, secret_scan, simhash, spelling, toxicity
from .common import table


def _sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha256("text").alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, _sha256(secret_scan.as_text(F.col("base"))).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.is_fold(F.col("doc_id"), 1, 5)
    out = lm_score.score(docs, ~held_out).withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.is_fold(F.col("doc_id"), 2, 4).alias("held_out"), "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"  # its text holds every control string
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    tokenizer = chat_format.read_tokenizer(spark)
    return chat_format.read_back(chat_format.format_chats(turns, tokenizer), tokenizer)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_html_extraction": op1_html_extraction, "op2_line_dedup": op2_line_dedup, "op3_simhash": op3_simhash, "op4_secret_scan": op4_secret_scan, "op5_decontamination": op5_decontamination, "op6_lm_scoring": op6_lm_scoring, "op7_toxicity": op7_toxicity, "op8_chat_formatting": op8_chat_formatting, "op9_mixing": op9_mixing, "op10_embedding_dedup": op10_embedding_dedup, "op11_divergence_audit": op11_divergence_audit, "op12_spelling_groups": op12_spelling_groups, "op13_license_scan": op13_license_scan, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_line_dedup": line_dedup.LINES_SQL.format(docs="documents"), "op5_decontamination": decontaminate.CONTAINMENT_SQL, "op8_chat_formatting": chat_format.CHAT_SQL, "op9_mixing": mixing.MIX_SQL.format(docs="documents"), "op11_divergence_audit": divergence.AUDIT_SQL, "op12_spelling_groups": spelling.GROUP_SQL, "op13_license_scan": license_scan.scan_sql()}
