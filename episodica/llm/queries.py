"""The registered queries: the operators over whole tables, with the digest columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, fingerprints, hard_negatives, importance, licenses, near_dedup, oracle, quality, secret_scan, sentencepiece,
               sharding, substring_dedup, suffix_dedup, warc)
from .groups import kept
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_near_dedup", sql=oracle.NEAR_DEDUP)
def op1(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(docs)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_decontamination", sql=oracle.DECONTAMINATION)
def op3(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), benchmark)
    c = found["contamination"]
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
                        F.size(c["items"]).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
                        c["contaminated"].alias("contaminated"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece.round_trip(docs.select("doc_id", "text"))
    ids = coded["coded.piece_ids"]
    return coded.select("doc_id", F.size(ids).cast("bigint").alias("n_pieces"), F.sha2(F.array_join(ids, ","), 256).alias("pieces_sha256"),
                        (F.col("coded.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op7_secret_scan")
def op7(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(docs.select("doc_id", "text"))
    s = found["secrets"]
    return found.select("doc_id", *[s[f"n_{k}"].alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.span_list(s["base"]), 256).alias("base_sha256"),
                        secret_scan.span_list(s["spans"]).alias("spans"))


@query("op8_quality_rules")
def op8(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs.select("doc_id", "text")).select("doc_id", "quality.*")


@query("op9_substring_dedup", sql=oracle.SUBSTRING_DEDUP)
def op9(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op10_warc_archive", table="pages", sql=oracle.WARC_ARCHIVE)
def op10(spark: SparkSession, pages: DataFrame, sf_dir: str) -> DataFrame:
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_license_scan")
def op4(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(docs.select("doc_id", "text"))
    c = found["license"]
    return found.select("doc_id", *[c[n].alias(n) for n in ("n_words", "n_base", "first_word", "last_word")],
                        F.array_join(c["base_labels"], ",").alias("base_labels"),
                        F.array_join(c["labels"], ",").alias("labels"), c["score"].alias("score"))


@query("op5_sharding")
def op5(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = sharding.shuffled_shards(rows, "doc_id", 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op11_document_fingerprints")
def op11(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = fingerprints.with_next(fingerprints.with_sketch(texts), "doc_id", "text", ["sketch"])
    changed = paired.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch",
                            fingerprints.edited(F.col("text"), F.col("next_text")).alias("edited"))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprints.with_sketch(changed, "edited", "edited_sketch").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(other).alias("edited_fingerprint"), fingerprints.likeness(own, other).alias("near_edited"),
        fingerprints.likeness(own, following).alias("near_next"), fingerprints.containment(own, other).alias("held_by_edited"),
        fingerprints.containment(own, following).alias("held_by_next"))


@query("op12_hard_negatives", table="embeddings", sql=oracle.HARD_NEGATIVES)
def op12(spark: SparkSession, vectors: DataFrame, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = kept(hard_negatives.quantised(vectors.withColumn("label", moved)), "vectors")
    return hard_negatives.mine(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


@query("op13_importance_resampling", sql=oracle.IMPORTANCE)
def op13(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.weighted(docs.select("doc_id", "text"), target).select(
        "doc_id", "importance.n_features", "importance.weight", (F.col("importance.n_words") >= 20).alias("enough"))
    return importance.drawn(found, "doc_id", "weight", "enough", 10, 2024).select("doc_id", "n_features", "weight", "score", "rank")
