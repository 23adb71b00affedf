"""The registered queries of this folder: each operator on its whole table, with production settings."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import (
    byte_bpe,
    conversation_repair,
    decontaminate,
    licenses,
    line_quality,
    merkle,
    perspectives,
    pii,
    quality_pu,
    secret_scan,
    simhash,
    suffix_dedup,
    token_files,
)
from spendframe.llm.base import table


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder, manifest)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))

    def listed(column: str):
        each = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(each, ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks=ranks, pattern=public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(coded, ranks=ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return seats.withColumn("mask", F.array_join(spans, ","))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    claim = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang")], F.try_add("n_chars", F.lit(1)), F.col("text"))
    rows = merkle.manifest(docs, extra={"claim": F.when(tampered, claim)})
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(convs: DataFrame) -> DataFrame:
    """The conversations with the faults that op12 is to find: rows dropped, emptied, cut short, repeated, given to the user."""
    rows = convs.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("_case", F.pmod(F.crc32(key), F.lit(20))).where("_case <> 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("_case") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    counted = conversation_repair.account(conversation_repair.repair(damaged(convs))).withColumnRenamed("conv_id", "_conv")
    every = convs.select("conv_id").distinct().join(counted, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.na.fill(0, counts).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secret_scan.PATTERNS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


REGISTRY = {f.__name__: f for f in (
    op1_byte_bpe, op2_simhash, op3_suffix_dedup, op4_quality_pu, op5_token_files, op6_pii, op7_decontaminate, op8_line_quality, op9_license_scan, op10_perspectives,
    op11_merkle, op12_conversation_repair, op13_secret_scan
)}
