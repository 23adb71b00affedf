"""A training corpus from raw documents, stage by stage.

Each stage is one operator's decision on all that its predecessor kept; its output is written as
Parquet and read again as the next stage's input, so a lost executor never repeats earlier stages.
All stages but the last return the columns of their input.  Null texts have no words and go in the
first stage.  Documents are known by ``doc_id``: rows that share one share its fate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import byte_bpe, decontaminate, line_quality, pii, simhash
from spendframe.llm.base import keep_ids, shared_folder, table

#: Several stages keep state no SQL expresses (fingerprint components, edit distances, a trained tagger).
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's boilerplate; of rows that share an id, all
    if one is kept.  ``n_chars`` follows the text."""
    common = line_quality.boilerplate(docs)
    kept = line_quality.judge(docs, common=common).where("kept").select("doc_id").distinct()
    cleaned = line_quality.without_lines(keep_ids(docs, kept, "doc_id"), common)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of linked fingerprints: three-word shingles, two bits."""
    labelled = simhash.near_duplicates(docs, shingle=3, radius=2)
    first = labelled.where("doc_id <=> component_id").select("doc_id").distinct()
    return keep_ids(docs, first, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaking = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return keep_ids(docs, leaking, "doc_id", drop=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.mask(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded``, the text that the ids stand for."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, ranks=ranks, pattern=public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(coded, ranks=ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the folder that all executors share."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
