"""The corpus pipeline: reject, deduplicate, cut repeats, decontaminate, mix.

Each stage is (spark, docs, sf_dir) -> DataFrame, works on all rows its predecessor kept, and all
but the last return the columns of ``documents``. Near-dedup and decontamination decide by row, under
a key of their own: rows that share a doc_id, or have none, don't fall or stay together. Of rows
with equal doc_id and text one stays.

Every stage takes null, empty and very long texts, nulls in any column, repeated rows, empty tables and extra columns,
whatever their names (but ``_row``, which is a key of the stages' own); the operators' docstrings say what each gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import decontamination, quality_classifier, queries, simhash, source_mix, suffix_dedup
from vicinity.llm.shared import cut, ensure_checkpoint_dir, small

IDS_TO_BROADCAST = 2_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_row``, written, so that every later reader sees the same keys."""
    ensure_checkpoint_dir(docs.sparkSession)
    folder = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4()}"
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with distinct rows."""
    return docs.join(small(rows.select("_row").distinct(), IDS_TO_BROADCAST), "_row", how).drop("_row")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Each row is judged by its own text; rows with equal texts fall or stay alike."""
    return quality_classifier.keep_good(docs, queries.quality_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id; one without a doc_id only if none has one. Ties go by text, then
    row. Null and empty texts are one group."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    ranked = keyed.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), "_row").alias("rank"))
    first = cut(found.join(ranked, "_row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank._row"))
    return _by_row(keyed, first, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes that a document with a smaller doc_id already has; n_chars follows. Rows with one doc_id, or none, keep what they
    share; null texts come out empty."""
    left = suffix_dedup.kept_texts(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a benchmark item has leaked into. Null and empty texts stay."""
    keyed = _keyed(docs)
    leaked = cut(decontamination.leaks(keyed.select(F.col("_row").alias("doc_id"), "text"), queries.table(spark, sf_dir, "benchmark")))
    return _by_row(keyed, leaked.select(F.col("doc_id").alias("_row")), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; nothing of empty ones. A null source is a source."""
    return source_mix.mix_by_document(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can express neither the classifier nor what follows from it; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
