"""The test tables read as this package's inputs. Cameras are synthetic: ``vec_id % 6``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators.labels import extend_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, pid, cam, v): a row a vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("pid"), (F.col("vec_id") % 6).cast("int").alias("cam"), F.col("embedding").cast("array<double>").alias("v"))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with intra_id, accum_id and img_idx."""
    return extend_ids(features(spark, sf_dir))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, name): a file name as image collections have it, for each vector."""
    name = F.concat(F.lpad(F.col("pid").cast("string"), 4, "0"), F.lit("_c"), (F.col("cam") + 1).cast("string"), F.lit("s1_"), F.lpad(F.col("idx").cast("string"), 6, "0"), F.lit("_01.jpg"))
    return features(spark, sf_dir).select("idx", name.alias("name"))
