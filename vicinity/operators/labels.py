"""Identity labels: dense ranks, ids within and over cameras, catalog statistics.

Ranks are taken over distinct values, then joined, so no window runs over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense_label(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column``'s 0-based rank among its sorted distinct values."""
    values = df.select(F.col(column).alias("_v")).distinct().withColumn("_r", (F.row_number().over(Window.orderBy("_v")) - 1).cast("int"))
    joined = df.join(values, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")
    return joined.withColumn(out, F.col("_r")).drop("_r")


def extend_ids(df: DataFrame) -> DataFrame:
    """``df`` (idx, pid, cam, ..) with intra_id (rank of pid in its camera), accum_id (the same, over all cameras) and img_idx (place in its camera)."""
    keys = df.select("cam", "pid").distinct()
    keys = keys.withColumn("intra_id", (F.row_number().over(Window.partitionBy("cam").orderBy("pid")) - 1).cast("int"))
    keys = keys.join(camera_offsets(keys), "cam").select("cam", "pid", "intra_id", (F.col("intra_id") + F.col("offset")).cast("int").alias("accum_id"))
    place = (F.row_number().over(Window.partitionBy("cam").orderBy("idx")) - 1).cast("int")
    return df.withColumn("img_idx", place).join(keys, ["cam", "pid"])


def camera_offsets(keys: DataFrame) -> DataFrame:
    """(cam, offset): how many (cam, pid) stand before each camera."""
    counts = keys.groupBy("cam").agg(F.count("*").alias("n"))
    return counts.select("cam", (F.sum("n").over(Window.orderBy("cam")) - F.col("n")).alias("offset"))


def camera_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cam").agg(F.countDistinct("pid").alias("id_count"), F.count("*").alias("img_count"))


def catalog_stats(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.countDistinct("pid").alias("num_pids"), F.count("*").alias("num_imgs"), F.countDistinct("cam").alias("num_cams"))


def camera_mask(df: DataFrame) -> DataFrame:
    """(cam, mask): 1 at each accum_id that the camera has, else 0."""
    n = df.agg((F.max("accum_id") + 1).alias("n"))
    own = df.groupBy("cam").agg(F.collect_set("accum_id").alias("own"))
    return own.crossJoin(n).select("cam", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_contains("own", i).cast("int")).alias("mask"))


def camera_proxies(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters split by camera: 0-based ids in the order of (cluster, cam); -1 stays."""
    keys = df.where(F.col(cluster) >= 0).select(F.col(cluster).alias("_c"), F.col("cam").alias("_m")).distinct()
    keys = keys.withColumn("_p", F.row_number().over(Window.orderBy("_c", "_m")) - 1)
    joined = df.join(keys, (F.col(cluster) == F.col("_c")) & (F.col("cam") == F.col("_m")), "left").drop("_c", "_m")
    return joined.withColumn("proxy", F.coalesce("_p", F.lit(-1)).cast("int")).drop("_p")
