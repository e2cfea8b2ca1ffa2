"""Group features: centroids, representatives, weighted means, camera centring, distance statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.vectors import distance, normalize


def vector_mean(df: DataFrame, keys: list[str], column: str = "v", weight: str | None = None, out: str = "v") -> DataFrame:
    """The (weighted) mean vector of each group; partial sums are taken before the shuffle."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.select(*keys, F.posexplode(column).alias("_p", "_x"), w.alias("_w"))
    means = rows.groupBy(*keys, "_p").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias(out))


def centroids(df: DataFrame, label: str) -> DataFrame:
    """The mean vector of each label but -1."""
    return vector_mean(df.where(F.col(label) != -1), [label])


def normalized_centroids(df: DataFrame, label: str) -> DataFrame:
    return centroids(df, label).withColumn("v", normalize(F.col("v")))


def barycentres(df: DataFrame, label: str) -> DataFrame:
    """(label, idx, v): each group's member nearest to its mean; ties go to the lower idx."""
    near = df.join(centroids(df, label).select(label, F.col("v").alias("c")), label).withColumn("_d", distance(F.col("v"), F.col("c"), 0.0))
    best = near.groupBy(label).agg(F.min(F.struct("_d", "idx", "v")).alias("b"))
    return best.select(label, "b.idx", "b.v")


def attention_means(df: DataFrame, label: str, eps: float = 1e-6) -> DataFrame:
    """The mean of each group's members weighted by exp(-distance to the mean); the weights' sum gets ``eps`` added."""
    near = df.join(centroids(df, label).select(label, F.col("v").alias("c")), label).withColumn("_w", F.exp(-distance(F.col("v"), F.col("c"), 0.0)))
    sums = near.groupBy(label).agg(F.sum("_w").alias("_s"))
    mean = vector_mean(near, [label], "v", "_w")
    return mean.join(sums, label).select(label, F.transform("v", lambda x: x * F.col("_s") / (F.col("_s") + eps)).alias("v"))


def ambiguous_groups(df: DataFrame, label: str) -> DataFrame:
    """Groups with more than one camera or identity; there should be none."""
    return df.groupBy(label).agg(F.countDistinct("cam").alias("cams"), F.countDistinct("pid").alias("pids")).where("cams > 1 or pids > 1")


def centre_cameras(df: DataFrame) -> DataFrame:
    """Vectors less their camera's mean, plus the unweighted mean of the camera means."""
    cam = vector_mean(df, ["cam"], out="_c")
    every = vector_mean(cam.withColumn("_all", F.lit(0)), ["_all"], "_c", out="_m").select("_m")
    shift = cam.crossJoin(F.broadcast(every)).select("cam", F.zip_with("_c", "_m", lambda c, m: c - m).alias("_s"))
    return df.join(shift, "cam").withColumn("v", F.zip_with("v", "_s", lambda x, s: x - s)).drop("_s")
