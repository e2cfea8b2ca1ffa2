"""Losses as aggregates over pairs and scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.pairwise import row_folds


def hardest(found: DataFrame, d: str = "d", larger: bool = False) -> DataFrame:
    """(i, hp, hn, jp, jn): each i's farthest pair of the same label and nearest of another, with their places; pairs with itself count.

    With ``larger``, d is a similarity: larger is closer. Ties go to the lower j.
    """
    key = -F.col(d) if larger else F.col(d)
    far = F.max(F.when(F.col("same"), F.struct(key.alias("d"), (-F.col("j")).alias("n"))))
    near = F.min(F.when(~F.col("same"), F.struct(key.alias("d"), F.col("j").alias("n"))))
    by = found.groupBy("i").agg(far.alias("p"), near.alias("q"))
    sign = -1 if larger else 1
    return by.select("i", (F.col("p.d") * sign).alias("hp"), (F.col("q.d") * sign).alias("hn"), (-F.col("p.n")).alias("jp"), F.col("q.n").alias("jn"))


def triplet(found: DataFrame, margin: float | None = 0.3, hard_factor: float = 0.0, d: str = "d", larger: bool = False) -> DataFrame:
    """One row (loss): mean of max(0, hp - hn + margin), or of log(1 + exp(hp - hn)) without a margin; of hn - hp with ``larger``."""
    gap = F.col("hp") * (1 + hard_factor) - F.col("hn") * (1 - hard_factor)
    gap = -gap if larger else gap
    one = F.greatest(F.lit(0.0), gap + margin) if margin is not None else F.log1p(F.exp(gap))
    return hardest(found, d, larger).agg(F.avg(one).alias("loss"))


def vector_triplet(feat: DataFrame, margin: float | None = 0.3, hard_factor: float = 0.0) -> DataFrame:
    """``triplet`` over all pairs of ``feat`` (idx, pid, cam, v) by distance, worked out in the tasks that have the distances."""

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        same = pid_i[:, None] == pid_j[None]
        ends = np.where(same, d, -np.inf).max(1), np.where(same, np.inf, d).min(1)
        return {"i": i} | {c: pa.array(np.sqrt(np.maximum(x, 1e-12)), mask=np.isinf(x)) for c, x in zip(("hp", "hn"), ends, strict=True)}

    gap = F.col("hp") * (1 + hard_factor) - F.col("hn") * (1 - hard_factor)
    one = F.greatest(F.lit(0.0), gap + margin) if margin is not None else F.log1p(F.exp(gap))
    return row_folds(feat, feat, fold, "i long, hp double, hn double", metric="euclid").agg(F.avg(one).alias("loss"))


def weighted_triplet(found: DataFrame) -> DataFrame:
    """One row (loss): positives weighted by softmax(d), negatives by softmax(-d), then log(1 + exp(p - n))."""
    e = F.when(F.col("same"), F.exp("d")).otherwise(F.exp(-F.col("d")))
    by = found.withColumn("e", e).groupBy("i").agg(*[(F.sum(F.when(ok, F.col("d") * F.col("e"))) / F.sum(F.when(ok, F.col("e")))).alias(n) for n, ok in (("p", F.col("same")), ("n", ~F.col("same")))])
    return by.agg(F.avg(F.log1p(F.exp(F.col("p") - F.col("n")))).alias("loss"))


def log_softmax(z: DataFrame) -> DataFrame:
    """``z`` (idx, key, label, z) with lp, the log of softmax over keys."""
    w = Window.partitionBy("idx")
    top = F.max("z").over(w)
    shifted = z.withColumn("_t", top)
    return shifted.withColumn("lp", F.col("z") - F.col("_t") - F.log(F.sum(F.exp(F.col("z") - F.col("_t"))).over(w))).drop("_t")


def smoothed_cross_entropy(z: DataFrame, eps: float = 0.1, ignore: int | None = None) -> DataFrame:
    """One row (loss): cross entropy with labels smoothed by ``eps`` over all keys; rows labelled ``ignore`` are left out."""
    rows = z if ignore is None else z.where(F.col("label") != ignore)
    n = F.count("*").over(Window.partitionBy("idx"))
    q = F.when(F.col("key") == F.col("label"), 1 - eps).otherwise(0.0) + eps / n
    return log_softmax(rows).withColumn("t", -F.col("lp") * q).groupBy("idx").agg(F.sum("t").alias("t")).agg(F.avg("t").alias("loss"))


def margin_scores(z: DataFrame, s: float = 30.0, m: float = 0.3) -> DataFrame:
    """Scores s * (z - m at the label)."""
    return z.withColumn("z", (F.col("z") - F.when(F.col("key") == F.col("label"), m).otherwise(0.0)) * s)


def supervised_contrast(found: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row (loss): mean over i of minus the mean log softmax of its pairs of the same label; ``found`` is (i, j, z, same)."""
    z = found.select(F.col("i").alias("idx"), F.col("j").alias("key"), F.lit(0).alias("label"), (F.col("z") / temperature).alias("z"), "same")
    return log_softmax(z).where("same").groupBy("idx").agg(F.avg("lp").alias("lp")).agg((-F.avg("lp")).alias("loss"))


def top_k_contrast(found: DataFrame, k: int = 8) -> DataFrame:
    """One row (loss): the k pairs of the same label with the least z, each against all other labels and the chosen ones."""
    place = F.row_number().over(Window.partitionBy("i", "same").orderBy("z", "j"))
    rows = found.withColumn("n", place).where(~F.col("same") | (F.col("n") <= k))
    z = rows.select(F.col("i").alias("idx"), F.col("j").alias("key"), F.lit(0).alias("label"), "z", "same")
    return log_softmax(z).where("same").groupBy("idx").agg(F.avg("lp").alias("lp")).agg((-F.avg("lp")).alias("loss"))


def vector_contrast(feat: DataFrame, k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """``supervised_contrast`` over all pairs of ``feat`` by dot product; with ``k``, ``top_k_contrast``. Worked out in the tasks that have the products."""

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        d, out = d / temperature, []
        for r in range(len(i)):
            same = pid_j == pid_i[r]
            own = d[r, same]
            chosen = own if k is None or len(own) <= k else np.partition(own, k - 1)[:k]
            if len(chosen):
                against = np.concatenate([chosen, d[r, ~same]])
                top = against.max()
                out.append((i[r], chosen.mean() - top - np.log(np.exp(against - top).sum())))
        return {"i": pa.array([x[0] for x in out], pa.int64()), "lp": pa.array([x[1] for x in out], pa.float64())}

    return row_folds(feat, feat, fold, "i long, lp double", metric="dot").agg((-F.avg("lp")).alias("loss"))


def _with_target(z: DataFrame) -> DataFrame:
    """``z`` with gt, the score of each idx's own class."""
    return z.withColumn("gt", F.max(F.when(F.col("target"), F.col("z"))).over(Window.partitionBy("idx")))


def same_camera_margin(z: DataFrame, *, scale: float = 16.0, margin: float = 0.1, push: float = 0.012) -> DataFrame:
    """One row (loss): cross entropy of classes, the own one less a margin.

    ``z``: (idx, key, z, target, positive, same_cam), a row a vector and class. Classes of the vector's camera that score at
    least as its own become harder: (1 + push) * z + push.
    """
    harder = ~F.col("target") & F.col("same_cam") & (F.col("z") >= F.col("gt"))
    out = F.when(harder, F.col("z") * (1 + push) + push).otherwise(F.col("z")) - F.when(F.col("target"), margin).otherwise(0.0)
    rows = log_softmax(_with_target(z).withColumn("z", out * scale))
    return rows.where("target").agg((-F.avg("lp")).alias("loss"))


def camera_adversarial(z: DataFrame, *, scale: float = 16.0, epsilon: float = 0.1, own: float | None = None, angle: float | None = None, push: float = 0.2) -> DataFrame:
    """One row (loss) of ``z`` as above: each positive class (of the same identity) against the negative classes alone.

    Positives share the weight ``epsilon``; the own class has ``own`` more. With ``angle``, the own class's score is that of
    an angle larger by it, and the scores of the camera's other classes become (1 + push) * z + push.
    """
    if angle is not None:
        cosine = F.least(F.greatest("z", F.lit(-1.0)), F.lit(1.0))
        wider = cosine * math.cos(angle) - F.sqrt(1 - cosine * cosine) * math.sin(angle)
        wider = F.when(cosine > math.cos(math.pi - angle), wider).otherwise(cosine - math.sin(math.pi - angle) * angle)
        z = z.withColumn("z", F.when(F.col("target"), wider).when(F.col("same_cam"), cosine * (1 + push) + push).otherwise(cosine))
    w = Window.partitionBy("idx")
    z = z.withColumn("z", F.col("z") * scale).withColumn("n", F.sum(F.col("positive").cast("long")).over(w))
    z = z.withColumn("against", F.sum(F.when(~F.col("positive"), F.exp("z")).otherwise(0.0)).over(w))
    weight = F.when(F.col("positive"), F.lit(epsilon) / F.col("n")).otherwise(0.0) + F.when(F.col("target"), F.lit(own or 0.0)).otherwise(0.0)
    one = (F.log(F.col("against") + F.exp("z")) - F.col("z")) * weight
    return z.groupBy("idx").agg(F.sum(one).alias("loss")).agg(F.avg("loss").alias("loss"))
