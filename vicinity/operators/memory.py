"""Keyed memories: vectors by key that batches move towards by exponential averages, then unit length.

``bank``: (key, m); ``batch``: (key, idx, v). Scores are dot products, so the hardest vector has the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions.vectors import dot, normalize
from vicinity.operators.groups import vector_mean


def move(m: Column, v: Column, momentum: float) -> Column:
    return normalize(F.zip_with(m, v, lambda x, y: x * momentum + y * (1 - momentum)))


def _moved(bank: DataFrame, chosen: DataFrame, momentum: float) -> DataFrame:
    """``bank`` with the keys of ``chosen`` (key, v) moved."""
    joined = bank.join(chosen.withColumnRenamed("v", "_v"), "key", "left")
    return joined.select("key", F.when(F.col("_v").isNull(), F.col("m")).otherwise(move(F.col("m"), F.col("_v"), momentum)).alias("m"))


def update_each(bank: DataFrame, batch: DataFrame, momentum: float = 0.2) -> DataFrame:
    """One step a vector, in the order of idx. A key's vectors are folded in one array: a batch is bounded."""
    lists = batch.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("_l"))
    folded = F.aggregate("_l", F.col("m"), lambda m, x: move(m, x["v"], momentum))
    return bank.join(lists, "key", "left").select("key", F.when(F.col("_l").isNull(), F.col("m")).otherwise(folded).alias("m"))


def update_mean(bank: DataFrame, batch: DataFrame, momentum: float = 0.2) -> DataFrame:
    return _moved(bank, vector_mean(batch, ["key"]), momentum)


def _scored(bank: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(bank, "key").withColumn("s", dot(F.col("v"), F.col("m")))


def update_hardest(bank: DataFrame, batch: DataFrame, momentum: float = 0.2) -> DataFrame:
    best = _scored(bank, batch).groupBy("key").agg(F.min(F.struct("s", "idx", "v")).alias("b"))
    return _moved(bank, best.select("key", "b.v"), momentum)


def update_easiest(bank: DataFrame, batch: DataFrame, momentum: float = 0.2) -> DataFrame:
    best = _scored(bank, batch).groupBy("key").agg(F.max(F.struct("s", (-F.col("idx")).alias("n"), "v")).alias("b"))
    return _moved(bank, best.select("key", "b.v"), momentum)


def update_weighted(bank: DataFrame, batch: DataFrame, momentum: float = 0.2, temperature: float = 0.09) -> DataFrame:
    """Towards the mean of the vectors weighted by exp(-score / temperature)."""
    rows = _scored(bank, batch).withColumn("_w", F.exp(-F.col("s") / temperature))
    return _moved(bank, vector_mean(rows, ["key"], "v", "_w"), momentum)


def update_hybrid(bank: DataFrame, batch: DataFrame, momentum: float = 0.2) -> DataFrame:
    """(key, mean, hard): two banks from one."""
    mean, hard = update_mean(bank, batch, momentum), update_hardest(bank, batch, momentum)
    return mean.withColumnRenamed("m", "mean").join(hard.withColumnRenamed("m", "hard"), "key")


def stacked(hybrid: DataFrame, order: tuple[str, str] = ("mean", "hard")) -> DataFrame:
    """(place, key, m): both banks of ``update_hybrid``, one under the other in this order (places 0 and 1)."""
    first, second = (hybrid.select(F.lit(n).alias("place"), "key", F.col(c).alias("m")) for n, c in enumerate(order))
    return first.unionByName(second)


def model_average(teacher: DataFrame, student: DataFrame, momentum: float = 0.999) -> DataFrame:
    """(key, m): each parameter vector of ``teacher`` (key, m) moved towards that of ``student``, without a unit length."""
    joined = teacher.join(student.select("key", F.col("m").alias("_s")), "key")
    return joined.select("key", F.zip_with("m", "_s", lambda x, y: x * momentum + y * (1 - momentum)).alias("m"))


def instance_bank(bank: DataFrame, feat: DataFrame, instances: int) -> DataFrame:
    """(key, slot, m): centroids in slot 0, each key's first ``instances`` vectors (by idx) in the slots after it."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("idx"))
    some = feat.withColumn("slot", place).where(F.col("slot") <= instances).select("key", "slot", F.col("v").alias("m"))
    return bank.select("key", F.lit(0).alias("slot"), "m").unionByName(some)


def instance_losses(bank: DataFrame, batch: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(idx, centroid, instance): cross entropies over all slots of ``instance_bank``, and over each key's instances.

    The own key is stood for by its instance with the least score, every other by that with the largest.
    """
    z = batch.select("idx", F.col("key").alias("label"), "v").crossJoin(bank).select("idx", "key", "slot", "label", (dot(F.col("v"), F.col("m")) / temperature).alias("z"))
    slots = cross_entropy(z.select("idx", F.when(F.col("slot") == 0, F.col("key")).alias("key"), "label", "z")).withColumnRenamed("loss", "centroid")
    found = z.where("slot > 0").groupBy("idx", "key", "label").agg(F.min("z").alias("least"), F.max("z").alias("most"))
    logits = found.select("idx", "key", "label", F.when(F.col("key") == F.col("label"), F.col("least")).otherwise(F.col("most")).alias("z"))
    return slots.join(cross_entropy(logits).withColumnRenamed("loss", "instance"), "idx")


def centre_loss(hybrid: DataFrame, batch: DataFrame, temperature: float = 0.05, slack: float = 0.2) -> DataFrame:
    """One row (loss): half of the hard bank's cross entropy and of what the mean bank's has above ``slack``."""
    one = lambda c: cross_entropy(scores(hybrid.select("key", F.col(c).alias("m")), batch, temperature)).agg(F.avg("loss").alias(c))
    return one("hard").crossJoin(one("mean")).select((0.5 * (F.col("hard") + F.greatest(F.lit(0.0), F.col("mean") - slack))).alias("loss"))


def scores(bank: DataFrame, batch: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(idx, key, label, z): every vector's score with every key."""
    return batch.select("idx", F.col("key").alias("label"), "v").crossJoin(bank).select("idx", "key", "label", (dot(F.col("v"), F.col("m")) / temperature).alias("z"))


def cross_entropy(z: DataFrame) -> DataFrame:
    """(idx, loss) of (idx, key, label, z), stabilised by the largest score."""
    top = z.groupBy("idx").agg(F.max("z").alias("top"), F.max(F.when(F.col("key") == F.col("label"), F.col("z"))).alias("own"))
    total = z.join(top, "idx").groupBy("idx", "top", "own").agg(F.sum(F.exp(F.col("z") - F.col("top"))).alias("s"))
    return total.select("idx", (F.col("top") + F.log("s") - F.col("own")).alias("loss"))
