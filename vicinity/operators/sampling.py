"""Samplers: hash-ordered, so a seed gives the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def one_of_each(df: DataFrame, keys: list[str], id_column: str, seed: int) -> DataFrame:
    """One row of each group of ``keys``."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), shuffled(seed, id_column)).alias("r"))
    return best.select(*keys, "r.*")


def k_of_each(df: DataFrame, key: str, k: int, seed: int, id_column: str = "idx") -> DataFrame:
    """Exactly k rows of each group, with ``draw`` from 0: without repeats where a group has k, else its rows over and over."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(shuffled(seed, id_column), id_column)) - 1
    size = F.count("*").over(Window.partitionBy(key))
    rows = df.withColumn("_n", place).withColumn("_s", size).where(F.col("_n") < k)
    return rows.withColumn("draw", F.explode(F.sequence(F.col("_n"), F.lit(k - 1), F.col("_s").cast("int")))).drop("_n", "_s")


def diverse_instances(df: DataFrame, n: int, seed: int, by_camera: bool = True) -> DataFrame:
    """(anchor, pid, idx, draw): an anchor an identity, then n - 1 of its other rows, those of other cameras first if asked for; a single row stands alone."""
    order = shuffled(seed, "idx")
    anchor = df.groupBy("pid").agg(F.min_by(F.struct("idx", "cam"), order).alias("a")).select("pid", F.col("a.idx").alias("anchor"), F.col("a.cam").alias("acam"))
    others = df.join(anchor, "pid").where("idx <> anchor")
    first = (F.col("cam") == F.col("acam")).cast("int") if by_camera else F.lit(0)
    place = F.row_number().over(Window.partitionBy("pid").orderBy(first, order, "idx"))
    picked = others.withColumn("draw", place).where(F.col("draw") < n).select("anchor", "pid", "idx", "draw")
    return anchor.select("anchor", "pid", F.col("anchor").alias("idx"), F.lit(0).alias("draw")).unionByName(picked)


def pk_chunks(df: DataFrame, p: int, k: int, seed: int) -> DataFrame:
    """(batch, pid, idx): identities' shuffled rows in chunks of k; rounds of chunks, p identities a batch; what doesn't fill a chunk or batch is left out."""
    place = F.row_number().over(Window.partitionBy("pid").orderBy(shuffled(seed, "idx"), "idx")) - 1
    rows = df.withColumn("chunk", F.floor(place / k)).withColumn("_s", F.count("*").over(Window.partitionBy("pid"))).where((F.col("chunk") + 1) * k <= F.col("_s"))
    chunks = rows.select("pid", "chunk").distinct()
    turn = F.row_number().over(Window.partitionBy("chunk").orderBy(shuffled(seed, "pid", "chunk"), "pid")) - 1
    batches = chunks.withColumn("_t", turn).withColumn("_n", F.count("*").over(Window.partitionBy("chunk"))).withColumn("_b", F.floor(F.col("_t") / p)).where((F.col("_b") + 1) * p <= F.col("_n"))
    return rows.join(batches, ["pid", "chunk"]).select(F.struct("chunk", "_b").alias("batch"), "pid", "idx")


def paired(a: DataFrame, b: DataFrame, n: int, seed: int) -> DataFrame:
    """(pid, draw, a, b): n pairs an identity of one row from either side."""
    left, right = k_of_each(a, "pid", n, seed), k_of_each(b, "pid", n, seed + 1)
    return left.select("pid", "draw", F.col("idx").alias("a")).join(right.select("pid", "draw", F.col("idx").alias("b")), ["pid", "draw"])


def jittered(column: Column, seed: int, low: float, high: float, *keys: str) -> Column:
    """``column`` times a factor between low and high that depends on the keys and seed."""
    u = F.pmod(shuffled(seed, *keys), F.lit(1_000_000)) / 1_000_000
    return column * (u * (high - low) + low)
