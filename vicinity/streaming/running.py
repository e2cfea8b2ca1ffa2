"""Streams of readings and of feature batches: running averages, and memories that follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from vicinity.operators.checkpoints import cut
from vicinity.operators.memory import update_each


def running(rows: DataFrame, order: str, aggregates: dict[str, str]) -> DataFrame:
    """``rows`` with running_x for each x of ``aggregates`` ("sum" or "max"): over all rows up to this one by the unique ``order``.

    Rows are dealt to chunks by range; each chunk adds what the chunks before it come to, so no task holds them all.
    """
    dealt = cut(rows.repartitionByRange(F.col(order)).withColumn("_chunk", F.spark_partition_id()))
    of = {"sum": F.sum, "max": F.max}
    whole = dealt.groupBy("_chunk").agg(*[of[a](c).alias(f"_{c}") for c, a in aggregates.items()])
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = whole.select("_chunk", *[of[a](f"_{c}").over(earlier).alias(f"_{c}") for c, a in aggregates.items()])
    here = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(before), "_chunk")  # as many rows as there are partitions
    add = {"sum": lambda x, y: F.coalesce(x, F.lit(0.0)) + y, "max": F.greatest}
    return joined.select(*rows.columns, *[add[a](F.col(f"_{c}"), of[a](c).over(here)).alias(f"running_{c}") for c, a in aggregates.items()])


def running_averages(readings: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """A meter a key over a stream (or a table): last value seen isn't kept, only sum, count and average."""
    w = F.lit(1) if weight is None else F.col(weight)
    return readings.groupBy(key).agg(F.sum(F.col(value) * w).alias("sum"), F.sum(w).alias("count"), (F.sum(F.col(value) * w) / F.sum(w)).alias("avg"))


def follow(batches: DataFrame, bank_path: str, momentum: float, checkpoint: str) -> StreamingQuery:
    """Moves the memory at ``bank_path`` (versions 0, 1, .. of (key, m)) by each micro-batch of (key, idx, v), in order of idx.

    Batch n reads version n and writes version n + 1 over whatever is there, so a batch that runs twice gives the same bank.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bank = spark.read.parquet(f"{bank_path}/{n}")
        update_each(bank, batch, momentum).write.mode("overwrite").parquet(f"{bank_path}/{n + 1}")

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
