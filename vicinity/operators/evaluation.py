"""Retrieval and clustering metrics.

Retrieval metrics need the places of each query's hits among all its pairs; the tasks that have the distances work them
out, so that no pair is shuffled (``mean_ap`` takes pairs from elsewhere). The variants differ in which pairs are junk, in
whether queries without a match count, and in ties, and are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.pairwise import row_folds


def _placed(d: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 1-based places of a query's hits by (d, j), and which rows come before the first; ``d`` is in the order of j."""
    among = np.sort(d)
    hits = np.sort(d[hit])
    first = np.searchsorted(among, hits)
    if not len(hits):
        return hits.astype(np.int64), hit
    if (np.searchsorted(among, hits, "right") - first == 1).all() and not np.isnan(hits[-1]):
        return first + 1, d < hits[0]
    order = np.argsort(d, kind="stable")
    places = np.flatnonzero(hit[order]) + 1
    before = np.zeros(len(d), bool)
    before[order[: places[0] - 1]] = True
    return places, before


def map_cmc(queries: DataFrame, gallery: DataFrame, ranks=(1, 5, 10, 20)) -> DataFrame:
    """One row (mAP, R1, ..): rows of the same identity and camera, and of identity -1, are junk; a query without a match counts with 0."""

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        ap, first = [], []
        for r in range(len(i)):
            same = pid_j == pid_i[r]
            keep = ~(same & (cam_j == cam_i[r])) & (pid_j != -1)
            places, _ = _placed(-d[r, keep], same[keep])
            ap.append(float(np.mean(np.arange(1, len(places) + 1) / places)) if len(places) else None)
            first.append(int(places[0]) if len(places) else None)
        return {"i": i, "ap": pa.array(ap, pa.float64()), "first": pa.array(first, pa.int64())}

    by = row_folds(queries, gallery, fold, "i long, ap double, first long", metric="dot")
    by = queries.select(F.col("idx").alias("i")).join(by, "i", "left")
    return by.agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("mAP"), *[F.avg(F.coalesce(F.col("first") <= r, F.lit(False)).cast("double")).alias(f"R{r}") for r in ranks])


def cmc(queries: DataFrame, gallery: DataFrame, topk: int = 100, *, separate_camera_set: bool = False, first_match_break: bool = False) -> DataFrame:
    """(rank, cmc): queries without a match are skipped. By default each of a query's m matches adds 1/m at its rank less the matches before it."""

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        used, gains = 0, np.zeros(topk)
        for r in range(len(i)):
            same, own = pid_j == pid_i[r], cam_j == cam_i[r]
            keep = ~own if separate_camera_set else ~(own & same)
            places, _ = _placed(d[r, keep], same[keep])
            if len(places):
                at = places[:1] - 1 if first_match_break else places - np.arange(1, len(places) + 1)
                gains += np.bincount(at[at < topk], minlength=topk) / len(at)
                used += 1
        return {"sums": [[float(used), *gains.tolist()]]}

    sums = row_folds(queries, gallery, fold, "sums array<double>").select(F.posexplode("sums").alias("rank", "x")).groupBy("rank").agg(F.sum("x").alias("x"))
    every = queries.sparkSession.range(topk + 1).select(F.col("id").alias("rank")).join(sums, "rank", "left")
    w = Window.orderBy("rank")  # topk + 1 rows
    total = F.sum(F.when(F.col("rank") > 0, F.coalesce("x", F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return every.select("rank", F.try_divide(total, F.first("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cmc")).where("rank > 0")


def average_precision(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """``mean_ap`` of all pairs by squared distance but those of the same identity and camera: (i, ap), worked out in the tasks that have the distances."""

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        ap = []
        for r in range(len(i)):
            same = pid_j == pid_i[r]
            keep = ~(same & (cam_j == cam_i[r]))
            hits = np.sort(d[r, keep & same])
            among = np.sort(d[r, keep])
            ap.append(float(np.mean(np.searchsorted(hits, hits, "right") / np.searchsorted(among, hits, "right"))) if len(hits) else None)
        return {"i": i, "ap": pa.array(ap, pa.float64())}

    return row_folds(queries, gallery, fold, "i long, ap double").where("ap is not null")


def mean_ap(found: DataFrame) -> DataFrame:
    """(i, ap) of (i, j, d, hit): step-wise average precision, tied distances as one threshold; queries without a match are left out."""
    step = found.groupBy("i", "d").agg(F.count("*").alias("c"), F.sum(F.col("hit").cast("long")).alias("h"))
    w = Window.partitionBy("i").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("precision", F.sum("h").over(w) / F.sum("c").over(w)).withColumn("all", F.sum("h").over(Window.partitionBy("i")))
    return step.where(F.col("all") > 0).groupBy("i").agg(F.sum(F.col("precision") * F.col("h") / F.col("all")).alias("ap"))


#: Conditions on pid_i, cam_i (numbers) and pid_j, cam_j (arrays) for pairs that don't count.
JUNK = {
    "false": lambda pid_i, cam_i, pid_j, cam_j: False,
    "pid_i = pid_j and cam_i = cam_j": lambda pid_i, cam_i, pid_j, cam_j: (pid_i == pid_j) & (cam_i == cam_j),
    "cam_i = 3 and cam_j = 2": lambda pid_i, cam_i, pid_j, cam_j: (cam_i == 3) & (cam_j == 2),
}


def cross_modality(queries: DataFrame, gallery: DataFrame, *, junk: str | Callable, deduplicate: bool = True, max_rank: int = 20) -> DataFrame:
    """One row (mAP, mINP, R1, R5, R10, R20).

    ``junk`` is a condition on pid_i, cam_i, pid_j, cam_j: one of ``JUNK``, or a function like them. With ``deduplicate`` ranks count identities,
    each at its first place. Queries without a match are skipped. INP is hits / rank of the last hit.
    """
    of = junk if callable(junk) else JUNK[junk]

    def fold(i, pid_i, cam_i, j, pid_j, cam_j, d):
        out = []
        for r in range(len(i)):
            keep = ~np.broadcast_to(of(pid_i[r], cam_i[r], pid_j, cam_j), pid_j.shape)
            places, before = _placed(d[r, keep], pid_j[keep] == pid_i[r])
            if len(places):
                first = len(np.unique(pid_j[keep][before])) + 1 if deduplicate else places[0]
                out.append((i[r], float(np.mean(np.arange(1, len(places) + 1) / places)), len(places) / places[-1], first))
        return {c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate((("i", pa.int64()), ("ap", pa.float64()), ("inp", pa.float64()), ("first", pa.int64())))}

    by = row_folds(queries, gallery, fold, "i long, ap double, inp double, first long")
    return by.agg(F.avg("ap").alias("mAP"), F.avg("inp").alias("mINP"), *[F.avg((F.col("first") <= r).cast("double")).alias(f"R{r}") for r in (1, 5, 10, max_rank)])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari)."""
    cells = contingency(df, a, b)
    pairs_of = lambda n: n * (n - 1) / F.lit(2.0)
    both = cells.agg(F.sum(pairs_of(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias(f"p{c}"))
    row = both.crossJoin(one("a")).crossJoin(one("b"))
    expected, most = F.col("pa") * F.col("pb") / pairs_of(F.col("total")), (F.col("pa") + F.col("pb")) / 2
    return row.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (nmi): mutual information over the mean of the entropies."""
    cells = contingency(df, a, b)
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    sums = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"n{c}"))
    entropy = lambda c: sums(c).crossJoin(total).agg((-F.sum(F.col(f"n{c}") / F.col("t") * F.log(F.col(f"n{c}") / F.col("t")))).alias(f"h{c}"))
    joint = cells.join(sums("a"), "a").join(sums("b"), "b").crossJoin(total)
    mi = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    row = mi.crossJoin(entropy("a")).crossJoin(entropy("b"))
    return row.select(F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))
