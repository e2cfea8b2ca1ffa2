"""Neighbourhoods and re-ranking: ranked pairs to mutual neighbours, sparse weights, expansions and Jaccard distances.

All relations are sparse and long: ranked pairs (i, j, d, tier, rk), sets (i, j), weights (i, j, w).
A pair that is absent has weight 0, and Jaccard distance 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.checkpoints import cut
from vicinity.operators.pairwise import BLOCK_ROWS, BROADCAST_BYTES, pair_lists, pairs

AT_ONCE = 1 << 20


def mutual(sets: DataFrame) -> DataFrame:
    """The pairs (i, j) whose mirror image is there too; keeps ``sets``' columns."""
    back = sets.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return sets.join(back, ["i", "j"], "left_semi")


def k_reciprocal(top: DataFrame, k: int) -> DataFrame:
    """Pairs among each other's first ``k`` (itself included)."""
    return mutual(top.where(F.col("rk") <= k))


def typed_neighbours(top: DataFrame, k_intra: int, k_cross: int) -> DataFrame:
    """(i, j, d, tier) of each i's first ``k_intra`` of tier 0 and first ``k_cross`` mutual ones of tier 1, in rank order."""
    same = top.where("tier = 0")
    cross = mutual(top.select("i", "j", "d", "tier", "rk")).where("tier = 1")
    both = same.select("i", "j", "d", "tier", "rk").unionByName(cross.select("i", "j", "d", "tier", "rk"))
    place = F.row_number().over(Window.partitionBy("i", "tier").orderBy("rk"))
    return both.withColumn("n", place).where(F.col("n") <= F.when(F.col("tier") == 0, k_intra).otherwise(k_cross)).select("i", "j", "d", "tier")


def priority_fill(top: DataFrame, k: int) -> DataFrame:
    """(i, j, d, tier): each i's mutual pairs and itself in rank order, then others in rank order, ``k`` in all."""
    back = top.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(True).alias("back"))
    marked = top.join(back, ["i", "j"], "left").withColumn("late", F.coalesce(~F.col("back"), F.col("i") != F.col("j")))
    place = F.row_number().over(Window.partitionBy("i").orderBy("late", "rk"))
    return marked.withColumn("n", place).where(F.col("n") <= k).select("i", "j", "d", "tier")


def recall_expansion(near: DataFrame, half: DataFrame) -> DataFrame:
    """``near`` (i, j) with a candidate's ``half`` set added where more than two thirds of it are in near already."""
    size = half.groupBy("i").agg(F.count("*").alias("size")).withColumnRenamed("i", "c")
    members = near.select("i", F.col("j").alias("c")).join(half.select(F.col("i").alias("c"), F.col("j").alias("x")), "c")
    overlap = members.join(near.select("i", F.col("j").alias("x")), ["i", "x"], "left_semi").groupBy("i", "c").agg(F.count("*").alias("n"))
    good = overlap.join(size, "c").where(F.col("n") * 3 > F.col("size") * 2).select("i", "c")
    return near.select("i", "j").union(members.join(good, ["i", "c"], "left_semi").select("i", F.col("x").alias("j"))).distinct()


def softmax_weights(sets: DataFrame) -> DataFrame:
    """(i, j, w): exp(-d) of each i's set (i, j, d), summing to 1."""
    e = F.exp(-F.col("d"))
    return sets.select("i", "j", (e / F.sum(e).over(Window.partitionBy("i"))).alias("w"))


def grouped_softmax_weights(neighbours: DataFrame, alpha: float = 0.3, tau: float = 2.0) -> DataFrame:
    """(i, j, w): softmax within each tier, ``alpha`` to tier 0 (at temperature ``tau``) and the rest to tier 1, then rows that sum to 1."""
    own = F.col("tier") == 0
    e = F.exp(-F.col("d") / F.when(own, F.lit(float(tau))).otherwise(F.lit(1.0)))
    rows = neighbours.withColumn("e", e)
    w = F.col("e") / F.sum("e").over(Window.partitionBy("i", "tier")) * F.when(own, F.lit(float(alpha))).otherwise(F.lit(1.0 - alpha))
    rows = rows.withColumn("w", w)
    return rows.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("w"))


def local_expansion(weights: DataFrame, lists: DataFrame) -> DataFrame:
    """(i, j, w): the mean of the weight rows of each i's list (i, n); a row that is listed twice counts twice."""
    share = lists.withColumn("share", 1 / F.count("*").over(Window.partitionBy("i")))
    rows = weights.select(F.col("i").alias("n"), "j", "w")
    return share.join(rows, "n").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("share")).alias("w"))


def balanced_expansion(weights: DataFrame, neighbours: DataFrame, beta: float = 0.5) -> DataFrame:
    """(i, j, w): ``beta`` of the mean of the tier 0 neighbours' rows and the rest of tier 1's; all of one where there is no other."""
    n = F.count("*").over(Window.partitionBy("i", "tier"))
    kinds = F.size(F.collect_set("tier").over(Window.partitionBy("i")))
    part = F.when(kinds == 1, F.lit(1.0)).when(F.col("tier") == 0, F.lit(float(beta))).otherwise(F.lit(1.0 - beta))
    share = neighbours.select("i", F.col("j").alias("n"), (part / n).alias("share"))
    rows = weights.select(F.col("i").alias("n"), "j", "w")
    return share.join(rows, "n").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("share")).alias("w"))


def _packed(weights: DataFrame) -> DataFrame:
    """``weights`` in blocks of ``BLOCK_ROWS`` whole rows i, each sorted by column."""

    def block(i, j, w):
        order = np.argsort(j, kind="stable")
        return pa.record_batch({"block": pa.array([int(i[0])])} | {c: pa.array([x[order].tobytes()]) for c, x in (("i", i), ("c", j), ("w", w))})

    def apply(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "w")]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            starts = np.flatnonzero(np.append(True, kept[0][1:] != kept[0][:-1]))
            cuts = starts[::BLOCK_ROWS]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield block(*(v[x:y] for v in kept))
            kept = [v[cuts[-1] :] for v in kept]  # its last row may go on in the next batch
        if kept is not None:
            yield block(*kept)

    rows = weights.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))
    return cut(rows.repartition("i").sortWithinPartitions("i").mapInArrow(apply, "block long, i binary, c binary, w binary"))


def min_sum(weights: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(i, j, m): the sum over columns of the smaller weight, for rows that share a column; ``of`` limits the rows i.

    Blocks of rows meet each other, and each two are joined on their columns in a task: what they share is never shuffled.
    """
    weights = weights if of is None else cut(weights)
    right = _packed(weights)
    left = right if of is None else _packed(weights.join(of, "i", "left_semi"))
    size = right.agg(F.sum(F.octet_length("i") * 3).alias("n")).first().n or 0

    def apply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ia, ca, wa), (ib, cb, wb) = ([np.frombuffer(batch.column(c + s)[k].as_buffer(), t) for c, t in (("i", np.int64), ("c", np.int64), ("w", np.float64))] for s in "ab")
                (ids, ra), (jds, rb) = np.unique(ia, return_inverse=True), np.unique(ib, return_inverse=True)
                low = np.searchsorted(cb, ca)
                n = np.searchsorted(cb, ca, "right") - low
                ends = np.cumsum(n)
                m, seen, x = np.zeros(len(ids) * len(jds)), np.zeros(len(ids) * len(jds), bool), 0
                while x < len(n):  # some ``AT_ONCE`` shared columns at a time
                    y = max(x + 1, int(np.searchsorted(ends, ends[x] - n[x] + AT_ONCE, "right")))
                    own = np.repeat(np.arange(x, y), n[x:y])
                    other = np.arange(len(own)) - np.repeat(ends[x:y] - n[x:y] - (ends[x] - n[x]), n[x:y]) + np.repeat(low[x:y], n[x:y])
                    at = ra[own] * len(jds) + rb[other]
                    m += np.bincount(at, np.minimum(wa[own], wb[other]), len(m))
                    seen[at] = True
                    x = y
                at = np.flatnonzero(seen)
                yield pa.record_batch({"i": pa.array(ids[at // len(jds)]), "j": pa.array(jds[at % len(jds)]), "m": pa.array(m[at])})

    a, b = (x.select(*[F.col(c).alias(c + s) for c in x.columns]) for x, s in ((left, "a"), (right, "b")))
    tasks = max(8, weights.sparkSession.sparkContext.defaultParallelism)
    return a.repartition(tasks).crossJoin(F.broadcast(b) if size <= BROADCAST_BYTES else b.repartition(tasks)).mapInArrow(apply, "i long, j long, m double")


def jaccard(weights: DataFrame, eps: float = 0.0, of: DataFrame | None = None) -> DataFrame:
    """(i, j, jaccard): max(0, 1 - m / (2 - m + eps)); pairs that share no column are left out and are at 1."""
    return min_sum(weights, of).select("i", "j", F.greatest(F.lit(0.0), 1 - F.col("m") / (2 - F.col("m") + eps)).alias("jaccard"))


def structured_jaccard(feat: DataFrame, *, k_search: int = 20, k_intra: int = 10, k_cross: int = 10, tau: float = 2.0, beta: float = 0.5, alpha: float = 0.3) -> DataFrame:
    """Jaccard distances under known identities within each camera: tiers, caps, grouped weights, balanced expansion."""
    near = typed_neighbours(cut(pairs(feat, feat, k=k_search, rule="tiers")), k_intra, k_cross)
    return jaccard(balanced_expansion(grouped_softmax_weights(near, alpha, tau), near, beta), 1e-12)


def reciprocal_jaccard(feat: DataFrame, *, k1: int = 20, k2: int = 6, include_self_in_k: bool = True) -> DataFrame:
    """Jaccard distances of k-reciprocal neighbours. With ``include_self_in_k`` k1 counts the vector itself."""
    top = cut(pairs(feat, feat, k=max(k1 + 1, k2), metric="gram"))
    k = k1 if include_self_in_k else k1 + 1
    near = k_reciprocal(top, k)
    sets = recall_expansion(near.select("i", "j"), k_reciprocal(top, min(half(k1) + 1, k)).select("i", "j"))
    weights = softmax_weights(distances(feat, sets))
    if k2 > 1:
        weights = local_expansion(weights, top.where(F.col("rk") <= k2).select("i", F.col("j").alias("n")))
    return jaccard(weights)


def half(k: int) -> int:
    """k / 2 rounded half to even."""
    return round(k / 2)


def distances(feat: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (i, j) with d = 2 - 2 x.y."""
    from vicinity.functions.vectors import dot

    a, b = (feat.select(F.col("idx").alias(c), F.col("v").alias(f"v{c}")) for c in "ij")
    return sets.join(a, "i").join(b, "j").select("i", "j", (2 - 2 * dot(F.col("vi"), F.col("vj"))).alias("d"))


def euclidean(feat: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (i, j) with the squared Euclidean distance d, at least 0."""
    from vicinity.functions.vectors import dot

    a, b = (feat.select(F.col("idx").alias(c), F.col("v").alias(f"v{c}"), dot(F.col("v"), F.col("v")).alias(f"size_{c}")) for c in "ij")
    d = F.col("size_i") + F.col("size_j") - 2 * dot(F.col("vi"), F.col("vj"))
    return sets.join(a, "i").join(b, "j").select("i", "j", F.greatest(d, F.lit(0.0)).alias("d"))


def camera_aware_jaccard(feat: DataFrame, *, ckrnns: bool = True, clqe: bool = True, k1: int = 30, k2: int = 6, k1_intra: int = 5, k1_inter: int = 20, k2_intra: int = 3, k2_inter: int = 3) -> DataFrame:
    """Jaccard distances with neighbours ranked within and across cameras apart; the two switches give four modes."""
    lists = {"top": ("all", max(k1 + 1, k2)), "intra": ("same camera", max(k1_intra + 1, k2_intra)), "inter": ("other camera", max(k1_inter + 1, k2_inter))}
    found = cut(pair_lists(feat, feat, lists, metric="gram"))
    part = lambda name, k: found.where((F.col("list") == name) & (F.col("rk") <= k)).select("i", "j", "rk")
    if ckrnns:
        sets = mutual(part("intra", k1_intra + 1).select("i", "j")).union(mutual(part("inter", k1_inter + 1).select("i", "j"))).distinct()
    else:
        top = part("top", k1 + 1)
        sets = recall_expansion(k_reciprocal(top, k1 + 1).select("i", "j"), k_reciprocal(top, half(k1) + 1).select("i", "j"))
    weights = softmax_weights(distances(feat, sets))
    if clqe:
        near = part("intra", k2_intra).union(part("inter", k2_inter))
    else:
        near = part("top", k2)
    return jaccard(local_expansion(weights, near.select("i", F.col("j").alias("n"))))


def priority_jaccard(feat: DataFrame, *, k1: int = 20, k_search_factor: float = 1.5, clqe: bool = True, k2: int = 6, k2_id: int = 3, k2_intra: int = 3, k2_inter: int = 3) -> DataFrame:
    """Jaccard distances of mutual neighbours filled up by priority: same identity, then other cameras, then the rest."""
    import math

    k_search = math.ceil(k1 * k_search_factor) + 1
    lists = {"priority": ("tiers", k_search), "top": ("all", k2), "identity": ("same identity", k2_id), "intra": ("camera's others", k2_intra), "inter": ("other camera", k2_inter)}
    found = cut(pair_lists(feat, feat, lists))
    weights = softmax_weights(priority_fill(found.where("list = 'priority'"), k1))
    if clqe:
        near = found.where("list in ('identity', 'intra', 'inter')").select("i", F.col("j").alias("n")).distinct()
    else:
        near = found.where("list = 'top'").select("i", F.col("j").alias("n"))
    return jaccard(local_expansion(weights, near), 1e-12)


#: The published settings of the structured distance.
PUBLISHED = {"k_search": 60, "k_intra": 25, "k_cross": 15, "tau": 2.5, "beta": 0.76}


def training_distance(feat: DataFrame, kind: str, **options) -> DataFrame:
    """Jaccard distances by name: "ICS" (identities known within cameras), "CAJ" (cameras known), "UN" (neither)."""
    if kind not in ("ICS", "CAJ", "UN"):
        raise ValueError(f"no such distance: {kind}")
    if kind == "UN":
        return reciprocal_jaccard(feat, **({"k1": 30, "k2": 6} | options))
    return (structured_jaccard if kind == "ICS" else camera_aware_jaccard)(feat, **options)


def rerank(queries: DataFrame, gallery: DataFrame, *, k1: int = 20, k2: int = 6, lam: float = 0.3) -> DataFrame:
    """(i, j, final) of each query and gallery vector: ``lam`` of the scaled distance and the rest of the Jaccard distance.

    Distances are squared and divided by each vector's largest before anything is ranked.
    """
    both = queries.unionByName(gallery)
    found = cut(pair_lists(both, both, {"top": ("all", max(k1 + 1, k2)), "far": ("far", 1)}, metric="euclid"))
    most = found.where("list = 'far'").select("i", (F.col("d") * F.col("d")).alias("most"))
    top = found.where("list = 'top'")
    near = k_reciprocal(top, k1 + 1).select("i", "j")
    sets = recall_expansion(near, k_reciprocal(top, half(k1) + 1).select("i", "j"))
    scaled = lambda d: (F.col("d") * F.col("d") / F.col("most")).alias("d")
    weights = softmax_weights(euclidean(both, sets).join(most, "i").select("i", "j", scaled("d")))
    if k2 > 1:
        weights = local_expansion(weights, top.where(F.col("rk") <= k2).select("i", F.col("j").alias("n")))
    close = jaccard(weights, 0.0, queries.select(F.col("idx").alias("i")))
    block = pairs(queries, gallery, metric="euclid").select("i", "j", "d").join(most, "i").select("i", "j", scaled("d"))
    blended = block.join(close, ["i", "j"], "left")
    return blended.select("i", "j", (F.coalesce("jaccard", F.lit(1.0)) * (1 - lam) + F.col("d") * lam).alias("final"))
