"""Queries of pair distances, ranks, neighbourhoods and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators import neighbours as nb
from vicinity.operators.pairwise import pair_distances, pair_lists, pairs, ranked
from vicinity.plans.registry import FEAT, query
from vicinity.sources import fixtures

DOT = "list_dot_product(a.v, b.v)"
SPLIT = f"WITH {FEAT}, q AS (SELECT * FROM feat WHERE idx % 5 = 0), g AS (SELECT * FROM feat WHERE idx % 5 <> 0)"


def split(spark, d):
    f = fixtures.features(spark, d)
    return f.where("idx % 5 = 0"), f.where("idx % 5 <> 0")


def _qg(expression: str) -> str:
    return f"{SPLIT} SELECT a.idx AS i, b.idx AS j, round({expression}, 6) AS d FROM q a, g b"


def _pairs_query(name, metric, expression):
    query(name, _qg(expression))(lambda spark, d: pairs(*split(spark, d), metric=metric).select("i", "j", F.round("d", 6).alias("d")))


_pairs_query("j1_squared_distance", "squared", f"greatest(0.0, 2 - 2 * {DOT})")
_pairs_query("j2_gram_distance", "gram", f"2 - 2 * {DOT}")
_pairs_query("j4_query_gallery_distance", "euclid", f"greatest(0.0, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * {DOT})")
_pairs_query("j5_query_gallery_score", "dot", DOT)


def _distance_query(name, metric, sql):
    query(name, _qg(sql))(lambda spark, d: pair_distances(*split(spark, d), metric=metric).select("i", "j", F.round("d", 6).alias("d")))


_SQ = "list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))"
_distance_query("j3_squared_euclid", "difference", _SQ)
_distance_query("j6_euclid", "distance", f"sqrt(greatest({_SQ}, 1e-12))")
_distance_query("j7_cosine_distance", "cosine distance", f"(1 - {DOT} / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) / 2")
_distance_query("j8_cosine", "cosine", f"{DOT} / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))")
_KL = "list_sum(list_transform(range(1, 65), lambda k: least(greatest({0}.v[k], 1e-6), 1.0) * ln(least(greatest({0}.v[k], 1e-6), 1.0) / least(greatest({1}.v[k], 1e-6), 1.0))))"
_distance_query("f6_symmetric_kl", "symmetric kl", f"({_KL.format('a', 'b')} + {_KL.format('b', 'a')}) / 2")
query("f7_linear_fusion", _qg(f"0.7 * greatest(0.0, 2 - 2 * {DOT}) + (1 - 0.7) * (1 - {DOT})"))(
    lambda spark, d: pairs(*split(spark, d), metric="dot").select("i", "j", F.round(F.lit(0.7) * F.greatest(F.lit(0.0), 2 - 2 * F.col("d")) + (1 - F.lit(0.7)) * (1 - F.col("d")), 6).alias("d")))

#: All pairs with tiers: 0 same camera and identity, 1 another camera, 2 the rest of the camera.
PAIRS = f"{FEAT}, pairs AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, greatest(0.0, 2 - 2 * {DOT}) AS d, a.cam = b.cam AS same_cam, a.pid = b.pid AS same_pid FROM feat a, feat b)"


def _top(name: str, k: int, tier: str = "0", where: str = "true", source: str = "pairs") -> str:
    return f", {name} AS MATERIALIZED (SELECT * FROM (SELECT *, {tier} AS tier, row_number() OVER (PARTITION BY i ORDER BY {tier}, d, j) AS rk FROM {source} WHERE {where}) WHERE rk <= {k})"


TIERS = "CASE WHEN same_cam AND same_pid THEN 0 WHEN same_cam THEN 2 ELSE 1 END"


def feats(spark, d):
    return fixtures.features(spark, d)


query("p10_pair_classes", f"WITH {PAIRS} SELECT CASE WHEN same_cam AND same_pid THEN 'same_cam_same_id' WHEN same_cam THEN 'same_cam_diff_id' ELSE 'cross_cam' END AS kind, count(*) AS n FROM pairs GROUP BY 1")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d)).groupBy(F.when(F.col("same_cam") & F.col("same_pid"), "same_cam_same_id").when(F.col("same_cam"), "same_cam_diff_id").otherwise("cross_cam").alias("kind")).agg(F.count("*").alias("n")))
query("p11_tiered_ranks", f"WITH {PAIRS}{_top('top', 20, TIERS)} SELECT i, j, tier, round(d, 6) AS d, rk FROM top")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), k=20, rule="tiers").select("i", "j", "tier", F.round("d", 6).alias("d"), F.col("rk").cast("long").alias("rk")))
_T4 = "CASE WHEN same_cam AND same_pid THEN 0 WHEN same_cam THEN 4000 ELSE 2000 END"
query("p12_priority_ranks", f"WITH {PAIRS}{_top('top', 31, _T4)} SELECT i, j, tier, rk FROM top")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), k=31, rule="tiers").select("i", "j", (F.col("tier") * 2000).alias("tier"), F.col("rk").cast("long").alias("rk")))
query("p13_camera_lists", f"WITH {PAIRS}{_top('near', 6, 'CASE WHEN same_cam THEN 0 ELSE 1 END')}{_top('far', 21, 'CASE WHEN same_cam THEN 1 ELSE 0 END')} SELECT 'intra' AS list, i, j, rk FROM near UNION ALL SELECT 'inter', i, j, rk FROM far")(
    lambda spark, d: _camera_lists(feats(spark, d)))


def _camera_lists(f):
    return pair_lists(f, f, {"intra": ("same camera", 6), "inter": ("other camera", 21)}).select("list", "i", "j", F.col("rk").cast("long").alias("rk"))


query("p14_typed_lists", f"WITH {PAIRS}{_top('a', 3, 'CASE WHEN same_cam AND same_pid THEN 0 ELSE 1 END')}{_top('b', 3, 'CASE WHEN same_cam AND NOT same_pid THEN 0 ELSE 1 END')}{_top('c', 3, 'CASE WHEN NOT same_cam THEN 0 ELSE 1 END')} SELECT i, j FROM a UNION SELECT i, j FROM b UNION SELECT i, j FROM c")(
    lambda spark, d: _typed_lists(feats(spark, d)))


def _typed_lists(f):
    lists = {"identity": ("same identity", 3), "intra": ("camera's others", 3), "inter": ("other camera", 3)}
    return pair_lists(f, f, lists).select("i", "j").distinct()


query("p15_cross_camera_upper", f"WITH {PAIRS} SELECT i, count(*) AS n, round(min(d), 6) AS nearest FROM pairs WHERE NOT same_cam AND i < j GROUP BY i")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), rule="cross").where("i < j").groupBy("i").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("nearest")))
query("j9_brute_force_knn", f"{SPLIT}, p AS (SELECT a.idx AS i, b.idx AS j, greatest(0.0, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * {DOT}) AS d FROM q a, g b) SELECT i, j, round(d, 6) AS d, rk FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p) WHERE rk <= 20")(
    lambda spark, d: pairs(*split(spark, d), k=20, metric="euclid").select("i", "j", F.round("d", 6).alias("d"), F.col("rk").cast("long").alias("rk")))
query("j10_w9_cross_camera_top", f"WITH {PAIRS}{_top('top', 5, '0', 'NOT same_cam')} SELECT i, j, rk FROM top")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), k=5, rule="cross").select("i", "j", F.col("rk").cast("long").alias("rk")))
query("j11_mutual_top", f"WITH {PAIRS}{_top('top', 20)} SELECT a.i, a.j FROM top a JOIN top b ON a.i = b.j AND a.j = b.i")(
    lambda spark, d: nb.mutual(pairs(feats(spark, d), feats(spark, d), k=20).select("i", "j")))
query("j12_k_reciprocal", f"WITH {PAIRS}{_top('top', 21)} SELECT a.i, a.j FROM top a JOIN top b ON a.i = b.j AND a.j = b.i")(
    lambda spark, d: nb.k_reciprocal(pairs(feats(spark, d), feats(spark, d), k=21), 21).select("i", "j"))

RECALL = """, near AS (SELECT a.i, a.j FROM {top} a JOIN {top} b ON a.i = b.j AND a.j = b.i WHERE a.rk <= {k} AND b.rk <= {k}),
half AS (SELECT a.i, a.j FROM {top} a JOIN {top} b ON a.i = b.j AND a.j = b.i WHERE a.rk <= {h} AND b.rk <= {h}),
hs AS (SELECT i AS c, count(*) AS size FROM half GROUP BY i), mem AS (SELECT n.i, n.j AS c, h.j AS x FROM near n JOIN half h ON h.i = n.j),
good AS (SELECT m.i, m.c FROM mem m JOIN near n ON n.i = m.i AND n.j = m.x JOIN hs USING (c) GROUP BY m.i, m.c, size HAVING count(*) * 3 > size * 2),
sets AS (SELECT i, j FROM near UNION SELECT m.i, m.x FROM mem m JOIN good g ON g.i = m.i AND g.c = m.c)"""
query("j14_recall_expansion", f"WITH {PAIRS}{_top('top', 21)}{RECALL.format(top='top', k=21, h=11)} SELECT i, j FROM sets")(
    lambda spark, d: _recall(pairs(feats(spark, d), feats(spark, d), k=21)))


def _recall(top):
    return nb.recall_expansion(nb.k_reciprocal(top, 21).select("i", "j"), nb.k_reciprocal(top, 11).select("i", "j"))


query("j15_a12_min_sum_jaccard", f"WITH {PAIRS}{_top('top', 10)}, v AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM top), m AS (SELECT a.i, b.i AS j, sum(least(a.w, b.w)) AS m FROM v a JOIN v b ON a.j = b.j GROUP BY a.i, b.i) SELECT i, j, round(greatest(0.0, 1 - m / (2 - m)), 6) AS jaccard FROM m WHERE i < j")(
    lambda spark, d: nb.jaccard(nb.softmax_weights(pairs(feats(spark, d), feats(spark, d), k=10))).where("i < j").select("i", "j", F.round("jaccard", 6).alias("jaccard")))
query("j16_group_min_distance", f"WITH {PAIRS}, g AS (SELECT a.cam AS cam1, a.pid AS id1, b.cam AS cam2, b.pid AS id2, min(d) AS d FROM pairs JOIN feat a ON a.idx = i JOIN feat b ON b.idx = j WHERE a.cam < b.cam GROUP BY ALL) SELECT cam1, id1, cam2, id2, round(d, 6) AS d FROM g")(
    lambda spark, d: _groups(feats(spark, d)))


def _groups(f):
    keys = lambda c, n: f.select(F.col("idx").alias(c), F.col("cam").alias(f"cam{n}"), F.col("pid").alias(f"id{n}"))
    found = pairs(f, f, rule="cross").join(keys("i", 1), "i").join(keys("j", 2), "j").where("cam1 < cam2")
    return found.groupBy("cam1", "id1", "cam2", "id2").agg(F.round(F.min("d"), 6).alias("d"))


query("j17_zip_join", f"WITH {FEAT} SELECT idx, cam, CAST(pid % 4 - 1 AS INT) AS p_label FROM feat WHERE pid % 4 - 1 <> -1")(
    lambda spark, d: feats(spark, d).select("idx", "cam").join(feats(spark, d).select("idx", (F.col("pid") % 4 - 1).cast("int").alias("p_label")), "idx").where("p_label <> -1"))
query("j18_u4_junk_anti_join", f"{SPLIT} SELECT a.idx AS i, count(*) AS n FROM q a, g b WHERE NOT (a.pid = b.pid AND a.cam = b.cam) GROUP BY a.idx")(
    lambda spark, d: _not_junk(*split(spark, d)))


def _not_junk(q, g):
    """How many gallery rows aren't of the query's identity and camera: all less the group's."""
    groups = g.groupBy("pid", "cam").agg(F.count("*").alias("junk"))
    every = g.agg(F.count("*").alias("total"))  # one row
    return q.join(groups, ["pid", "cam"], "left").crossJoin(every).select(F.col("idx").alias("i"), (F.col("total") - F.coalesce("junk", F.lit(0))).alias("n"))


query("w1_full_argsort", f"{SPLIT} SELECT a.idx AS i, b.idx AS j, row_number() OVER (PARTITION BY a.idx ORDER BY greatest(0.0, 2 - 2 * {DOT}), b.idx) AS rk FROM q a, g b")(
    lambda spark, d: ranked(pairs(*split(spark, d))).select("i", "j", F.col("rk").cast("long").alias("rk")))
query("w2_reverse_argsort", f"{SPLIT} SELECT a.idx AS i, b.idx AS j, row_number() OVER (PARTITION BY a.idx ORDER BY {DOT} DESC, b.idx) AS rk FROM q a, g b")(
    lambda spark, d: ranked(pairs(*split(spark, d), metric="dot"), descending=True).select("i", "j", F.col("rk").cast("long").alias("rk")))
query("w3_w4_top_k", f"WITH {PAIRS}{_top('top', 22)} SELECT i, j, round(d, 6) AS d, rk FROM top")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), k=22).select("i", "j", F.round("d", 6).alias("d"), F.col("rk").cast("long").alias("rk")))
TYPED = """, mut AS (SELECT a.* FROM top a JOIN top b ON a.i = b.j AND a.j = b.i),
nbr AS (SELECT i, j, d, tier FROM (SELECT *, row_number() OVER (PARTITION BY i, tier ORDER BY rk) AS n FROM (SELECT * FROM top WHERE tier = 0 UNION ALL SELECT * FROM mut WHERE tier = 1)) WHERE n <= 10)"""
query("w5_typed_caps", f"WITH {PAIRS}{_top('top', 20, TIERS)}{TYPED} SELECT i, j, tier FROM nbr")(
    lambda spark, d: nb.typed_neighbours(pairs(feats(spark, d), feats(spark, d), k=20, rule="tiers"), 10, 10).select("i", "j", "tier"))
FILL = ", fill AS (SELECT i, j, d, tier FROM (SELECT a.*, row_number() OVER (PARTITION BY a.i ORDER BY (b.i IS NULL AND a.i <> a.j), a.rk) AS n FROM top a LEFT JOIN top b ON a.i = b.j AND a.j = b.i) WHERE n <= 20)"
query("w6_priority_fill", f"WITH {PAIRS}{_top('top', 31, TIERS.replace('2', '3').replace('1', '2'))}{FILL} SELECT i, j FROM fill")(
    lambda spark, d: nb.priority_fill(pairs(feats(spark, d), feats(spark, d), k=31, rule="tiers"), 20).select("i", "j"))
query("w7_smallest_pairs", f"WITH {PAIRS} SELECT i, j, round(d, 6) AS d FROM pairs WHERE NOT same_cam AND i < j ORDER BY pairs.d, i, j LIMIT 100")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), rule="cross").where("i < j").orderBy("d", "i", "j").limit(100).select("i", "j", F.round("d", 6).alias("d")))
query("w8_sorted_edges", f"WITH {PAIRS}{_top('top', 5, '0', 'NOT same_cam')} SELECT row_number() OVER (ORDER BY d, i, j) AS place, i, j FROM top WHERE i < j")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d), k=5, rule="cross").where("i < j").select(F.row_number().over(Window.orderBy("d", "i", "j")).cast("long").alias("place"), "i", "j"))
query("u1_u2_u3_set_sizes", f"WITH {PAIRS}{_top('a', 6, 'CASE WHEN same_cam THEN 0 ELSE 1 END')}{_top('b', 10)} SELECT coalesce(x.i, y.i) AS i, count(*) AS union_size, count(*) FILTER (x.j IS NOT NULL AND y.j IS NOT NULL) AS common FROM a x FULL JOIN b y ON x.i = y.i AND x.j = y.j GROUP BY 1")(
    lambda spark, d: _set_sizes(feats(spark, d)))


def _set_sizes(f):
    found = pair_lists(f, f, {"a": ("same camera", 6), "b": ("all", 10)})
    a, b = (found.where(F.col("list") == c).groupBy("i").agg(F.collect_set("j").alias(c)) for c in "ab")
    return a.join(b, "i").select("i", F.size(F.array_union("a", "b")).cast("long").alias("union_size"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


query("a13_softmax_weights", f"WITH {PAIRS}{_top('top', 20)} SELECT i, j, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY i), 6) AS w FROM top")(
    lambda spark, d: nb.softmax_weights(pairs(feats(spark, d), feats(spark, d), k=20)).select("i", "j", F.round("w", 6).alias("w")))
GROUPED = ", e AS (SELECT *, exp(-d / CASE WHEN tier = 0 THEN 2.0 ELSE 1.0 END) AS e FROM nbr), u AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i, tier) * CASE WHEN tier = 0 THEN 0.3 ELSE 0.7 END AS w FROM e), v AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM u)"
query("a14_grouped_softmax", f"WITH {PAIRS}{_top('top', 20, TIERS)}{TYPED}{GROUPED} SELECT i, j, round(w, 6) AS w FROM v")(
    lambda spark, d: nb.grouped_softmax_weights(nb.typed_neighbours(pairs(feats(spark, d), feats(spark, d), k=20, rule="tiers"), 10, 10)).select("i", "j", F.round("w", 6).alias("w")))
query("a15_local_expansion", f"WITH {PAIRS}{_top('top', 10)}, v AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM top) SELECT t.i, v.j, round(sum(v.w / 6), 6) AS w FROM top t JOIN v ON v.i = t.j WHERE t.rk <= 6 GROUP BY t.i, v.j")(
    lambda spark, d: (lambda top: nb.local_expansion(nb.softmax_weights(top), top.where("rk <= 6").select("i", F.col("j").alias("n"))).select("i", "j", F.round("w", 6).alias("w")))(pairs(feats(spark, d), feats(spark, d), k=10)))
BQE = ", s AS (SELECT i, j AS n, CASE WHEN min(tier) OVER (PARTITION BY i) = max(tier) OVER (PARTITION BY i) THEN 1.0 ELSE 0.5 END / count(*) OVER (PARTITION BY i, tier) AS share FROM nbr), x AS (SELECT s.i, v.j, sum(share * w) AS w FROM s JOIN v ON v.i = s.n GROUP BY s.i, v.j)"
query("a17_balanced_expansion", f"WITH {PAIRS}{_top('top', 20, TIERS)}{TYPED}{GROUPED}{BQE} SELECT i, j, round(w, 6) AS w FROM x")(
    lambda spark, d: (lambda near: nb.balanced_expansion(nb.grouped_softmax_weights(near), near).select("i", "j", F.round("w", 6).alias("w")))(nb.typed_neighbours(pairs(feats(spark, d), feats(spark, d), k=20, rule="tiers"), 10, 10)))
JACCARD = ", m AS (SELECT a.i, b.i AS j, sum(least(a.w, b.w)) AS m FROM {x} a JOIN {x} b ON a.j = b.j GROUP BY a.i, b.i) SELECT i, j, round(greatest(0.0, 1 - m / (2 - m + {eps})), 6) AS jaccard FROM m WHERE i < j"


def _below(found):
    return found.where("i < j").select("i", "j", F.round("jaccard", 6).alias("jaccard"))


query("r1_structured_jaccard", f"WITH {PAIRS}{_top('top', 20, TIERS)}{TYPED}{GROUPED}{BQE}{JACCARD.format(x='x', eps='1e-12')}")(lambda spark, d: _below(nb.structured_jaccard(feats(spark, d))))
_PUBLISHED = (TYPED.replace("n <= 10", "n <= CASE WHEN tier = 0 THEN 25 ELSE 15 END"), GROUPED.replace("THEN 2.0", "THEN 2.5"), BQE.replace("ELSE 0.5", "ELSE CASE WHEN tier = 0 THEN 0.76 ELSE 0.24 END"))
query("r6_published_structured", f"WITH {PAIRS}{_top('top', 60, TIERS)}{''.join(_PUBLISHED)}{JACCARD.format(x='x', eps='1e-12')}")(
    lambda spark, d: _below(nb.training_distance(feats(spark, d), "ICS", **nb.PUBLISHED)))
SOFT = ", w AS (SELECT s.i, s.j, 2 - 2 * list_dot_product(a.v, b.v) AS d FROM sets s JOIN feat a ON a.idx = s.i JOIN feat b ON b.idx = s.j), v AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM w)"
LQE = ", x AS (SELECT t.i, v.j, sum(v.w / {k}) AS w FROM {lists} t JOIN v ON v.i = t.j WHERE t.rk <= {k} GROUP BY t.i, v.j)"
query("r2_reciprocal_jaccard", f"WITH {PAIRS}{_top('top', 21)}{RECALL.format(top='top', k=20, h=11)}{SOFT}{LQE.format(k=6, lists='top')}{JACCARD.format(x='x', eps='0.0')}")(lambda spark, d: _below(nb.reciprocal_jaccard(feats(spark, d))))
query("r6_unsupervised", f"WITH {PAIRS}{_top('top', 31)}{RECALL.format(top='top', k=30, h=16)}{SOFT}{LQE.format(k=6, lists='top')}{JACCARD.format(x='x', eps='0.0')}")(lambda spark, d: _below(nb.training_distance(feats(spark, d), "UN")))
_INTRA, _INTER = _top("intra", 6, "CASE WHEN same_cam THEN 0 ELSE 1 END"), _top("inter", 21, "CASE WHEN same_cam THEN 1 ELSE 0 END")
_CK = ", sets AS (SELECT a.i, a.j FROM intra a JOIN intra b ON a.i = b.j AND a.j = b.i UNION SELECT a.i, a.j FROM inter a JOIN inter b ON a.i = b.j AND a.j = b.i)"
_CL = ", lists AS (SELECT i, j FROM intra WHERE rk <= 3 UNION ALL SELECT i, j FROM inter WHERE rk <= 3), x AS (SELECT t.i, v.j, sum(v.w / 6) AS w FROM lists t JOIN v ON v.i = t.j GROUP BY t.i, v.j)"
for _ck in (True, False):
    for _cl in (True, False):
        _sql = f"WITH {PAIRS}{_top('top', 31)}{_INTRA}{_INTER}{_CK if _ck else RECALL.format(top='top', k=31, h=16)}{SOFT}{_CL if _cl else LQE.format(k=6, lists='top')}{JACCARD.format(x='x', eps='0.0')}"
        query(f"r3_camera_jaccard_{'ck' if _ck else 'k'}_{'clqe' if _cl else 'lqe'}", _sql)(lambda spark, d, a=_ck, b=_cl: _below(nb.camera_aware_jaccard(feats(spark, d), ckrnns=a, clqe=b)))
_P3 = "".join(_top(n, 3, f"CASE WHEN {c} THEN 0 ELSE 1 END") for n, c in (("l0", "same_cam AND same_pid"), ("l1", "same_cam AND NOT same_pid"), ("l2", "NOT same_cam")))
query("r4_a16_priority_jaccard", f"WITH {PAIRS}{_top('top', 31, TIERS)}{FILL}{_P3}, v AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM fill), lists AS (SELECT i, j FROM l0 UNION SELECT i, j FROM l1 UNION SELECT i, j FROM l2), n AS (SELECT i, count(*) AS n FROM lists GROUP BY i), x AS (SELECT t.i, v.j, sum(v.w / n) AS w FROM lists t JOIN n USING (i) JOIN v ON v.i = t.j GROUP BY t.i, v.j){JACCARD.format(x='x', eps='1e-12')}")(
    lambda spark, d: _below(nb.priority_jaccard(feats(spark, d))))
query("r5_query_gallery_rerank", f"""WITH {FEAT}, p0 AS (SELECT a.idx AS i, b.idx AS j, pow(greatest(0.0, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * {DOT}), 2) AS d0 FROM feat a, feat b),
pairs AS (SELECT i, j, d0 / max(d0) OVER (PARTITION BY i) AS d FROM p0){_top('top', 21)}{RECALL.format(top='top', k=21, h=11)},
v AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM sets JOIN pairs USING (i, j)){LQE.format(k=6, lists='top')},
m AS (SELECT a.i, b.i AS j, sum(least(a.w, b.w)) AS m FROM x a JOIN x b ON a.j = b.j WHERE a.i % 5 = 0 GROUP BY a.i, b.i)
SELECT p.i, p.j, round(coalesce(greatest(0.0, 1 - m / (2 - m)), 1.0) * 0.7 + p.d * 0.3, 6) AS final FROM pairs p LEFT JOIN m ON m.i = p.i AND m.j = p.j WHERE p.i % 5 = 0 AND p.j % 5 <> 0""")(
    lambda spark, d: nb.rerank(*split(spark, d)).select("i", "j", F.round("final", 6).alias("final")))
