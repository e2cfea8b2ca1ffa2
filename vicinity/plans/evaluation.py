"""Queries of retrieval and clustering metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators import evaluation as ev
from vicinity.operators.pairwise import pairs
from vicinity.plans.neighbours import DOT, SPLIT, split
from vicinity.plans.registry import FEAT, query
from vicinity.sources import fixtures

_RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk, sum(CAST(hit AS INT)) OVER (PARTITION BY i ORDER BY d, j ROWS UNBOUNDED PRECEDING) AS n FROM p)"
_ROUND = lambda df: df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def _e1(junk_rows: bool) -> str:
    pid = "CASE WHEN b.idx % 50 = 1 THEN -1 ELSE b.pid END" if junk_rows else "b.pid"
    return f"""{SPLIT}, p AS (SELECT a.idx AS i, b.idx AS j, -{DOT} AS d, a.pid = {pid} AS hit FROM q a, g b WHERE NOT (a.pid = {pid} AND a.cam = b.cam) AND {pid} <> -1){_RANKED},
s AS (SELECT i, avg(CASE WHEN hit THEN CAST(n AS DOUBLE) / rk END) AS ap, min(CASE WHEN hit THEN rk END) AS first FROM r GROUP BY i), t AS (SELECT q.idx, ap, first FROM q LEFT JOIN s ON s.i = q.idx)
SELECT round(avg(coalesce(ap, 0.0)), 6) AS "mAP", {', '.join(f'round(avg(CAST(coalesce(first <= {r}, false) AS DOUBLE)), 6) AS "R{r}"' for r in (1, 5, 10, 20))} FROM t"""


@query("e1_map_cmc", _e1(False))
def e1(spark, d):
    return _ROUND(ev.map_cmc(*split(spark, d)))


@query("e1_map_cmc_with_junk", _e1(True))
def _(spark, d):
    q, g = split(spark, d)
    return _ROUND(ev.map_cmc(q, g.withColumn("pid", F.when(F.col("idx") % 50 == 1, -1).otherwise(F.col("pid")))))


def _cmc(junk: str, gain: str, where: str) -> str:
    return f"""{SPLIT}, p AS (SELECT a.idx AS i, b.idx AS j, greatest(0.0, 2 - 2 * {DOT}) AS d, a.pid = b.pid AS hit FROM q a, g b WHERE NOT ({junk})){_RANKED},
h AS (SELECT *, count(*) OVER (PARTITION BY i) AS m FROM r WHERE hit), s AS (SELECT {gain} FROM h WHERE {where}), k AS (SELECT count(DISTINCT i) AS used FROM h),
e AS (SELECT range AS place, coalesce((SELECT sum(gain) FROM s WHERE s.place = range), 0.0) AS gain FROM range(100))
SELECT place + 1 AS rank, round(sum(gain) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) / (SELECT used FROM k), 6) AS cmc FROM e"""


query("e2_cmc", _cmc("a.pid = b.pid AND a.cam = b.cam", "rk - n AS place, 1.0::DOUBLE / m AS gain", "true"))(lambda spark, d: ev.cmc(*split(spark, d)).select("rank", F.round("cmc", 6).alias("cmc")))
query("e2_cmc_first_match", _cmc("a.pid = b.pid AND a.cam = b.cam", "rk - 1 AS place, 1.0::DOUBLE AS gain", "n = 1"))(lambda spark, d: ev.cmc(*split(spark, d), first_match_break=True).select("rank", F.round("cmc", 6).alias("cmc")))
query("e2_cmc_separate_cameras", _cmc("a.cam = b.cam", "rk - n AS place, 1.0::DOUBLE / m AS gain", "true"))(lambda spark, d: ev.cmc(*split(spark, d), separate_camera_set=True).select("rank", F.round("cmc", 6).alias("cmc")))


def _e4(d: str) -> str:
    return f"""{SPLIT}, p AS (SELECT a.idx AS i, b.idx AS j, {d} AS d, a.pid = b.pid AS hit FROM q a, g b WHERE NOT (a.pid = b.pid AND a.cam = b.cam)),
s AS (SELECT i, d, count(*) AS c, sum(CAST(hit AS INT)) AS h FROM p GROUP BY i, d),
t AS (SELECT *, CAST(sum(h) OVER w AS DOUBLE) / sum(c) OVER w AS pr, sum(h) OVER (PARTITION BY i) AS total FROM s WINDOW w AS (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING))"""


_E4 = " SELECT i, round(sum(pr * h / total), 6) AS ap FROM t WHERE total > 0 GROUP BY i"


def _hits(spark, d, distance):
    q, g = split(spark, d)
    return pairs(q, g).where("not (same_cam and same_pid)").select("i", "j", distance.alias("d"), F.col("same_pid").alias("hit"))


query("e4_mean_ap", _e4(f"greatest(0.0, 2 - 2 * {DOT})") + _E4)(lambda spark, d: ev.average_precision(*split(spark, d)).select("i", F.round("ap", 6).alias("ap")))
query("e4_mean_ap_tied", _e4(f"floor(greatest(0.0, 2 - 2 * {DOT}) * 10)") + _E4)(lambda spark, d: ev.mean_ap(_hits(spark, d, F.floor(F.col("d") * 10))).select("i", F.round("ap", 6).alias("ap")))
query("e5_evaluate_all", _e4(f"greatest(0.0, 2 - 2 * {DOT})") + ", u AS (SELECT i, sum(pr * h / total) AS ap FROM t WHERE total > 0 GROUP BY i) SELECT round(avg(ap), 6) AS \"mAP\" FROM u")(lambda spark, d: ev.average_precision(*split(spark, d)).agg(F.round(F.avg("ap"), 6).alias("mAP")))


def _cross(junk: str, dedup: bool) -> str:
    first = "(SELECT i, place AS first FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY rk) AS place FROM (SELECT i, pi, pj, min(rk) AS rk FROM r GROUP BY ALL)) WHERE pi = pj)" if dedup else "(SELECT i, min(rk) AS first FROM r WHERE hit GROUP BY i)"
    return f"""{SPLIT}, p AS (SELECT a.idx AS i, b.idx AS j, a.pid AS pi, b.pid AS pj, greatest(0.0, 2 - 2 * {DOT}) AS d, a.pid = b.pid AS hit FROM q a, g b WHERE NOT ({junk})){_RANKED},
s AS (SELECT i, avg(CASE WHEN hit THEN CAST(n AS DOUBLE) / rk END) AS ap, CAST(max(n) AS DOUBLE) / max(CASE WHEN hit THEN rk END) AS inp FROM r GROUP BY i), f AS {first}
SELECT round(avg(ap), 6) AS "mAP", round(avg(inp), 6) AS "mINP", {', '.join(f'round(avg(CAST(first <= {k} AS DOUBLE)), 6) AS "R{k}"' for k in (1, 5, 10, 20))} FROM s JOIN f USING (i) WHERE ap IS NOT NULL"""


for _name, _sql, _junk, _dedup in (
    ("e6_llcm_w10_w11", "a.pid = b.pid AND a.cam = b.cam", "pid_i = pid_j and cam_i = cam_j", True),
    ("e7_sysu", "a.cam = 3 AND b.cam = 2", "cam_i = 3 and cam_j = 2", True),
    ("e8_regdb", "false", "false", False),
):
    query(_name, _cross(_sql, _dedup))(lambda spark, d, j=_junk, u=_dedup: _ROUND(ev.cross_modality(*split(spark, d), junk=j, deduplicate=u)))

_LAB = f"WITH {FEAT}, l AS (SELECT idx, pid, CAST((pid * 3 + idx % 4) % 7 - 1 AS INT) AS c FROM feat{{}})"
_ARI = ", k AS (SELECT pid, c, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM k GROUP BY pid)), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM k GROUP BY c)), s AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM k) SELECT round((s.x - a.x * b.x / (t * (t - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (t * (t - 1) / 2)), 6) AS ari FROM s, a, b"
_NMI = ", k AS (SELECT pid, c, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY ALL), t AS (SELECT sum(n) AS t FROM k), a AS (SELECT pid, sum(n) AS n FROM k GROUP BY pid), b AS (SELECT c, sum(n) AS n FROM k GROUP BY c), m AS (SELECT sum(k.n / t * ln(k.n * t / (a.n * b.n))) AS mi FROM k JOIN a USING (pid) JOIN b USING (c), t), ha AS (SELECT -sum(n / t * ln(n / t)) AS h FROM a, t), hb AS (SELECT -sum(n / t * ln(n / t)) AS h FROM b, t) SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM m, ha, hb"


def _labelled(spark, d):
    return fixtures.features(spark, d).select("idx", "pid", ((F.col("pid") * 3 + F.col("idx") % 4) % 7 - 1).cast("int").alias("c"))


query("e9_adjusted_rand", _LAB.format("") + _ARI)(lambda spark, d: _ROUND(ev.adjusted_rand(_labelled(spark, d), "pid", "c")))
query("e9_adjusted_rand_without_noise", (_LAB.format("") + _ARI).replace("FROM l GROUP", "FROM l WHERE c <> -1 GROUP"))(lambda spark, d: _ROUND(ev.adjusted_rand(_labelled(spark, d).where("c <> -1"), "pid", "c")))
query("e10_mutual_information", _LAB.format("") + _NMI)(lambda spark, d: _ROUND(ev.normalized_mutual_information(_labelled(spark, d), "pid", "c")))
query("e11_cluster_count", _LAB.format("") + " SELECT count(DISTINCT c) AS clusters FROM l WHERE c <> -1")(lambda spark, d: _labelled(spark, d).where("c <> -1").agg(F.countDistinct("c").alias("clusters")))
query("a18_pure_clusters", _LAB.format("") + ", g AS (SELECT c, count(DISTINCT pid) AS k FROM l WHERE c <> -1 GROUP BY c) SELECT count(*) AS clusters, count(*) FILTER (k = 1) AS pure FROM g")(
    lambda spark, d: _labelled(spark, d).where("c <> -1").groupBy("c").agg(F.countDistinct("pid").alias("k")).agg(F.count("*").alias("clusters"), F.count(F.when(F.col("k") == 1, 1)).alias("pure")))


@query("a27_top_k_accuracy", f"{SPLIT}, c AS (SELECT pid, list(x ORDER BY k) AS m FROM (SELECT pid, k, avg(v[k]) AS x FROM g, range(1, 65) t(k) GROUP BY pid, k) GROUP BY pid), s AS (SELECT a.idx, a.pid = c.pid AS hit, row_number() OVER (PARTITION BY a.idx ORDER BY list_dot_product(a.v, c.m) DESC, c.pid) AS rk FROM q a, c) SELECT round(avg(CAST(rk <= 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(rk <= 5 AS DOUBLE)), 6) AS top5 FROM s WHERE hit")
def _(spark, d):
    """Share of rows whose own class is among the first k by centroid score."""
    from vicinity.functions.vectors import dot
    from vicinity.operators.groups import centroids

    q, g = split(spark, d)
    scores = q.crossJoin(centroids(g, "pid").select(F.col("pid").alias("c"), F.col("v").alias("m"))).withColumn("s", dot(F.col("v"), F.col("m")))
    rk = scores.withColumn("rk", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("s").desc(), "c"))).where("pid = c")
    return rk.agg(*[F.round(F.avg((F.col("rk") <= k).cast("double")), 6).alias(f"top{k}") for k in (1, 5)])
