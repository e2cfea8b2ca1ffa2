"""Queries of group features, clustering and association."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions.vectors import normalize
from vicinity.operators import clustering as cl
from vicinity.operators import groups as gr
from vicinity.operators import neighbours as nb
from vicinity.operators.pairwise import close_pairs, distance_stats, pairs
from vicinity.plans.neighbours import PAIRS, _groups, _top, feats
from vicinity.plans.registry import FEAT, IDS, query
from vicinity.sources import fixtures

_DIMS = "range(1, 65) t(k)"


def exploded(df, *keys):
    """One row a dimension, rounded: what DuckDB's unnested vectors give."""
    return df.select(*keys, F.posexplode("v").alias("k", "x")).select(*keys, (F.col("k") + 1).cast("long").alias("k"), F.round("x", 6).alias("x"))


_MEAN = f"m AS (SELECT {{g}}, k, avg(v[k]) AS x FROM {{s}}, {_DIMS} GROUP BY {{g}}, k), c AS (SELECT {{g}}, list(x ORDER BY k) AS c FROM m GROUP BY {{g}})"
_OUT = "SELECT {g}, k, round({v}[k], 6) AS x FROM {s}, " + _DIMS

query("a3_centroids", f"WITH {FEAT}, {_MEAN.format(g='pid', s='feat')} {_OUT.format(g='pid', v='c', s='c')}")(lambda spark, d: exploded(gr.centroids(feats(spark, d), "pid"), "pid"))
query("a4_normalized_centroids", f"WITH {FEAT}, {_MEAN.format(g='pid', s='feat')} SELECT pid, k, round(c[k] / sqrt(list_dot_product(c, c)), 6) AS x FROM c, {_DIMS}")(lambda spark, d: exploded(gr.normalized_centroids(feats(spark, d), "pid"), "pid"))
query("a6_group_means", f"WITH {IDS}, {_MEAN.format(g='accum_id', s='ids')} {_OUT.format(g='accum_id', v='c', s='c')}")(lambda spark, d: exploded(gr.centroids(fixtures.identified(spark, d), "accum_id"), "accum_id"))
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda n: pow(v[n] - c[n], 2))))"
query("a7_barycentres", f"WITH {IDS}, {_MEAN.format(g='accum_id', s='ids')} SELECT accum_id, arg_min(idx, (dist, idx)) AS idx FROM (SELECT accum_id, idx, {_DIST} AS dist FROM ids JOIN c USING (accum_id)) GROUP BY accum_id")(
    lambda spark, d: gr.barycentres(fixtures.identified(spark, d), "accum_id").select("accum_id", "idx"))
query("a8_attention_means", f"WITH {IDS}, {_MEAN.format(g='accum_id', s='ids')}, w AS (SELECT accum_id, v, exp(-{_DIST}) AS w FROM ids JOIN c USING (accum_id)) SELECT accum_id, k, round(sum(v[k] * w) / (sum(w) + 1e-6), 6) AS x FROM w, {_DIMS} GROUP BY accum_id, k")(
    lambda spark, d: exploded(gr.attention_means(fixtures.identified(spark, d), "accum_id"), "accum_id"))
query("a9_ambiguous_groups", f"WITH {FEAT} SELECT pid, count(DISTINCT cam) AS cams, 1::BIGINT AS pids FROM feat GROUP BY pid HAVING count(DISTINCT cam) > 1")(
    lambda spark, d: gr.ambiguous_groups(feats(spark, d).withColumn("g", F.col("pid")), "g").select(F.col("g").alias("pid"), "cams", "pids"))
query("a10_centred_cameras", f"WITH {FEAT}, m AS (SELECT cam, k, avg(v[k]) AS x FROM feat, {_DIMS} GROUP BY cam, k), a AS (SELECT k, avg(x) AS y FROM m GROUP BY k) SELECT idx, k, round(v[k] - (x - y), 6) AS x FROM feat, {_DIMS} JOIN m USING (cam, k) JOIN a USING (k)".replace("FROM feat, range(1, 65) t(k) JOIN", "FROM (SELECT * FROM feat, range(1, 65) t(k)) JOIN"))(
    lambda spark, d: exploded(gr.centre_cameras(feats(spark, d)), "idx"))
query("a11_camera_gap", f"WITH {PAIRS} SELECT round(avg(d) FILTER (NOT same_cam) - avg(d) FILTER (same_cam), 6) AS gap FROM pairs WHERE i < j")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d)).where("i < j").agg(F.round(F.avg(F.when(~F.col("same_cam"), F.col("d"))) - F.avg(F.when(F.col("same_cam"), F.col("d"))), 6).alias("gap")))
_MNN = f"{PAIRS}{_top('top', 5, '0', 'NOT same_cam')}, mnn AS (SELECT a.i, a.j, a.d FROM top a JOIN top b ON a.i = b.j AND a.j = b.i)"


def mnn(spark, d, k=5):
    f = feats(spark, d)
    return nb.mutual(pairs(f, f, k=k, rule="cross").select("i", "j", "d", "same_pid"))


query("a19_a20_association_counters", f"WITH {_MNN} SELECT count(*) AS pairs, count(*) FILTER (a.pid = b.pid) AS correct, round(CAST(count(DISTINCT i) AS DOUBLE) / (SELECT count(*) FROM feat), 6) AS coverage FROM mnn JOIN feat a ON a.idx = i JOIN feat b ON b.idx = j")(
    lambda spark, d: mnn(spark, d).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("same_pid"), 1)).alias("correct"), F.countDistinct("i").alias("c")).crossJoin(feats(spark, d).agg(F.count("*").alias("n"))).select("pairs", "correct", F.round(F.col("c") / F.col("n"), 6).alias("coverage")))
query("a21_distance_stats", f"WITH {PAIRS} SELECT same_pid, round(avg(d), 6) AS mean_d, round(min(d), 6) AS min_d FROM pairs WHERE i < j GROUP BY same_pid")(
    lambda spark, d: distance_stats(feats(spark, d)).select("same_pid", F.round("mean_d", 6).alias("mean_d"), F.round("min_d", 6).alias("min_d")))
query("a22_camera_pairs", f"WITH {_MNN} SELECT least(a.cam, b.cam) AS cam_a, greatest(a.cam, b.cam) AS cam_b, count(*) AS n FROM mnn JOIN feat a ON a.idx = i JOIN feat b ON b.idx = j WHERE i < j GROUP BY ALL")(
    lambda spark, d: _camera_pairs(spark, d))


def _camera_pairs(spark, d):
    cam = lambda c: feats(spark, d).select(F.col("idx").alias(c), F.col("cam").alias(f"c{c}"))
    return mnn(spark, d).where("i < j").join(cam("i"), "i").join(cam("j"), "j").groupBy(F.least("ci", "cj").alias("cam_a"), F.greatest("ci", "cj").alias("cam_b")).agg(F.count("*").alias("n"))


query("a23_distance_histogram", f"WITH {PAIRS} SELECT CAST(least(floor(d / 4.0 * 50), 49) + 1 AS BIGINT) AS bin, count(*) AS n FROM pairs WHERE i < j GROUP BY 1")(
    lambda spark, d: pairs(feats(spark, d), feats(spark, d)).where("i < j").groupBy(F.least(F.expr("width_bucket(d, 0, 4, 50)"), F.lit(50)).cast("long").alias("bin")).agg(F.count("*").alias("n")))
query("a24_a25_percentile_deviation", f"WITH {PAIRS} SELECT round(quantile_cont(d, 0.05), 6) AS p5, round(stddev_pop(d), 6) AS sigma FROM pairs WHERE NOT same_cam AND i < j")(
    lambda spark, d: spark.createDataFrame([cl.percentile_deviation(feats(spark, d))], "p5 double, sigma double").select(F.round("p5", 6).alias("p5"), F.round("sigma", 6).alias("sigma")))
query("f8_c9_affinity_graph", f"WITH {PAIRS}, e AS (SELECT * FROM pairs WHERE NOT same_cam AND i < j), s AS (SELECT quantile_cont(d, 0.05) AS l, stddev_pop(d) AS sg FROM e) SELECT i, j, round(exp(-d / (sg + 1e-6)), 6) AS affinity FROM e, s WHERE d < l")(
    lambda spark, d: cl.affinity_graph(feats(spark, d)).select("i", "j", F.round("affinity", 6).alias("affinity")))
query("c9_power_iteration")(lambda spark, d: cl.power_iteration_clusters(cl.packed_affinity_graph(feats(spark, d)), 10))

_REACH = ", recursive_edges AS (SELECT i, j FROM {e} UNION SELECT j, i FROM {e})"


def _components_sql(ctes: str, edges: str, nodes: str) -> str:
    """Component roots by a recursive reachability query."""
    return f"WITH RECURSIVE {ctes}{_REACH.format(e=edges)}, reach AS (SELECT idx AS i, idx AS j FROM {nodes} UNION SELECT r.i, e.j FROM reach r JOIN recursive_edges e ON e.i = r.j), root AS (SELECT i AS idx, min(j) AS root, count(*) AS size FROM reach GROUP BY i)"


query("c16_connected_components", _components_sql(_MNN.replace("rk <= 5", "rk <= 2"), "mnn", "feat") + " SELECT idx, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM root")(
    lambda spark, d: cl.component_labels(feats(spark, d), mnn(spark, d, 2).select(F.col("i").alias("a"), F.col("j").alias("b")), None))
query("c6_mutual_propagation", _components_sql(_MNN.replace("rk <= 5", "rk <= 1"), "mnn", "feat") + ", l AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM (SELECT DISTINCT root FROM root WHERE size > 1)) SELECT idx, coalesce(label, -1) AS label FROM root LEFT JOIN l ON l.root = root.root AND size > 1")(
    lambda spark, d: cl.component_labels(feats(spark, d), mnn(spark, d, 1).select(F.col("i").alias("a"), F.col("j").alias("b")), -1))
_EPS, _MIN = 1.35, 4
_DBSCAN = f"{PAIRS}, close AS (SELECT i, j FROM pairs WHERE d <= {_EPS}), core AS (SELECT i AS idx FROM close GROUP BY i HAVING count(*) >= {_MIN}), ce AS (SELECT i, j FROM close WHERE i IN (SELECT idx FROM core) AND j IN (SELECT idx FROM core))"
query("c1_dbscan", _components_sql(_DBSCAN, "ce", "core") + ", l AS (SELECT idx, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM root), b AS (SELECT i AS idx, min(label) AS border FROM close JOIN l ON l.idx = j GROUP BY i) SELECT f.idx, CAST(coalesce(l.label, b.border, -1) AS INT) AS label FROM feat f LEFT JOIN l USING (idx) LEFT JOIN b USING (idx)")(
    lambda spark, d: cl.dbscan(feats(spark, d), pairs(feats(spark, d), feats(spark, d)).where(F.col("d") <= _EPS).select("i", "j"), _MIN))


@query("c1_pseudo_labels")
def _(spark, d):
    """Density clusters (eps 0.6, 4) of structured Jaccard distances: a training epoch's pseudo-labels."""
    f = feats(spark, d)
    return cl.dbscan(f, nb.structured_jaccard(f).where("jaccard <= 0.6").select("i", "j"), 4)


@query("c4_multi_step")
def _(spark, d):
    f = feats(spark, d)
    return cl.multi_step(f, mnn(spark, d, 2).select(F.col("i").alias("a"), F.col("j").alias("b")), close_pairs(f, f, 1.2).select("i", "j"))


ASSOCIATE_RATE = 1.7


def _most(spark, d) -> int:
    """How many associations the reference allows: a rate of the number of (camera, identity) groups."""
    return int(ASSOCIATE_RATE * feats(spark, d).select("cam", "pid").distinct().count())


def _cross(spark, d, n):
    """The ``n`` nearest pairs over cameras, with cameras."""
    f = feats(spark, d)
    cam = lambda c: f.select(F.col("idx").alias(c), F.col("cam").alias(f"cam_{c}"))
    return pairs(f, f, rule="cross").where("i < j").orderBy("d", "i", "j").limit(n).join(cam("i"), "i").join(cam("j"), "j")


@query("c2_camera_exclusive")
def _(spark, d):
    return cl.component_labels(feats(spark, d), cl.camera_exclusive_edges(_cross(spark, d, _most(spark, d))), -1)


@query("c3_camera_exclusive_diagnostics")
def _(spark, d):
    """c2 with its clusters' count, coverage and adjusted Rand index."""
    from vicinity.operators.evaluation import adjusted_rand

    labels = cl.cut(cl.component_labels(feats(spark, d), cl.camera_exclusive_edges(_cross(spark, d, _most(spark, d))), -1))
    joined = labels.join(feats(spark, d).select("idx", "pid"), "idx").where("label <> -1")
    stats = labels.agg(F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("clusters"), F.avg((F.col("label") != -1).cast("double")).alias("coverage"))
    return stats.crossJoin(adjusted_rand(joined, "pid", "label"))


@query("c7_absorb_repel")
def _(spark, d):
    means = gr.centroids(fixtures.identified(spark, d), "accum_id")
    cams = fixtures.identified(spark, d).select("accum_id", "cam").distinct()
    groups = means.join(cams, "accum_id").select(F.col("accum_id").alias("idx"), "cam", normalize(F.col("v")).alias("v"))
    groups = cl.cut(groups)
    every = cl.cut(pairs(groups, groups, metric="dot").select("i", "j", F.col("d").alias("s"), "same_cam").where("s >= 0.2"))
    return cl.absorb_and_repel(every.where("not same_cam").select("i", "j", "s"), groups, absorb=0.35, close=every.where("s >= 0.6").select("i", "j"))


@query("c8_propagated_labels")
def _(spark, d):
    f = feats(spark, d)
    near = pairs(f, f, k=6).where("i <> j and not same_cam")  # of a vector's five nearest those of other cameras
    return cl.propagate_known(near, f.select("idx", F.when(F.col("idx") % 3 == 0, -1).otherwise(F.col("pid")).alias("label")), limit=1.3, k=6)


@query("c12_group_agglomeration")
def _(spark, d):
    return cl.agglomerate_groups(_groups(feats(spark, d)), 1.1)


@query("c13_c14_constrained_unions")
def _(spark, d):
    f = feats(spark, d)
    near = pairs(f, f, k=30, rule="cross").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d").alias("d"))
    return cl.constrained_unions(near, f, max_unions=_most(spark, d))


@query("c11_c15_association")
def _(spark, d):
    """Group features by attention, Jaccard distances of reciprocal neighbours, constrained unions, labels back to rows."""
    ids = cl.cut(fixtures.identified(spark, d).select("idx", "pid", "cam", "accum_id", "v"))
    groups = gr.attention_means(ids, "accum_id").join(ids.select("accum_id", "cam").distinct(), "accum_id")
    groups = cl.cut(groups.select(F.col("accum_id").cast("long").alias("idx"), "cam", normalize(F.col("v")).alias("v")))
    cam = lambda c: groups.select(F.col("idx").alias(c), F.col("cam").alias(f"c{c}"))
    near = nb.reciprocal_jaccard(groups, k1=10, k2=3).join(cam("i"), "i").join(cam("j"), "j").where("ci <> cj and i < j")
    found = cl.constrained_unions(near.select("i", "j", F.col("jaccard").alias("d")), groups, max_unions=_most(spark, d))
    return ids.join(found.withColumnRenamed("idx", "accum_id"), "accum_id").select("idx", "label")
