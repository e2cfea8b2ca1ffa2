"""Queries of sources, names and identity labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions import names
from vicinity.operators import labels
from vicinity.plans.registry import FEAT, IDS, NAMES, query
from vicinity.sources import fixtures, readers
from vicinity.streaming.running import running


@query("s3_market_names", f"WITH {NAMES} SELECT idx, CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 1) AS INT) AS pid, CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 2) AS INT) AS cam FROM names")
def _(spark, d):
    pid, cam = names.market(F.col("name"))
    return fixtures.file_names(spark, d).select("idx", pid.alias("pid"), cam.alias("cam"))


@query("s4_augmented_names", f"WITH {FEAT} SELECT idx, pid, cam + 1 AS cam, CAST((cam + 2) % 6 + 1 AS INT) AS target_cam FROM feat")
def _(spark, d):
    f = fixtures.features(spark, d)
    name = F.concat(names.padded(F.col("pid")), F.lit("_c3s2_006893_03_"), (F.col("cam") + 1).cast("string"), F.lit("2"), ((F.col("cam") + 2) % 6 + 1).cast("string"), F.lit(".jpg"))
    pid, cam, target = names.augmented(name)
    return f.select("idx", pid.alias("pid"), cam.alias("cam"), target.alias("target_cam"))


@query("s5_underscore_names", f"WITH {FEAT} SELECT idx, pid, CAST(cam + 10 AS INT) AS cam FROM feat")
def _(spark, d):
    name = F.concat(names.padded(F.col("pid")), F.lit("_c"), (F.col("cam") + 10).cast("string"), F.lit("_f0044158.jpg"))
    pid, cam = names.underscore(name)
    return fixtures.features(spark, d).select("idx", pid.alias("pid"), cam.alias("cam"))


def _catalog(spark, d, name, relabel, junk=False):
    files = fixtures.file_names(spark, d)
    if junk:
        files = files.withColumn("name", F.when(F.col("idx") % 50 == 1, F.regexp_replace("name", r"^\d+", "-1")).otherwise(F.col("name")))
    return readers.catalog(files, readers.COLLECTIONS[name], relabel).select("idx", "name", "pid", "cam")


_CATALOG = f"WITH {NAMES} SELECT idx, name, CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 1) AS INT) AS pid, CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 2) AS INT) - 1 AS cam FROM names"
for _name, _key in (("market1501", "s6_market_catalog"), ("msmt17", "s7_msmt_catalog"), ("dukemtmc", "s8_duke_catalog"), ("sysu_all", "s9_sysu_catalog"), ("sysu_ir", "s9_sysu_ir_catalog"), ("sysu_rgb", "s9_sysu_rgb_catalog"), ("llcm_rgb", "s11_llcm_rgb_catalog")):
    query(_key, _CATALOG)(lambda spark, d, n=_name: _catalog(spark, d, n, False))
for _name, _key in (("regdb_ir", "s10_regdb_catalog"), ("regdb_rgb", "s10_regdb_rgb_catalog")):
    query(_key, _CATALOG.replace("FROM names", "FROM names WHERE regexp_extract(name, '_c(\\d)', 1) IN ('1', '2')"))(
        lambda spark, d, n=_name: readers.catalog(fixtures.file_names(spark, d).where(F.col("name").rlike("_c[12]")), readers.COLLECTIONS[n]).select("idx", "name", "pid", "cam"))
query("s11_llcm_ir_catalog", f"WITH {NAMES}, c AS (SELECT idx, name, CAST(regexp_extract(name, '^(\\d+)_c', 1) AS INT) AS pid, CAST(regexp_extract(name, '_c(\\d)', 1) AS INT) AS c FROM names) SELECT idx, name, pid, CAST(CASE WHEN c < 3 THEN c - 1 ELSE c - 2 END AS INT) AS cam FROM c WHERE c <> 3")(
    lambda spark, d: _catalog(spark, d, "llcm_ir", False))
query("p4_junk_dropped", _CATALOG + " WHERE idx % 50 <> 1")(lambda spark, d: _catalog(spark, d, "market1501", False, True))
query("p2_catalog_relabel", _CATALOG.replace("CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 1) AS INT) AS pid", "CAST(dense_rank() OVER (ORDER BY CAST(regexp_extract(name, '^(\\d+)_c(\\d+)', 1) AS INT)) - 1 AS INT) AS pid"))(
    lambda spark, d: _catalog(spark, d, "market1501", True))


@query("s14_index_file", "SELECT 'img/' || vec_id || '.jpg' AS path, label FROM embeddings")
def _(spark, d):
    lines = fixtures.table(spark, d, "embeddings").select(F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".jpg "), F.col("label").cast("string")).alias("value"))
    return readers.parse_index(lines)


query("s19_regdb_list", "SELECT 'visible/' || vec_id || '.bmp' AS path, label FROM embeddings")(
    lambda spark, d: readers.parse_index(fixtures.table(spark, d, "embeddings").select(F.concat(F.lit("visible/"), F.col("vec_id").cast("string"), F.lit(".bmp "), F.col("label").cast("string")).alias("value"))))


@query("s15_id_list", "SELECT DISTINCT label AS id, lpad(CAST(label AS VARCHAR), 4, '0') AS name FROM embeddings")
def _(spark, d):
    ids = fixtures.table(spark, d, "embeddings").agg(F.concat_ws(",", F.array_sort(F.collect_set("label")).cast("array<string>")).alias("value"))
    return readers.parse_id_list(ids)


_PATHS = "SELECT vec_id AS idx, '/cam' || (vec_id % 6 + 1) || '/' || lpad(CAST(label AS VARCHAR), 4, '0') || '/' || lpad(CAST(vec_id % 10000 AS VARCHAR), 4, '0') || '.jpg' AS path, label AS pid, CAST(vec_id % 6 + 1 AS INT) AS cam FROM embeddings"


@query("s16_sysu_query", f"SELECT * FROM ({_PATHS}) WHERE cam IN (3, 6) AND pid IN (SELECT DISTINCT label FROM embeddings WHERE label % 2 = 0)")
def _(spark, d):
    """All images of the listed identities from the infrared cameras."""
    paths = _paths(spark, d)
    wanted = fixtures.table(spark, d, "embeddings").where("label % 2 = 0").select(F.col("label").alias("pid")).distinct()
    return paths.where(F.col("cam").isin(3, 6)).join(wanted, "pid", "left_semi").select("idx", "path", "pid", "cam")


def _paths(spark, d):
    f = fixtures.features(spark, d)
    path = F.concat(F.lit("/cam"), (F.col("cam") + 1).cast("string"), F.lit("/"), names.padded(F.col("pid")), F.lit("/"), names.padded(F.col("idx") % 10000), F.lit(".jpg"))
    pid, cam = names.by_place(F.col("path"))
    return f.select("idx", path.alias("path")).withColumn("pid", pid).withColumn("cam", cam)


query("s18_llcm_query", f"SELECT * FROM ({_PATHS}) WHERE cam <= 3")(lambda spark, d: _paths(spark, d).where("cam <= 3"))
query("s2_sample_rows", f"WITH {NAMES}, f AS (SELECT idx, pid, cam FROM feat) SELECT names.idx, name AS path, pid, cam + 1 AS cam, -1 AS tcam FROM names JOIN f USING (idx) WHERE name LIKE '%.jpg'")(
    lambda spark, d: fixtures.file_names(spark, d).where(F.col("name").endswith(".jpg")).select("idx", F.col("name").alias("path"), names.market(F.col("name"))[0].alias("pid"), names.market(F.col("name"))[1].alias("cam"), F.lit(-1).alias("tcam")))
query("s13_splits", f"WITH {FEAT} SELECT idx, pid, cam, CASE WHEN idx % 5 = 0 THEN 'query' WHEN idx % 5 = 1 THEN 'gallery' ELSE 'train' END AS split FROM feat")(
    lambda spark, d: fixtures.features(spark, d).select("idx", "pid", "cam", F.when(F.col("idx") % 5 == 0, "query").when(F.col("idx") % 5 == 1, "gallery").otherwise("train").alias("split")))

query("p1_dense_relabel", f"WITH {FEAT} SELECT idx, CAST(dense_rank() OVER (ORDER BY pid * 7 % 11) - 1 AS INT) AS label FROM feat")(
    lambda spark, d: labels.dense_label(fixtures.features(spark, d).select("idx", (F.col("pid") * 7 % 11).alias("k")), "k", "label").select("idx", "label"))
query("p3_extended_ids", f"WITH {IDS} SELECT idx, pid, cam, intra_id, accum_id, img_idx FROM ids")(
    lambda spark, d: fixtures.identified(spark, d).select("idx", "pid", "cam", "intra_id", "accum_id", "img_idx"))
query("p6_noise_dropped", f"WITH {FEAT} SELECT idx, CAST(pid - 1 AS INT) AS p_label, cam FROM feat WHERE pid - 1 <> -1")(
    lambda spark, d: fixtures.features(spark, d).select("idx", (F.col("pid") - 1).alias("p_label"), "cam").where("p_label <> -1"))
query("p7_selected_labels", f"WITH {IDS} SELECT idx, accum_id, CAST(accum_id * 2 AS INT) AS prediction FROM ids WHERE accum_id % 3 = 0")(
    lambda spark, d: fixtures.identified(spark, d).join(fixtures.identified(spark, d).select("accum_id").distinct().where("accum_id % 3 = 0").withColumn("prediction", (F.col("accum_id") * 2).cast("int")), "accum_id").select("idx", "accum_id", "prediction"))
query("p8_split_by_camera", f"WITH {FEAT} SELECT cam, array_to_string(list(idx ORDER BY idx), ',') AS rows FROM feat GROUP BY cam")(
    lambda spark, d: fixtures.features(spark, d).groupBy("cam").agg(F.concat_ws(",", F.array_sort(F.collect_list("idx")).cast("array<string>")).alias("rows")))
query("p9_group_label_lookup", f"WITH {IDS} SELECT idx, CAST(accum_id // 2 AS INT) AS label FROM ids")(
    lambda spark, d: fixtures.identified(spark, d).join(fixtures.identified(spark, d).select("accum_id").distinct().withColumn("label", F.floor(F.col("accum_id") / 2).cast("int")), "accum_id").select("idx", "label"))
query("p17_camera_mask", f"WITH {IDS}, n AS (SELECT max(accum_id) AS m FROM ids), g AS (SELECT cam, list(DISTINCT accum_id) AS own FROM ids GROUP BY cam) SELECT cam, array_to_string(list_transform(range(0, CAST((SELECT m FROM n) AS BIGINT) + 1), lambda i: CAST(list_contains(own, CAST(i AS INT)) AS INT)), ',') AS mask FROM g")(
    lambda spark, d: labels.camera_mask(fixtures.identified(spark, d)).withColumn("mask", F.concat_ws(",", F.col("mask").cast("array<string>"))))
query("a1_dataset_stats", f"WITH {FEAT}, s AS (SELECT *, CASE WHEN idx % 5 = 0 THEN 'query' ELSE 'gallery' END AS split FROM feat) SELECT split, count(DISTINCT pid) AS num_pids, count(*) AS num_imgs, count(DISTINCT cam) AS num_cams FROM s GROUP BY split")(
    lambda spark, d: labels.catalog_stats(fixtures.features(spark, d).withColumn("split", F.when(F.col("idx") % 5 == 0, "query").otherwise("gallery"))))
query("a2_camera_counts", f"WITH {FEAT} SELECT cam, count(DISTINCT pid) AS id_count, count(*) AS img_count FROM feat GROUP BY cam")(
    lambda spark, d: labels.camera_counts(fixtures.features(spark, d)))
query("w12_id_prefix_sums", f"WITH {FEAT}, c AS (SELECT cam, count(DISTINCT pid) AS n FROM feat GROUP BY cam) SELECT cam, CAST(coalesce(sum(n) OVER (ORDER BY cam ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")(
    lambda spark, d: labels.camera_offsets(fixtures.features(spark, d).select("cam", "pid").distinct()))
query("c17_camera_proxies", f"WITH {FEAT}, k AS (SELECT idx, cam, CAST(pid - 1 AS INT) AS cluster FROM feat), p AS (SELECT cluster, cam, row_number() OVER (ORDER BY cluster, cam) - 1 AS proxy FROM (SELECT DISTINCT cluster, cam FROM k WHERE cluster >= 0)) SELECT k.idx, k.cluster, k.cam, CAST(coalesce(p.proxy, -1) AS INT) AS proxy FROM k LEFT JOIN p USING (cluster, cam)")(
    lambda spark, d: labels.camera_proxies(fixtures.features(spark, d).select("idx", "cam", (F.col("pid") - 1).alias("cluster"))).select("idx", "cluster", "cam", "proxy"))
query("a28_positions_by_identity", f"WITH {FEAT} SELECT pid, array_to_string(list(idx ORDER BY idx), ',') AS positions FROM feat GROUP BY pid")(
    lambda spark, d: fixtures.features(spark, d).groupBy("pid").agg(F.concat_ws(",", F.array_sort(F.collect_list("idx")).cast("array<string>")).alias("positions")))
query("p19_one_hot", f"WITH {FEAT} SELECT idx, array_to_string(list_transform(range(0, 10), lambda i: CAST(i = pid AS INT)), ',') AS one_hot FROM feat")(
    lambda spark, d: fixtures.features(spark, d).select("idx", F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("pid")).cast("int").cast("string"))).alias("one_hot")))
query("p20_positions_not_equal", f"WITH {FEAT}, g AS (SELECT pid, list(cam ORDER BY idx) AS cams FROM feat GROUP BY pid) SELECT pid, array_to_string(list_filter(range(0, len(cams)), lambda i: cams[i + 1] <> 3), ',') AS positions FROM g")(
    lambda spark, d: fixtures.features(spark, d).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "cam"))), lambda x: x["cam"]).alias("cams")).select("pid", F.concat_ws(",", F.transform("cams", lambda x, i: F.when(x != 3, i.cast("string")))).alias("positions")))
query("f13_whitespace_clean", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS text FROM documents")(
    lambda spark, d: fixtures.table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")).alias("text")))
query("f4_zero_pad", "SELECT DISTINCT label, lpad(CAST(label AS VARCHAR), 4, '0') AS padded FROM embeddings")(
    lambda spark, d: fixtures.table(spark, d, "embeddings").select("label", names.padded(F.col("label")).alias("padded")).distinct())


@query("e12_best_so_far", "WITH e AS (SELECT CAST(o_orderkey AS BIGINT) AS epoch, o_totalprice AS map FROM orders) SELECT epoch, map, max(map) OVER (ORDER BY epoch) AS best, map >= max(map) OVER (ORDER BY epoch) AS is_best FROM e")
def _(spark, d):
    epochs = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("map"))
    return running(epochs, "epoch", {"map": "max"}).select("epoch", "map", F.col("running_map").alias("best"), (F.col("map") >= F.col("running_map")).alias("is_best"))
