"""Queries of samplers. Draws follow a hash, so SQL elsewhere can't repeat them: these are checked by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions import schedules
from vicinity.operators import sampling as sa
from vicinity.operators.evaluation import cmc
from vicinity.plans.identity import _paths
from vicinity.plans.neighbours import feats, split
from vicinity.plans.registry import query
from vicinity.sources import fixtures

query("s17_sysu_gallery")(lambda spark, d: sa.one_of_each(_paths(spark, d).where("cam in (1, 2, 4, 5)"), ["pid", "cam"], "idx", 0))
query("s17_sysu_indoor_gallery")(lambda spark, d: sa.one_of_each(_paths(spark, d).where("cam in (1, 2)"), ["pid", "cam"], "idx", 0))
query("s18_llcm_gallery")(lambda spark, d: sa.one_of_each(_paths(spark, d).where("cam > 3"), ["pid", "cam"], "idx", 1))
query("a5_cluster_instances")(lambda spark, d: sa.k_of_each(feats(spark, d).select("idx", "pid"), "pid", 16, 2))
query("b1_class_uniform")(lambda spark, d: sa.k_of_each(fixtures.identified(spark, d).select("idx", "accum_id"), "accum_id", 16, 3))
query("b2_identity_sampler")(lambda spark, d: sa.k_of_each(feats(spark, d).select("idx", "pid"), "pid", 4, 4))
query("b3_b9_camera_diverse")(lambda spark, d: sa.diverse_instances(feats(spark, d).where("pid <> -1").select("idx", "pid", "cam"), 4, 5))
query("b4_instances")(lambda spark, d: sa.diverse_instances(feats(spark, d).select("idx", "pid", "cam"), 4, 6, by_camera=False))
query("b5_pk_batches")(lambda spark, d: sa.pk_chunks(feats(spark, d).select("idx", "pid"), 4, 4, 7).select(F.col("batch.chunk").alias("chunk"), F.col("batch._b").alias("batch"), "pid", "idx"))
query("b6_j19_cross_modality_pairs")(lambda spark, d: sa.paired(feats(spark, d).where("cam < 3").select("idx", "pid"), feats(spark, d).where("cam >= 3").select("idx", "pid"), 4, 8))
query("f11_noisy_rate")(lambda spark, d: spark.range(60).select(F.col("id").alias("epoch"), sa.jittered(schedules.multi_step(F.col("id"), 3.5e-4, [20, 40]), 9, 0.9, 1.1, "id").alias("lr")))


@query("e3_single_shot_cmc")
def _(spark, d):
    """CMC with one gallery row an identity and camera, drawn by hash."""
    q, g = split(spark, d)
    return cmc(q, sa.one_of_each(g, ["pid", "cam"], "idx", 10), topk=20)
