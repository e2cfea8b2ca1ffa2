"""Queries of keyed memories, losses, pooling and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions import pixels, schedules
from vicinity.functions import vectors as vec
from vicinity.operators import losses as lo
from vicinity.operators import memory as me
from vicinity.operators.groups import normalized_centroids, vector_mean
from vicinity.operators.pairwise import pairs
from vicinity.plans.association import _DIMS, exploded
from vicinity.plans.neighbours import DOT, feats
from vicinity.plans.registry import FEAT, query
from vicinity.sources import fixtures
from vicinity.streaming.running import running, running_averages

BANK = f"{FEAT}, cm AS (SELECT pid AS key, k, avg(v[k]) AS x FROM feat, {_DIMS} GROUP BY pid, k), c0 AS (SELECT key, list(x ORDER BY k) AS c FROM cm GROUP BY key), bank AS (SELECT key, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS m FROM c0), batch AS (SELECT pid AS key, idx, v FROM feat), sc AS (SELECT b.*, bank.m, list_dot_product(b.v, m) AS s FROM batch b JOIN bank USING (key))"
_MV = "(SELECT bank.key, CASE WHEN ch.v IS NULL THEN m ELSE list_transform(range(1, 65), lambda n: m[n] * 0.2 + ch.v[n] * 0.8) END AS u FROM bank LEFT JOIN {ch} ch USING (key))"
_UNIT = "(SELECT key, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS m FROM {mv})"
_MOVE = "mv AS (SELECT bank.key, CASE WHEN ch.v IS NULL THEN m ELSE list_transform(range(1, 65), lambda n: m[n] * 0.2 + ch.v[n] * 0.8) END AS u, ch.v IS NULL AS still FROM bank LEFT JOIN ch USING (key)) SELECT key, k, round(CASE WHEN still THEN u[k] ELSE u[k] / sqrt(list_dot_product(u, u)) END, 6) AS x FROM mv, " + _DIMS


def bank_and_batch(spark, d):
    f = feats(spark, d)
    bank = normalized_centroids(f, "pid").select(F.col("pid").alias("key"), F.col("v").alias("m"))
    return bank, f.select(F.col("pid").alias("key"), "idx", "v")


def _out(bank):
    return exploded(bank.withColumnRenamed("m", "v"), "key")


query("m1_update_each")(lambda spark, d: _out(me.update_each(*bank_and_batch(spark, d))))
_MEANS = f"bm AS (SELECT key, k, avg(v[k]) AS x FROM batch, {_DIMS} GROUP BY key, k), ch AS (SELECT key, list(x ORDER BY k) AS v FROM bm GROUP BY key)"
query("m2_update_mean", f"WITH {BANK}, {_MEANS}, {_MOVE}")(lambda spark, d: _out(me.update_mean(*bank_and_batch(spark, d))))
query("m3_update_hardest", f"WITH {BANK}, ch AS (SELECT key, arg_min(v, (s, idx)) AS v FROM sc GROUP BY key), {_MOVE}")(lambda spark, d: _out(me.update_hardest(*bank_and_batch(spark, d))))
query("m4_update_easiest", f"WITH {BANK}, ch AS (SELECT key, arg_max(v, (s, -idx)) AS v FROM sc GROUP BY key), {_MOVE}")(lambda spark, d: _out(me.update_easiest(*bank_and_batch(spark, d))))
query("m5_update_weighted", f"WITH {BANK}, bm AS (SELECT key, k, sum(v[k] * exp(-s / 0.09)) / sum(exp(-s / 0.09)) AS x FROM sc, {_DIMS} GROUP BY key, k), ch AS (SELECT key, list(x ORDER BY k) AS v FROM bm GROUP BY key), {_MOVE}")(lambda spark, d: _out(me.update_weighted(*bank_and_batch(spark, d))))
_HARD_CH = "hch AS (SELECT key, arg_min(v, (s, idx)) AS v FROM sc GROUP BY key)"
_BOTH = f"{_MEANS}, {_HARD_CH}, mean_mv AS {_MV.format(ch='ch')}, hard_mv AS {_MV.format(ch='hch')}, mean_bank AS {_UNIT.format(mv='mean_mv')}, hard_bank AS {_UNIT.format(mv='hard_mv')}"


@query("m6_update_hybrid", f"WITH {BANK}, {_BOTH}, st AS (SELECT 'mean, hard' AS banks, 0 AS place, * FROM mean_bank UNION ALL SELECT 'mean, hard', 1, * FROM hard_bank UNION ALL SELECT 'hard, mean', 0, * FROM hard_bank UNION ALL SELECT 'hard, mean', 1, * FROM mean_bank) SELECT banks, place, key, k, round(m[k], 6) AS x FROM st, {_DIMS}")
def _(spark, d):
    """Both orders in which the two banks are stacked."""
    hybrid = me.update_hybrid(*bank_and_batch(spark, d))
    both = [me.stacked(hybrid, order).select(F.lit(", ".join(order)).alias("banks"), "place", "key", F.col("m").alias("v")) for order in (("mean", "hard"), ("hard", "mean"))]
    return exploded(both[0].union(both[1]), "banks", "place", "key")


query("m7_scores", f"WITH {BANK} SELECT idx, bank.key, batch.key AS label, round(list_dot_product(v, m), 6) AS z FROM batch, bank")(
    lambda spark, d: me.scores(*bank_and_batch(spark, d)).select("idx", "key", "label", F.round("z", 6).alias("z")))
_CE = f"WITH {BANK}, z AS (SELECT idx, bank.key, batch.key AS label, list_dot_product(v, m) / {{t}} AS z FROM batch, bank), t AS (SELECT idx, max(z) AS top, max(z) FILTER (key = label) AS own FROM z GROUP BY idx), l AS (SELECT z.idx, top + ln(sum(exp(z - top))) - own AS loss FROM z JOIN t USING (idx) GROUP BY z.idx, top, own)"
_INSTANCES = f"inst AS (SELECT key, rn AS slot, v AS m FROM (SELECT pid AS key, v, row_number() OVER (PARTITION BY pid ORDER BY idx) AS rn FROM feat) WHERE rn <= 4), slots AS (SELECT key, 0 AS slot, m FROM bank UNION ALL SELECT * FROM inst), zs AS MATERIALIZED (SELECT idx, slots.key, slot, batch.key AS label, list_dot_product(v, m) / 0.05 AS z FROM batch, slots), cl AS (SELECT idx, ln(sum(exp(z - 20))) + 20 - max(z) FILTER (key = label AND slot = 0) AS centroid FROM zs GROUP BY idx), lg AS (SELECT idx, key, label, CASE WHEN key = label THEN min(z) ELSE max(z) END AS z FROM zs WHERE slot > 0 GROUP BY idx, key, label), il AS (SELECT idx, ln(sum(exp(z - 20))) + 20 - max(z) FILTER (key = label) AS instance FROM lg GROUP BY idx)"


@query("m8_memory_loss", _CE.format(t="0.05") + f", {_INSTANCES} SELECT idx, round(loss, 6) AS loss, round(centroid, 6) AS centroid, round(instance, 6) AS instance FROM l JOIN cl USING (idx) JOIN il USING (idx)")
def _(spark, d):
    """The hard bank's loss, and the two of the bank with instances."""
    bank, batch = bank_and_batch(spark, d)
    hard = me.cross_entropy(me.scores(bank, batch, 0.05))
    both = me.instance_losses(me.instance_bank(bank, batch, 4), batch, 0.05)
    return hard.join(both, "idx").select("idx", *[F.round(c, 6).alias(c) for c in ("loss", "centroid", "instance")])


_BANK_CE = "(SELECT avg(top + ln(s) - own) FROM (SELECT idx, max(z) AS top, max(z) FILTER (key = label) AS own, sum(exp(z - 20)) * exp(20 - max(z)) AS s FROM (SELECT idx, b.key, batch.key AS label, list_dot_product(v, m) / 0.05 AS z FROM batch, {bank} b) GROUP BY idx))"


@query("m9_centre_loss", f"WITH {BANK}, {_BOTH} SELECT round(0.5 * ({_BANK_CE.format(bank='hard_bank')} + greatest(0.0, {_BANK_CE.format(bank='mean_bank')} - 0.2)), 6) AS loss")
def _(spark, d):
    """Of the banks after the batch has moved them."""
    bank, batch = bank_and_batch(spark, d)
    return me.centre_loss(me.update_hybrid(bank, batch), batch).select(F.round("loss", 6).alias("loss"))


@query("m10_model_average", f"WITH {BANK}, {_BOTH} SELECT bank.key, k, round(bank.m[k] * 0.999 + s.m[k] * (1 - 0.999), 6) AS x FROM bank JOIN hard_bank s USING (key), {_DIMS}")
def _(spark, d):
    """The bank as teacher of parameters, the bank moved by the hardest vectors as student."""
    bank, batch = bank_and_batch(spark, d)
    return _out(me.model_average(bank, me.update_hardest(bank, batch)))


@query("a26_running_average", "SELECT o_orderkey, round(sum(o_totalprice * (o_orderkey % 5 + 1)) OVER w / sum(o_orderkey % 5 + 1) OVER w, 4) AS avg FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    weight = (F.col("o_orderkey") % 5 + 1).cast("double")
    orders = fixtures.table(spark, d, "orders").select("o_orderkey", weight.alias("w"), (F.col("o_totalprice") * weight).alias("s"))
    rows = running(orders, "o_orderkey", {"s": "sum", "w": "sum"})
    return rows.select("o_orderkey", F.round(F.col("running_s") / F.col("running_w"), 4).alias("avg"))


FOUND = f"{FEAT}, f AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, sqrt(greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * {DOT}, 1e-12)) AS d, {DOT} AS z, a.pid = b.pid AS same, a.cam = b.cam AS same_cam FROM feat a, feat b)"


def found(spark, d):
    f = feats(spark, d)
    size = lambda c: f.select(F.col("idx").alias(c), vec.dot(F.col("v"), F.col("v")).alias(f"size_{c}"))
    dots = pairs(f, f, metric="dot").select("i", "j", F.col("d").alias("z"), F.col("same_pid").alias("same"), "same_cam")
    squared = F.greatest(F.col("size_i") + F.col("size_j") - 2 * F.col("z"), F.lit(1e-12))
    return dots.join(size("i"), "i").join(size("j"), "j").select("i", "j", "z", "same", "same_cam", F.sqrt(squared).alias("d"))


_HARD = ", h AS (SELECT i, min(z) FILTER (same) AS sp, max(z) FILTER (NOT same) AS sn, max(d) FILTER (same) AS hp, min(d) FILTER (NOT same) AS hn, arg_max(j, (d, -j)) FILTER (same) AS jp, arg_min(j, (d, j)) FILTER (NOT same) AS jn FROM f GROUP BY i)"
_L = lambda df: df.select(F.round("loss", 6).alias("loss"))
@query("w13_hardest_pairs", f"WITH {FOUND}{_HARD} SELECT i, round(hp, 6) AS hp, round(hn, 6) AS hn, jp, jn, round(sp, 6) AS sp, round(sn, 6) AS sn FROM h")
def _(spark, d):
    """By distance, and by similarity (larger is closer)."""
    f = found(spark, d)
    by = lo.hardest(f, "z", larger=True).select("i", F.round("hp", 6).alias("sp"), F.round("hn", 6).alias("sn"))
    return lo.hardest(f).select("i", F.round("hp", 6).alias("hp"), F.round("hn", 6).alias("hn"), "jp", "jn").join(by, "i")


@query("l1_triplet", f"WITH {FOUND}{_HARD} SELECT round(avg(greatest(0.0, hp - hn + 0.3)), 6) AS loss, round(avg(greatest(0.0, sn - sp + 0.3)), 6) AS cosine FROM h")
def _(spark, d):
    f = found(spark, d)
    return _L(lo.triplet(f)).crossJoin(lo.triplet(f, d="z", larger=True).select(F.round("loss", 6).alias("cosine")))


query("l2_soft_triplet", f"WITH {FOUND}{_HARD} SELECT round(avg(ln(1 + exp(hp * 1.1 - hn * 0.9))), 6) AS loss FROM h")(lambda spark, d: _L(lo.vector_triplet(feats(spark, d), None, 0.1)))
query("l3_weighted_triplet", f"WITH {FOUND}, h AS (SELECT i, sum(d * exp(d)) FILTER (same) / sum(exp(d)) FILTER (same) AS p, sum(d * exp(-d)) FILTER (NOT same) / sum(exp(-d)) FILTER (NOT same) AS n FROM f GROUP BY i) SELECT round(avg(ln(1 + exp(p - n))), 6) AS loss FROM h")(lambda spark, d: _L(lo.weighted_triplet(found(spark, d))))
_LP = "lp AS (SELECT *, z - ln(sum(exp(z)) OVER (PARTITION BY {i})) AS lp FROM {t})"
_ZB = f"WITH {BANK}, z AS (SELECT idx, bank.key, batch.key AS label, {{e}} AS z FROM batch, bank), {_LP.format(i='idx', t='z')}"
_SMOOTH = " SELECT round(avg(t), 6) AS loss FROM (SELECT idx, sum(-lp * (CASE WHEN key = label THEN 0.9 ELSE 0.0 END + 0.1 / 10)) AS t FROM lp{w} GROUP BY idx)"
query("l4_smoothed_cross_entropy", _ZB.format(e="list_dot_product(v, m)") + _SMOOTH.format(w=""))(lambda spark, d: _L(lo.smoothed_cross_entropy(me.scores(*bank_and_batch(spark, d)))))
query("l10_p18_ignored_label", _ZB.format(e="list_dot_product(v, m)") + _SMOOTH.format(w=" WHERE label <> 2"))(lambda spark, d: _L(lo.smoothed_cross_entropy(me.scores(*bank_and_batch(spark, d)), ignore=2)))
query("l7_margin_loss", _ZB.format(e="(list_dot_product(v, m) - CASE WHEN bank.key = batch.key THEN 0.3 ELSE 0.0 END) * 30") + " SELECT round(avg(-lp), 6) AS loss FROM lp WHERE key = label")(
    lambda spark, d: me.cross_entropy(lo.margin_scores(me.scores(*bank_and_batch(spark, d)))).agg(F.round(F.avg("loss"), 6).alias("loss")))
query("l5_supervised_contrast", f"WITH {FOUND}, {_LP.format(i='i', t='f')} SELECT round(-avg(x), 6) AS loss FROM (SELECT i, avg(lp) AS x FROM lp WHERE same GROUP BY i)")(lambda spark, d: _L(lo.vector_contrast(feats(spark, d))))
query("l6_top_k_contrast", f"WITH {FOUND}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, same ORDER BY z, j) AS n FROM f) WHERE NOT same OR n <= 8), {_LP.format(i='i', t='g')} SELECT round(-avg(x), 6) AS loss FROM (SELECT i, avg(lp) AS x FROM lp WHERE same GROUP BY i)")(lambda spark, d: _L(lo.vector_contrast(feats(spark, d), 8)))
#: A class for each camera and identity, with the unit mean of its vectors.
_PROXIES = f"{FEAT}, pm AS (SELECT cam AS kc, pid AS kp, k, avg(v[k]) AS x FROM feat, {_DIMS} GROUP BY cam, pid, k), pc AS (SELECT kc, kp, list(x ORDER BY k) AS c FROM pm GROUP BY kc, kp), z0 AS (SELECT idx, kc, kp, cam = kc AS same_cam, pid = kp AS positive, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS z FROM feat, pc), z AS MATERIALIZED (SELECT *, same_cam AND positive AS target, max(z) FILTER (same_cam AND positive) OVER (PARTITION BY idx) AS gt FROM z0)"


def proxy_scores(spark, d):
    """(idx, key, z, target, positive, same_cam): each vector's score with the class of each camera and identity."""
    f = feats(spark, d)
    means = vector_mean(f.select(F.struct("cam", "pid").alias("key"), "v"), ["key"])
    z = f.select("idx", "cam", "pid", F.col("v").alias("x")).crossJoin(means.select("key", vec.normalize(F.col("v")).alias("c")))
    same_cam, positive = F.col("key.cam") == F.col("cam"), F.col("key.pid") == F.col("pid")
    return z.select("idx", "key", vec.dot(F.col("x"), F.col("c")).alias("z"), (same_cam & positive).alias("target"), positive.alias("positive"), same_cam.alias("same_cam"))


query("l8_same_camera_margin", f"WITH {_PROXIES}, o AS (SELECT idx, target, 16 * (CASE WHEN target THEN z - 0.1 WHEN same_cam AND z >= gt THEN 1.012 * z + 0.012 ELSE z END) AS o FROM z) SELECT round(avg(l), 6) AS loss FROM (SELECT idx, ln(sum(exp(o))) - max(o) FILTER (target) AS l FROM o GROUP BY idx)")(lambda spark, d: _L(lo.same_camera_margin(proxy_scores(spark, d))))
_ADVERSARIAL = "(SELECT avg(l) FROM (SELECT idx, sum((ln(neg + exp(o)) - o) * w) AS l FROM (SELECT idx, o, sum(CASE WHEN positive THEN 0.0 ELSE exp(o) END) OVER p AS neg, {e} * positive::INT / sum(positive::INT) OVER p + {own} * target::INT AS w FROM {t} WINDOW p AS (PARTITION BY idx)) GROUP BY idx))"
_WIDER = "arc AS (SELECT idx, positive, target, 16 * CASE WHEN target THEN CASE WHEN z > cos(pi() - 0.7) THEN cos(acos(z) + 0.7) ELSE z - sin(pi() - 0.7) * 0.7 END WHEN same_cam THEN 1.2 * z + 0.2 ELSE z END AS o FROM (SELECT * REPLACE (greatest(-1.0, least(1.0, z)) AS z) FROM z)), flat AS (SELECT idx, positive, target, 16 * z AS o FROM z)"


@query("l9_camera_adversarial", f"WITH {_PROXIES}, {_WIDER} SELECT round({_ADVERSARIAL.format(e=0.1, own=0.0, t='flat')}, 6) AS camera, round({_ADVERSARIAL.format(e=1.0, own=0.0, t='arc')}, 6) AS angular, round({_ADVERSARIAL.format(e=0.1, own=0.9, t='flat')}, 6) AS multi_camera")
def _(spark, d):
    """The three forms: positives alone, with an angular margin, and with the own class on top."""
    z = proxy_scores(spark, d)
    forms = {"camera": {}, "angular": {"epsilon": 1.0, "angle": 0.7}, "multi_camera": {"own": 0.9}}
    one = [lo.camera_adversarial(z, **options).select(F.round("loss", 6).alias(name)) for name, options in forms.items()]
    return one[0].crossJoin(one[1]).crossJoin(one[2])


_V = f"WITH {FEAT} SELECT idx, {{}} FROM feat"
query("f1_unit_length", f"WITH {FEAT} SELECT idx, k, round(v[k] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS x FROM feat, {_DIMS}")(lambda spark, d: exploded(feats(spark, d).withColumn("v", vec.normalize(F.col("v"), 1e-12)), "idx"))
query("f2_flip_average", f"WITH {FEAT} SELECT idx, k, round((v[k] + v[65 - k]) / 2, 6) AS x FROM feat, {_DIMS}")(lambda spark, d: exploded(feats(spark, d).withColumn("v", vec.flip_average(F.col("v"))), "idx"))
query("f5_clamp_and_round", _V.format("CAST(round_even(v[1] * 10, 0) AS DOUBLE) AS r, least(greatest(v[1], 0.0), 0.1) AS c, round(ln(greatest(v[1], 1e-6)), 6) AS l"))(
    lambda spark, d: feats(spark, d).select("idx", F.rint(F.element_at("v", 1) * 10).alias("r"), F.least(F.greatest(F.element_at("v", 1), F.lit(0.0)), F.lit(0.1)).alias("c"), F.round(F.log(F.greatest(F.element_at("v", 1), F.lit(1e-6))), 6).alias("l")))
query("a29_power_mean", _V.format("round(pow(list_avg(list_transform(v, lambda x: pow(greatest(x, 1e-6), 3))), 1.0 / 3), 6) AS gem"))(lambda spark, d: feats(spark, d).select("idx", F.round(vec.power_mean(F.col("v")), 6).alias("gem")))
query("a30_pooling", _V.format("round(list_avg(v), 6) AS avg, round(list_max(v), 6) AS max, round(list_avg(v) + list_max(v), 6) AS both"))(
    lambda spark, d: (lambda mean: feats(spark, d).select("idx", F.round(mean, 6).alias("avg"), F.round(F.array_max("v"), 6).alias("max"), F.round(mean + F.array_max("v"), 6).alias("both")))(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")))
query("p22_column_concat", f"WITH {FEAT} SELECT pid, count(*) AS n FROM (SELECT * FROM feat WHERE idx % 2 = 0 UNION ALL SELECT * FROM feat WHERE idx % 2 = 1) GROUP BY pid")(
    lambda spark, d: feats(spark, d).where("idx % 2 = 0").unionByName(feats(spark, d).where("idx % 2 = 1")).groupBy("pid").agg(F.count("*").alias("n")))
query("f9_multi_step_rate", "SELECT range AS epoch, round(3.5e-4 * CASE WHEN range < 10 THEN 0.01 * (1 - range / 10.0::DOUBLE) + range / 10.0::DOUBLE ELSE 1.0 END * pow(0.1, CAST(range >= 20 AS INT) + CAST(range >= 40 AS INT)), 12) AS lr FROM range(60)")(
    lambda spark, d: spark.range(60).select(F.col("id").alias("epoch"), F.round(schedules.multi_step(F.col("id"), 3.5e-4, [20, 40]), 12).alias("lr")))
query("f10_cosine_rate", "SELECT range AS epoch, round(CASE WHEN range < 5 THEN 0.01 + range * ((0.1 - 0.01) / 5) WHEN range // 30 < 2 THEN 0.001 + (0.1 * pow(0.5, range // 30) - 0.001) * 0.5 * (1 + cos(pi() * (range % 30) / 30)) ELSE 0.001 END, 9) AS lr FROM range(70)")(
    lambda spark, d: spark.range(70).select(F.col("id").alias("epoch"), F.round(schedules.cosine(F.col("id"), 0.1, 30, 0.001, 5, 0.01, 0.5, 2), 9).alias("lr")))
query("f12_curriculum", "SELECT range AS epoch, CASE WHEN range < 5 THEN 2 WHEN range < 15 THEN 4 ELSE 8 END AS value FROM range(40)")(
    lambda spark, d: spark.range(40).select(F.col("id").alias("epoch"), schedules.curriculum(F.col("id"), [(2, 5), (4, 10), (8, 5)]).alias("value")))


@query("f14_unescaped_text")
def _(spark, d):
    """Character references decoded twice, outer white space taken off."""
    from vicinity.functions.text import unescape_twice

    return fixtures.table(spark, d, "documents").select("doc_id", unescape_twice("text").alias("text"))


query("f17_luma", f"WITH {FEAT} SELECT idx, k, round(v[k] * 0.2989 + v[k + 16] * 0.5870 + v[k + 32] * 0.1140, 6) AS x FROM feat, range(1, 17) t(k)")(
    lambda spark, d: exploded(feats(spark, d).select("idx", pixels.luma(_image()).alias("v")), "idx"))
query("f18_erased", f"WITH {FEAT} SELECT idx, k, round(CASE WHEN k IN (6, 7, 10, 11) THEN 0.5 ELSE v[k] END, 6) AS x FROM feat, range(1, 17) t(k)")(
    lambda spark, d: exploded(feats(spark, d).select("idx", F.element_at(pixels.erased(_image(), 4, F.lit(1), F.lit(1), F.lit(2), F.lit(2), (0.5, 0.4, 0.3)), 1).alias("v")), "idx"))


def _image():
    """A 4 x 4 image of three channels, from a vector's first 48 numbers."""
    return F.array(*[F.slice("v", 1 + 16 * c, 16) for c in range(3)])


@query("f15_f16_token_rows")
def _(spark, d, vocabulary: str = "/opt/tokenizers/word_bpe_49k.json"):
    """``vocabulary`` is a tokenizer file that the driver reads."""
    from pathlib import Path

    from vicinity.functions.text import token_rows

    encode = token_rows(Path(vocabulary).read_text(), 77, truncate=True)
    return fixtures.table(spark, d, "documents").select("doc_id", encode("text").alias("ids"))


query("a26_meters", "SELECT event_type, round(sum(value), 4) AS sum, count(*) AS count, round(avg(value), 6) AS avg FROM events GROUP BY event_type")(
    lambda spark, d: running_averages(fixtures.table(spark, d, "events"), "event_type", "value").select("event_type", F.round("sum", 4).alias("sum"), "count", F.round("avg", 6).alias("avg")))
