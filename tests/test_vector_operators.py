"""Operators on small inputs made by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import clustering as cl
from vicinity.operators import evaluation as ev
from vicinity.operators import labels, losses, memory, sampling
from vicinity.operators import neighbours as nb
from vicinity.operators.pairwise import pairs

VECTORS = "idx long, pid int, cam int, v array<double>"


def vectors(spark, n=40, dim=8, seed=0, pids=4, cams=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, i % pids, i % cams, x[i].tolist()) for i in range(n)], VECTORS)


def test_pairs_equal_numpy_whatever_the_blocks(spark):
    x, df = vectors(spark)
    want = np.maximum(2 - 2 * x @ x.T, 0)
    for block in (3, 256):
        got = pairs(df, df, block_rows=block).collect()
        assert len(got) == 1600
        assert max(abs(r.d - want[r.i, r.j]) for r in got) < 1e-12
        top = pairs(df, df, k=5, block_rows=block).collect()
        for i in range(40):
            assert [r.j for r in sorted(top, key=lambda r: r.rk) if r.i == i] == np.lexsort((np.arange(40), want[i]))[:5].tolist()


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(i, 0, i, [1.0, 0.0]) for i in range(5)], VECTORS)
    assert [(r.i, r.j) for r in pairs(df, df, k=2).orderBy("i", "rk").collect()] == [(i, j) for i in range(5) for j in (0, 1)]


def test_structured_jaccard_equals_dense(spark):
    x, df = vectors(spark, 30)
    n, ks, ki, kc, tau, beta = 30, 10, 4, 4, 2.0, 0.5
    d = np.maximum(2 - 2 * x @ x.T, 0)
    cam, pid = np.arange(n) % 3, np.arange(n) % 4
    same_cam = cam[:, None] == cam
    tier = np.where(same_cam & (pid[:, None] == pid), 0, np.where(same_cam, 2, 1))
    order = [np.lexsort((np.arange(n), d[i], tier[i]))[:ks] for i in range(n)]
    near = [[j for j in order[i] if tier[i, j] == 0][:ki] + [j for j in order[i] if tier[i, j] == 1 and i in order[j]][:kc] for i in range(n)]
    v = np.zeros((n, n))
    for i in range(n):
        for t, a, temp in ((0, 0.3, tau), (1, 0.7, 1.0)):
            js = [j for j in near[i] if tier[i, j] == t]
            if js:
                e = np.exp(-d[i, js] / temp)
                v[i, js] = a * e / e.sum()
        v[i] /= v[i].sum()
    q = np.zeros((n, n))
    for i in range(n):
        parts = [v[[j for j in near[i] if tier[i, j] == t]].mean(0) for t in (0, 1) if any(tier[i, j] == t for j in near[i])]
        q[i] = parts[0] if len(parts) == 1 else beta * parts[0] + (1 - beta) * parts[1]
    m = np.minimum(q[:, None], q[None]).sum(2)
    want = np.maximum(0, 1 - m / (2 - m + 1e-12))
    got = np.ones((n, n))
    for r in nb.structured_jaccard(df, k_search=ks, k_intra=ki, k_cross=kc, tau=tau, beta=beta).collect():
        got[r.i, r.j] = r.jaccard
    assert np.abs(got - want).max() < 1e-9
    assert np.abs(got - got.T).max() < 1e-12


def test_softmax_rows_sum_to_one_and_mutual_is_symmetric(spark):
    _, df = vectors(spark)
    top = pairs(df, df, k=7)
    sums = nb.softmax_weights(top).groupBy("i").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    m = {(r.i, r.j) for r in nb.mutual(top.select("i", "j")).collect()}
    assert m == {(j, i) for i, j in m}


def test_components_of_a_chain_and_singletons(spark):
    nodes = spark.range(11).withColumnRenamed("id", "idx")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    assert [r.label for r in cl.component_labels(nodes, edges).orderBy("idx").collect()] == [0] * 9 + [-1, -1]
    assert [r.label for r in cl.component_labels(nodes, edges, None).orderBy("idx").collect()] == [0] * 9 + [1, 2]
    assert cl.component_labels(nodes, edges.where("false")).where("label <> -1").count() == 0


def test_dbscan_border_goes_to_the_first_cluster(spark):
    pts = [0.0, 0.1, 0.2, 0.3, 1.1, 1.9, 2.0, 2.1, 2.2, 9.0]  # the middle one is within 0.8 of one core point on either side
    nodes = spark.createDataFrame([(i,) for i in range(len(pts))], "idx long")
    close = spark.createDataFrame([(i, j) for i, a in enumerate(pts) for j, b in enumerate(pts) if abs(a - b) <= 0.8 + 1e-9], "i long, j long")
    got = [r.label for r in cl.dbscan(nodes, close, 4).orderBy("idx").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, -1]


def test_camera_exclusive_association(spark):
    c = spark.createDataFrame([(0, 1, 0.1, 0, 1), (0, 2, 0.2, 0, 1), (2, 3, 0.3, 1, 2)], "i long, j long, d double, cam_i int, cam_j int")
    assert {(r.a, r.b) for r in cl.camera_exclusive_edges(c).collect()} == {(0, 1), (2, 3)}


def test_constrained_unions_keep_cameras_apart(spark):
    nodes = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 2)], "idx long, cam int")
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3)], "i long, j long, d double")
    got = {r.idx: r.label for r in cl.constrained_unions(edges, nodes).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 2: 1}


def test_multi_step_noise(spark):
    nodes = spark.range(4).withColumnRenamed("id", "idx")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    close = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, 1), (2, 2), (3, 3)], "i long, j long")
    assert [r.label for r in cl.multi_step(nodes, edges, close).orderBy("idx").collect()] == [1, 1, 0, 0]
    assert [r.label for r in cl.multi_step(nodes, edges, close, merge_noise=False).orderBy("idx").collect()] == [0, 0, -1, -1]


def test_no_match_queries_count_or_are_skipped(spark):
    q = spark.createDataFrame([(0, 1, 0, [1.0, 0.0]), (1, 99, 0, [0.0, 1.0])], VECTORS)
    g = spark.createDataFrame([(2, 1, 1, [1.0, 0.0]), (3, 2, 1, [0.0, 1.0])], VECTORS)
    row = ev.map_cmc(q, g).first()
    assert (row.mAP, row.R1) == (0.5, 0.5)
    assert ev.cmc(q, g, topk=2).collect()[0].cmc == 1.0


def test_tied_scores_are_one_threshold(spark):
    found = spark.createDataFrame([(0, 1, 0.5, True), (0, 2, 0.5, False), (0, 3, 0.7, True)], "i long, j long, d double, hit boolean")
    assert ev.mean_ap(found).first().ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_identical_and_permuted_labels_agree(spark):
    df = spark.createDataFrame([(i, i % 3, (i + 1) % 3) for i in range(12)], "idx long, a int, b int")
    assert ev.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1)
    assert ev.normalized_mutual_information(df, "a", "b").first().nmi == pytest.approx(1)


def test_memory_updates(spark):
    bank = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "key int, m array<double>")
    batch = spark.createDataFrame([(0, 0, [0.0, 1.0]), (0, 1, [1.0, 0.0])], "key int, idx long, v array<double>")
    m = np.array([1.0, 0.0])
    for v in ([0.0, 1.0], [1.0, 0.0]):
        m = m * 0.2 + np.array(v) * 0.8
        m /= np.linalg.norm(m)
    got = {r.key: r.m for r in memory.update_each(bank, batch).collect()}
    assert np.allclose(got[0], m) and got[1] == [0.0, 1.0]
    hard = {r.key: r.m for r in memory.update_hardest(bank, batch).collect()}[0]
    assert np.allclose(hard, np.array([0.2, 0.8]) / np.hypot(0.2, 0.8))


def test_samplers_keep_their_counts_and_repeat(spark):
    _, df = vectors(spark, 30)
    one = sampling.k_of_each(df.select("idx", "pid"), "pid", 20, 1)
    assert {r["count"] for r in one.groupBy("pid").count().collect()} == {20}
    assert sorted(one.collect()) == sorted(sampling.k_of_each(df.select("idx", "pid").repartition(7), "pid", 20, 1).collect())
    far = sampling.diverse_instances(df.select("idx", "pid", "cam"), 4, 2).collect()
    assert len(far) == 16 and {r.idx for r in far if r.draw == 0} == {r.anchor for r in far}


def test_label_invariant(spark):
    _, df = vectors(spark, 30)
    out = labels.extend_ids(df)
    counts = labels.camera_counts(df).agg(F.sum("id_count")).first()[0]
    assert counts == out.agg(F.max("accum_id") + 1).first()[0]


def test_triplet_on_a_line(spark):
    found = spark.createDataFrame([(0, 0, 0.0, True), (0, 1, 1.0, True), (0, 2, 0.5, False)], "i long, j long, d double, same boolean")
    assert losses.triplet(found).first().loss == pytest.approx(0.8)


def test_stream_follows_memory(spark, tmp_path):
    from vicinity.streaming.running import follow, running_averages

    spark.createDataFrame([(0, [1.0, 0.0])], "key int, m array<double>").write.parquet(str(tmp_path / "bank/0"))
    spark.createDataFrame([(0, 0, [0.0, 1.0])], "key int, idx long, v array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, idx long, v array<double>").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "bank"), 0.2, str(tmp_path / "state")).awaitTermination()
    assert np.allclose(spark.read.parquet(str(tmp_path / "bank/1")).first().m, np.array([0.2, 0.8]) / np.hypot(0.2, 0.8))
    table = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double")
    assert running_averages(table, "k", "x").first().avg == 2.0


def log_sum(z):
    return np.log(np.exp(z).sum())


def test_losses_of_a_bank_with_instances(spark):
    """The three losses over banks, against plain loops."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    key = np.arange(12) % 3
    batch = spark.createDataFrame([(int(k), i, x.tolist()) for i, (k, x) in enumerate(zip(key, v, strict=True))], "key long, idx long, v array<double>")
    centre = rng.normal(size=(3, 4))
    bank = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centre)], "key long, m array<double>")
    rows = np.concatenate([centre, *[v[key == k][:2] for k in range(3)]]) / 0.05
    got = {r.idx: r for r in memory.instance_losses(memory.instance_bank(bank, batch, 2), batch, 0.05).collect()}
    for i in range(12):
        z = rows @ v[i]
        assert got[i].centroid == pytest.approx(log_sum(z) - z[key[i]])
        own = z[3:].reshape(3, 2)
        logits = np.array([own[k].min() if k == key[i] else own[k].max() for k in range(3)])
        assert got[i].instance == pytest.approx(log_sum(logits) - logits[key[i]])
    hybrid = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(centre, v[:3], strict=True))], "key long, mean array<double>, hard array<double>")
    mean, hard = (np.mean([log_sum(m @ x / 0.05) - m[k] @ x / 0.05 for x, k in zip(v, key, strict=True)]) for m in (centre, v[:3]))
    assert memory.centre_loss(hybrid, batch).first().loss == pytest.approx(0.5 * (hard + max(0, mean - 0.2)))
    assert memory.centre_loss(hybrid, batch, slack=1e9).first().loss == pytest.approx(0.5 * hard)
    both = {o: [(r.place, r.key, r.m) for r in memory.stacked(hybrid, o).orderBy("place", "key").collect()] for o in (("mean", "hard"), ("hard", "mean"))}
    assert [x[2] for x in both["mean", "hard"]] == [x[2] for x in both["hard", "mean"][3:] + both["hard", "mean"][:3]] == [*centre.tolist(), *v[:3].tolist()]
    moved = {r.key: r.m for r in memory.model_average(bank, bank.selectExpr("key", "transform(m, x -> x + 1) as m")).collect()}
    assert np.allclose([moved[k] for k in range(3)], centre + 0.001)


def test_camera_losses_equal_plain_loops(spark):
    """Six classes of two cameras and three identities; scores at, above and below the own class's."""
    rng = np.random.default_rng(6)
    cam, pid = np.arange(6) // 3, np.arange(6) % 3
    z = rng.uniform(-1, 1, (8, 6))
    own = np.arange(8) % 6
    z[0, (own[0] + 1) % 3] = z[0, own[0]]  # a tie counts as harder
    z[1, own[1]] = -0.99  # beyond the angular margin's turn
    rows = [(i, c, float(z[i, c]), bool(c == own[i]), bool(pid[c] == pid[own[i]]), bool(cam[c] == cam[own[i]])) for i in range(8) for c in range(6)]
    df = spark.createDataFrame(rows, "idx long, key long, z double, target boolean, positive boolean, same_cam boolean")
    total = 0
    for i in range(8):
        x = np.where((cam == cam[own[i]]) & (z[i] >= z[i, own[i]]), z[i] * 1.012 + 0.012, z[i])
        x[own[i]] = z[i, own[i]] - 0.1
        total += log_sum(16 * x) - 16 * x[own[i]]
    assert losses.same_camera_margin(df).first().loss == pytest.approx(total / 8)

    def adversarial(epsilon, extra, angle):
        out = 0
        for i in range(8):
            x = z[i].copy()
            if angle:
                wide = math.cos(math.acos(x[own[i]]) + angle) if x[own[i]] > math.cos(math.pi - angle) else x[own[i]] - math.sin(math.pi - angle) * angle
                x = np.where(cam == cam[own[i]], 1.2 * x + 0.2, x)
                x[own[i]] = wide
            x = 16 * x
            positive = pid == pid[own[i]]
            for c in np.flatnonzero(positive):
                weight = epsilon / positive.sum() + (extra if c == own[i] else 0)
                out += weight * (math.log(np.exp(x[~positive]).sum() + math.exp(x[c])) - x[c])
        return out / 8

    assert losses.camera_adversarial(df).first().loss == pytest.approx(adversarial(0.1, 0, 0))
    assert losses.camera_adversarial(df, own=0.9).first().loss == pytest.approx(adversarial(0.1, 0.9, 0))
    assert losses.camera_adversarial(df, epsilon=1.0, angle=0.7).first().loss == pytest.approx(adversarial(1.0, 0, 0.7))


def test_larger_is_closer(spark):
    found = spark.createDataFrame([(0, 0, 1.0, True), (0, 1, 0.3, True), (0, 2, 0.6, False), (0, 3, 0.6, False)], "i long, j long, z double, same boolean")
    row = losses.hardest(found, "z", larger=True).first()
    assert (row.hp, row.hn, row.jp, row.jn) == (0.3, 0.6, 1, 2)
    assert losses.triplet(found, d="z", larger=True).first().loss == pytest.approx(0.6)


def test_running_aggregates_over_chunks(spark):
    from vicinity.streaming.running import running

    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, x double").repartition(6)
    for how, want in (("sum", np.cumsum(x)), ("max", np.maximum.accumulate(x))):
        got = running(df, "k", {"x": how}).orderBy("k").collect()
        assert np.allclose([r.running_x for r in got], want)


def test_rerank_puts_pairs_that_share_no_neighbour_at_jaccard_distance_1(spark):
    rng = np.random.default_rng(3)
    x = np.eye(8)[np.arange(60) % 2] + rng.normal(size=(60, 8)) * 0.05  # two groups apart, each larger than a neighbourhood
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0, 0, x[i].tolist()) for i in range(60)], VECTORS)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0) ** 2
    d /= d.max(1, keepdims=True)
    got = {(r.i, r.j): r.final for r in nb.rerank(df.where("idx < 20"), df.where("idx >= 20")).collect()}
    assert len(got) == 20 * 40
    assert all(f == pytest.approx(0.7 + 0.3 * d[i, j]) for (i, j), f in got.items() if i % 2 != j % 2)
    assert all(f < 0.7 + 0.3 * d[i, j] - 1e-6 for (i, j), f in got.items() if i % 2 == j % 2)
