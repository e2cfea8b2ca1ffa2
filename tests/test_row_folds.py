"""Metrics and losses that are worked out where the distances are, against plain loops, with copies among the vectors."""

import numpy as np
import pytest

from vicinity.operators import clustering as cl
from vicinity.operators import evaluation as ev
from vicinity.operators import losses, pairwise
from vicinity.operators import neighbours as nb

VECTORS = "idx long, pid int, cam int, v array<double>"


def copies(spark, n=48, dim=6, pids=4, cams=3):
    """Half of the vectors are copies of the other half, under other labels."""
    rng = np.random.default_rng(5)
    x = np.tile(np.round(rng.normal(size=(n // 2, dim)), 1), (2, 1))
    label = rng.integers(0, pids, n), rng.integers(0, cams, n)
    df = spark.createDataFrame([(i, int(label[0][i]), int(label[1][i]), x[i].tolist()) for i in rng.permutation(n).tolist()], VECTORS).cache()
    return x, *label, df.where("idx % 5 = 0"), df.where("idx % 5 <> 0"), df


def no_pair_is_shuffled(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "same_pid" not in plan and "PARTITION BY i" not in plan and "windowspecdefinition(i" not in plan


def ranked(x, pid, cam, junk, key):
    """(query, hits among its gallery in order, labels of the gallery in order, keys in order)."""
    g = np.array([j for j in range(len(x)) if j % 5])
    for i in range(0, len(x), 5):
        kept = g[[not junk(i, j) for j in g]]
        d = np.array([key(i, j) for j in kept])
        order = np.lexsort((kept, d))
        yield i, pid[kept][order] == pid[i], pid[kept][order], d[order]


def test_retrieval_metrics_with_copies(spark):
    x, pid, cam, q, g, _ = copies(spark)
    dot = x @ x.T
    same = lambda i, j: pid[i] == pid[j] and cam[i] == cam[j]
    squared = lambda i, j: max(0.0, 2 - 2 * dot[i, j])
    ap = lambda hit: np.mean([np.sum(hit[: k + 1]) / (k + 1) for k in np.flatnonzero(hit)])

    rows = [hit for _, hit, *_ in ranked(x, pid, cam, same, lambda i, j: -dot[i, j])]
    got = ev.map_cmc(q, g)
    assert no_pair_is_shuffled(got)
    got = got.first()
    assert got.mAP == pytest.approx(np.mean([ap(h) if h.any() else 0 for h in rows]))
    assert got.R5 == pytest.approx(np.mean([h[:5].any() for h in rows]))

    for separate in (False, True):
        rows = [hit for _, hit, *_ in ranked(x, pid, cam, (lambda i, j: cam[i] == cam[j]) if separate else same, squared) if hit.any()]
        want = np.zeros(100)
        for h in rows:
            at = np.flatnonzero(h)
            np.add.at(want, at - np.arange(len(at)), 1 / len(at))
        got = ev.cmc(q, g, separate_camera_set=separate)
        assert no_pair_is_shuffled(got)
        assert [r.cmc for r in got.orderBy("rank").collect()] == pytest.approx((np.cumsum(want) / len(rows)).tolist())

    for junk, of in (("false", lambda i, j: False), ("cam_i = 3 and cam_j = 2", lambda i, j: cam[i] == 3 and cam[j] == 2), ("pid_i = pid_j and cam_i = cam_j", same)):
        rows = [(h, labels) for _, h, labels, _ in ranked(x, pid, cam, of, squared) if h.any()]
        got = ev.cross_modality(q, g, junk=junk, deduplicate=True)
        assert no_pair_is_shuffled(got)
        got = got.first()
        assert got.mAP == pytest.approx(np.mean([ap(h) for h, _ in rows]))
        assert got.mINP == pytest.approx(np.mean([h.sum() / (np.flatnonzero(h)[-1] + 1) for h, _ in rows]))
        assert got.R1 == pytest.approx(np.mean([len(set(labels[: np.flatnonzero(h)[0]])) + 1 <= 1 for h, labels in rows]))

    want = {i: np.mean([h[d <= x].sum() / (d <= x).sum() for x in d[h]]) for i, h, _, d in ranked(x, pid, cam, same, squared) if h.any()}
    assert {r.i: r.ap for r in ev.average_precision(q, g).collect()} == pytest.approx(want)


def test_row_folds_beyond_a_broadcast(spark, monkeypatch):
    """Every left block meets all right ones in one task, whatever the sides' sizes."""
    x, pid, cam, q, g, df = copies(spark)
    monkeypatch.setattr(pairwise, "BROADCAST_BYTES", 0)
    got = pairwise.row_folds(q, df, lambda i, pi, ci, j, pj, cj, d: {"i": i, "n": d.shape[1] + 0 * i, "sum": d.sum(1)}, "i long, n long, sum double", metric="dot")
    assert {(r.i, r.n): r.sum for r in got.collect()} == pytest.approx({(i, 48): (x @ x.T)[i].sum() for i in range(0, 48, 5)})


def test_losses_without_rows_of_pairs(spark):
    x, pid, _, _, _, df = copies(spark)
    z = x @ x.T
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 1e-12))
    same = pid[:, None] == pid[None]
    soft, full, top = [], [], []
    for i in range(48):
        soft.append(np.log1p(np.exp(d[i, same[i]].max() * 1.1 - d[i, ~same[i]].min() * 0.9)))
        full.append(z[i, same[i]].mean() - np.log(np.exp(z[i]).sum()))
        chosen = np.sort(z[i, same[i]])[:8]
        top.append(chosen.mean() - np.log(np.exp(chosen).sum() + np.exp(z[i, ~same[i]]).sum()))
    for got, want in ((losses.vector_triplet(df, None, 0.1), np.mean(soft)), (losses.vector_contrast(df), -np.mean(full)), (losses.vector_contrast(df, 8), -np.mean(top))):
        assert no_pair_is_shuffled(got)
        assert got.first().loss == pytest.approx(want)


def test_pair_distances_are_products_and_exact_near_zero(spark):
    x, *_, df = copies(spark)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    p = np.clip(x, 1e-6, 1.0)
    kl = lambda a, b: (a * np.log(a / b)).sum(-1)
    cos = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    want = {"difference": d, "distance": np.sqrt(np.maximum(d, 1e-12)), "cosine": cos, "cosine distance": (1 - cos) / 2, "symmetric kl": (kl(p[:, None], p[None]) + kl(p[None], p[:, None])) / 2}
    for metric, matrix in want.items():
        got = pairwise.pair_distances(df, df, metric=metric).collect()
        assert len(got) == 48 * 48
        assert max(abs(r.d - matrix[r.i, r.j]) for r in got) < 1e-12


def test_statistics_of_all_pairs_and_the_affinity_graph(spark):
    x, pid, cam, _, _, df = copies(spark)
    d = np.maximum(2 - 2 * x @ x.T, 0)
    later = np.arange(48)[:, None] < np.arange(48)
    cross = later & (cam[:, None] != cam)
    for share in (0.05, 0.5, 1.0):
        limit, sigma = cl.percentile_deviation(df, share)
        assert limit == pytest.approx(np.quantile(d[cross], share), abs=1e-12)
        assert sigma == pytest.approx(np.std(d[cross]))
    got = cl.affinity_graph(df, 0.5)
    assert no_pair_is_shuffled(got)
    limit, sigma = cl.percentile_deviation(df, 0.5)
    assert {(r.i, r.j): r.affinity for r in got.collect()} == pytest.approx({(i, j): np.exp(-d[i, j] / (sigma + 1e-6)) for i, j in zip(*np.nonzero(cross & (d < limit)), strict=True)})
    assert cl.percentile_deviation(df.where("cam = 0")) == (None, None)
    same = pid[:, None] == pid
    got = pairwise.distance_stats(df)
    assert {r.same_pid: (r.mean_d, r.min_d) for r in got.collect()} == {s: pytest.approx((d[later & (same == s)].mean(), d[later & (same == s)].min())) for s in (False, True)}
    assert {(r.i, r.j) for r in pairwise.close_pairs(df, df, 0.5).collect()} == set(zip(*(a.tolist() for a in np.nonzero(d <= 0.5)), strict=True))


@pytest.mark.parametrize("rows, at_once, limit", [(1024, 128, 64 << 20), (8, 3, 64 << 20), (8, 3, 0)])
def test_each_two_vectors_meet_once(spark, monkeypatch, rows, at_once, limit):
    for name, value in (("MEET_ROWS", rows), ("AT_ONCE_ROWS", at_once), ("BROADCAST_BYTES", limit)):
        monkeypatch.setattr(pairwise, name, value)
    x, *_, df = copies(spark)
    d = np.maximum(2 - 2 * x @ x.T, 0)

    def fold(matrices):
        for i, _, j, _, d, own in matrices:
            r, c = np.nonzero(i[:, None] < j[None] if own else d >= 0)
            yield {"i": np.minimum(i[r], j[c]), "j": np.maximum(i[r], j[c]), "d": d[r, c]}

    got = pairwise.meet_folds(pairwise.meeting_blocks(df.repartition(5, "idx")), fold, "i long, j long, d double").collect()
    assert len(got) == 48 * 47 // 2
    assert {(r.i, r.j): r.d for r in got} == pytest.approx({(i, j): d[i, j] for i in range(48) for j in range(i + 1, 48)})


def test_power_iteration_is_a_plain_loop_over_edges_in_blocks(spark, monkeypatch):
    """In blocks of 12 bytes an edge, and alike however the vectors are dealt."""
    monkeypatch.setattr(pairwise, "MEET_ROWS", 8)
    monkeypatch.setattr(cl, "CHUNK", 7)
    x, cam = np.random.default_rng(8).normal(size=(48, 6)), np.arange(48) % 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, 0, int(cam[i]), x[i].tolist()) for i in range(48)], VECTORS)
    d = np.maximum(2 - 2 * x @ x.T, 0)
    cross = (np.arange(48)[:, None] < np.arange(48)) & (cam[:, None] != cam)
    w = np.where(cross & (d < np.quantile(d[cross], 0.05)), np.exp(-d / (np.std(d[cross]) + 1e-6)), 0)
    w += w.T
    ids = np.flatnonzero(w.sum(0))
    assert 0 < len(ids) < 48  # some have no edge, and get no label
    a = w[np.ix_(ids, ids)]
    v = np.random.default_rng(0).normal(size=len(ids))
    v /= np.abs(v).sum()
    step = np.inf
    for _ in range(15):
        new = a @ v / a.sum(1)
        new /= np.abs(new).sum()
        last, step, v = step, np.abs(new - v).sum(), new
        if abs(step - last) <= max(1e-5 / len(ids), 1e-8):
            break
    want = dict(zip(ids.tolist(), cl.line_means(v * len(ids), 3).tolist(), strict=True))
    for parts in (1, 7):
        graph = cl.packed_affinity_graph(df.repartition(parts, "idx"))
        assert graph.selectExpr("sum(octet_length(r) + octet_length(c) + octet_length(w)) AS n").first().n == 12 * np.count_nonzero(np.triu(w))
        assert {r.idx: r.label for r in cl.power_iteration_clusters(graph, 3).collect()} == want
    edges = cl.packed_graph(cl.affinity_graph(df))
    assert {r.idx: r.label for r in cl.power_iteration_clusters(edges, 3).collect()} == want
    assert cl.power_iteration_clusters(cl.packed_affinity_graph(df.where("cam = 0")), 3).count() == 0


def test_power_iteration_parts_what_has_no_edge_between(spark):
    rng = np.random.default_rng(1)
    edges = [(i, j, float(rng.uniform(0.5, 1))) for g in range(3) for i in range(g * 20, g * 20 + 20) for j in range(i + 1, g * 20 + 20)]
    got = cl.power_iteration_clusters(cl.packed_graph(spark.createDataFrame(edges, "i long, j long, affinity double")), 3).collect()
    labels = np.array([r.label for r in sorted(got, key=lambda r: r.idx)]).reshape(3, 20)
    assert (labels == labels[:, :1]).all() and len(set(labels[:, 0])) == 3


def test_means_on_a_line():
    assert cl.line_means(np.array([5.0, 0.0, 9.1, 0.1, 5.1, 9.0]), 3).tolist() == [1, 0, 2, 0, 1, 2]
    assert cl.line_means(np.array([2.0, 2.0, 1.0]), 10).tolist() == [1, 1, 0]


@pytest.mark.parametrize("at_once, block, limit", [(1 << 20, 512, 64 << 20), (7, 5, 0)])
def test_min_sum_shuffles_no_shared_column(spark, monkeypatch, at_once, block, limit):
    for name, value in (("AT_ONCE", at_once), ("BLOCK_ROWS", block), ("BROADCAST_BYTES", limit)):
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(2)
    w = np.where(rng.random((40, 30)) < 0.1, rng.random((40, 30)), 0)
    w[:, 3] = 0.25  # of all rows but one
    w[7] = 0
    df = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "i long, j long, w double")
    want = {(i, j): np.minimum(w[i], w[j]).sum() for i in range(40) for j in range(40) if (np.minimum(w[i], w[j]) > 0).any()}
    got = nb.min_sum(df)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.collect()
    assert len(got) == len(want)
    assert {(r.i, r.j): r.m for r in got} == pytest.approx(want)
    of = spark.createDataFrame([(0,), (9,)], "i long")
    assert {(r.i, r.j): r.m for r in nb.min_sum(df, of).collect()} == pytest.approx({k: v for k, v in want.items() if k[0] in (0, 9)})
