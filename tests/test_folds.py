"""Sequential association against plain loops, in one part and in many."""

import numpy as np
import pytest

from vicinity.operators import clustering as cl


@pytest.fixture(params=[None, 7])
def parts(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(cl, "FOLD_ROWS", request.param)


def some_edges(seed, n=60, m=90):
    """Distinct pairs of nodes i < j, with few distinct distances, in several components; and the nodes' cameras."""
    rng = np.random.default_rng(seed)
    cams = rng.integers(0, 4, n).tolist()
    found = {}
    for i, j in rng.integers(0, n, (m, 2)).tolist():
        if i // 12 == j // 12 and cams[i] != cams[j]:
            found[min(i, j), max(i, j)] = int(rng.integers(1, 9)) / 10
    return sorted((d, i, j) for (i, j), d in found.items()), cams


def numbers(keys):
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def test_camera_exclusive_edges(spark, parts):
    edges, cams = some_edges(1)
    want, linked = set(), set()
    for _, i, j in edges:
        if (i, cams[j]) not in linked and (j, cams[i]) not in linked:
            linked |= {(i, cams[j]), (j, cams[i])}
            want.add((i, j))
    rows = spark.createDataFrame([(i, j, d, cams[i], cams[j]) for d, i, j in edges], "i long, j long, d double, cam_i int, cam_j int")
    assert {(r.a, r.b) for r in cl.camera_exclusive_edges(rows).collect()} == want
    assert 0 < len(want) < len(edges)


@pytest.mark.parametrize("most", [None, 0, 5, 12, 1000])
def test_constrained_unions(spark, parts, most):
    edges, cams = some_edges(2)
    root, unions = list(range(len(cams))), 0
    for _, i, j in edges:
        if most is not None and unions == most:
            break
        a, b = sorted((root[i], root[j]))
        mine, other = ({cams[x] for x in range(len(cams)) if root[x] == r} for r in (a, b))
        if a != b and not mine & other:
            root, unions = [a if r == b else r for r in root], unions + 1
    nodes = spark.createDataFrame(list(enumerate(cams)), "idx long, cam int")
    rows = spark.createDataFrame([(i, j, d) for d, i, j in edges], "i long, j long, d double")
    assert [r.label for r in cl.constrained_unions(rows, nodes, most).orderBy("idx").collect()] == numbers(root)


def test_agglomerated_groups(spark, parts):
    rng = np.random.default_rng(3)
    edges = sorted({(int(rng.integers(1, 12)) / 10, c1, c2, a, b) for c1 in range(4) for c2 in range(c1 + 1, 4) for a, b in rng.integers(0, 10, (12, 2)).tolist() if a // 3 == b // 3})
    edges = [e for n, e in enumerate(edges) if e[1:] not in [x[1:] for x in edges[:n]]]
    sets = []  # by when they were made
    for d, c1, c2, a, b in edges:
        if d >= 0.9:
            continue
        x, y = (c1, a), (c2, b)
        sx, sy = (next((s for s in sets if v in s), None) for v in (x, y))
        if sx is None and sy is None:
            sets.append([x, y])
        elif sx is None or sy is None:
            s, new = (sy, x) if sx is None else (sx, y)
            if new[0] not in [c for c, _ in s]:
                s.append(new)
        elif sx is not sy and not {c for c, _ in sx} & {c for c, _ in sy}:
            sets = [s for s in sets if s is not sx and s is not sy] + [sx + sy]
    got = cl.agglomerate_groups(spark.createDataFrame([(c1, a, c2, b, d) for d, c1, c2, a, b in edges], "cam1 int, id1 int, cam2 int, id2 int, d double"), 0.9).collect()
    assert {((r.cam, r.id), r.gid) for r in got} == {(v, n) for n, s in enumerate(sets) for v in s}
    assert any(len(s) > 2 for s in sets)


@pytest.mark.parametrize("fallback", [False, True])
def test_absorb_and_repel(spark, parts, fallback):
    rng = np.random.default_rng(4)
    n, cams = 40, np.arange(40) % 3
    s = np.round(rng.random((n, n)) ** 12, 2)
    s = np.maximum(s, s.T)
    s[30:] = s[:, 30:] = 0.1
    s[30:33, 30:33] = 0.25
    label, fresh = [-1] * n, 0
    for i in range(n):
        taken = [j for j in range(n) if cams[j] != cams[i] and s[i, j] >= 0.8 and label[j] == -1]
        if taken:
            for j in [*taken, i]:
                label[j] = fresh
            fresh += 1
    assert any(x == -1 for x in label[:30])
    for i in range(n):
        if label[i] == -1 and max(s[i, j] for j in range(n) if cams[j] != cams[i]) >= 0.3:
            label[i], fresh = fresh, fresh + 1
    if fallback:
        label[30:33] = [fresh] * 3  # the only ones that are close
    close = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if i == j or s[i, j] >= 0.2], "i long, j long") if fallback else None
    links = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(n) if cams[i] != cams[j]], "i long, j long, s double")
    got = cl.absorb_and_repel(links, spark.range(n).withColumnRenamed("id", "idx"), close=close)
    assert [r.label for r in got.orderBy("idx").collect()] == label


def test_propagated_labels(spark):
    rng = np.random.default_rng(5)
    n = 50
    label = np.where(rng.random(n) < 0.7, -1, rng.integers(0, 6, n)).tolist()
    near = [(i, int(j), float(d), r + 1) for i in range(n) for r, (j, d) in enumerate(zip(rng.permutation(n)[:6], np.sort(rng.random(6)), strict=True)) if j != i]
    want, fresh = list(label), max(label) + 1
    for i in range(n):
        if want[i] == -1:
            take = [want[j] for a, j, d, r in near if a == i and d <= 0.5 and r <= 5 and want[j] != -1]
            want[i] = take[0] if take else fresh
            fresh += not take
    assert max(want) > max(label)
    got = cl.propagate_known(spark.createDataFrame(near, "i long, j long, d double, rk int"), spark.createDataFrame(list(enumerate(label)), "idx long, label int"))
    assert [r.label for r in got.orderBy("idx").collect()] == want


def test_empty_tables(spark):
    edges, nodes = spark.createDataFrame([], "i long, j long, d double"), spark.createDataFrame([(3, 0), (5, 0)], "idx long, cam int")
    assert [r.label for r in cl.constrained_unions(edges, nodes, 4).orderBy("idx").collect()] == [0, 1]
    assert cl.agglomerate_groups(spark.createDataFrame([], "cam1 int, id1 int, cam2 int, id2 int, d double"), 1.0).count() == 0
    assert [r.label for r in cl.absorb_and_repel(edges.withColumnRenamed("d", "s"), nodes).collect()] == [-1, -1]
