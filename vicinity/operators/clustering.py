"""Components, density clustering and label propagation over sparse pairs.

Iterations run on the driver; their tables are cut with checkpoints in the shared folder.
Sequential steps (greedy association) are ordered folds over pre-reduced edges. A step depends only on earlier steps of its own
component, so beyond ``FOLD_ROWS`` edges whole components are dealt to parts, a task each; one component has to fit into a task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.checkpoints import cut
from vicinity.operators.pairwise import meet_folds, meeting_blocks


HUB = 4096
FOLD_ROWS = 1 << 20


def on_hub(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``by`` (key, n, ..) on key, where n is how many rows have it. Keys of over ``HUB`` rows are broadcast
    (there are at most a ``HUB``-th as many as rows), so that no task takes all rows of one; the others are shuffled."""
    hubs = F.broadcast(by.where(F.col("n") > HUB).drop("n"))
    others = rows.join(hubs.select(key), key, "left_anti").join(by.where(F.col("n") <= HUB).drop("n"), key)
    return rows.join(hubs, key).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of each component of ``edges`` (a, b). Alternating large and small stars."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state or seen.n == 0:
            break
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def component_labels(nodes: DataFrame, edges: DataFrame, singletons: int | None = -1) -> DataFrame:
    """(idx, label): components numbered from 0 by their least node; nodes alone get ``singletons``, or a label of their own if it is None."""
    rooted = nodes.select("idx").join(components(edges), F.col("idx") == F.col("node"), "left").select("idx", "root")
    if singletons is None:
        rooted = rooted.withColumn("root", F.coalesce("root", "idx"))
    order = rooted.where("root is not null").select("root").distinct().withColumn("label", F.row_number().over(Window.orderBy("root")) - 1)
    return rooted.join(order, "root", "left").select("idx", F.coalesce("label", F.lit(singletons if singletons is not None else -1)).cast("int").alias("label"))


def dbscan(nodes: DataFrame, close: DataFrame, min_samples: int) -> DataFrame:
    """(idx, label) from ``close`` (i, j), all pairs within eps both ways, a node's pair with itself included if it is within eps.

    A border node goes to the least label among its core neighbours; noise is -1; labels follow each cluster's first core node.
    """
    close = cut(close.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    core = cut(close.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("i").alias("idx")))
    edges = close.join(core.withColumnRenamed("idx", "i"), "i", "left_semi").join(core.withColumnRenamed("idx", "j"), "j", "left_semi")
    labels = cut(component_labels(core, edges.select(F.col("i").alias("a"), F.col("j").alias("b")), None))
    border = close.join(labels.withColumnRenamed("idx", "j"), "j").groupBy(F.col("i").alias("idx")).agg(F.min("label").alias("border"))
    return nodes.select("idx").join(labels, "idx", "left").join(border, "idx", "left").select("idx", F.coalesce("label", "border", F.lit(-1)).cast("int").alias("label"))


def in_components(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows``, cut, with ``_part``: rows whose links (a, b) are of one component share it, and a part has some ``FOLD_ROWS`` rows."""
    rows = cut(rows)
    parts = -(-rows.count() // FOLD_ROWS)
    if parts <= 1:
        return rows.withColumn("_part", F.lit(0))
    roots = components(rows.select(F.col(a).alias("a"), F.col(b).alias("b"))).withColumnRenamed("node", a)
    return cut(rows.join(roots, a, "left").withColumn("_part", F.pmod(F.xxhash64(F.coalesce("root", a)), F.lit(parts))).drop("root"))


def ordered_fold(placed: DataFrame, order: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` over each part of ``in_components``, in order: for steps that depend on earlier steps of their component."""
    return placed.groupBy("_part").applyInPandas(lambda t: fold(t.sort_values(order, kind="stable")), schema)


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with label: the place of their keys among the sorted distinct ones, from 0. Ranks are taken over distinct values."""
    order = rows.select(*keys).distinct().withColumn("label", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int"))
    return rows.join(order, list(keys))


def camera_exclusive_edges(candidates: DataFrame) -> DataFrame:
    """(a, b) accepted from ``candidates`` (i, j, d, cam_i, cam_j) in order of (d, i, j): neither end may have a link to the other's camera yet."""

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        linked: dict[int, set] = {}
        out = []
        for i, j, ci, cj in zip(t.i.tolist(), t.j.tolist(), t.cam_i.tolist(), t.cam_j.tolist(), strict=True):
            if cj not in linked.setdefault(i, set()) and ci not in linked.setdefault(j, set()):
                linked[i].add(cj)
                linked[j].add(ci)
                out.append((i, j))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    rows = candidates.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d", "cam_i", "cam_j")
    return ordered_fold(in_components(rows, "i", "j"), ["d", "i", "j"], fold, "a long, b long")


def constrained_unions(edges: DataFrame, nodes: DataFrame, max_unions: int | None = None) -> DataFrame:
    """(idx, label): union-find over ``edges`` (i, j, d) in order; sets with a common camera are not joined. ``nodes``: (idx, cam).

    Labels follow each set's least node; nodes alone have labels of their own. ``max_unions`` bounds the unions of all
    components together: the first ones in order count, and edges after the last of them are left out.
    """

    def walk(t: pd.DataFrame, most: float = math.inf) -> tuple[list, dict]:
        cams, parent, joined = {}, {}, []

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j, d, ci, cj in zip(t.i.tolist(), t.j.tolist(), t.d.tolist(), t.cam_i.tolist(), t.cam_j.tolist(), strict=True):
            if len(joined) >= most:
                break
            for x, c in ((i, ci), (j, cj)):
                if x not in parent:
                    parent[x], cams[x] = x, {c}
            a, b = sorted((find(i), find(j)))
            if a != b and cams[a].isdisjoint(cams[b]):
                parent[b] = a
                cams[a] |= cams.pop(b)
                joined.append((d, i, j))
        return joined, {x: find(x) for x in list(parent)}

    def unions(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(walk(t)[0], columns=["d", "i", "j"]).astype({"d": "float64", "i": "int64", "j": "int64"})

    def sets(t: pd.DataFrame, most: float = math.inf) -> pd.DataFrame:
        return pd.DataFrame(list(walk(t, most)[1].items()), columns=["idx", "root"]).astype("int64")

    cam = lambda c: nodes.select(F.col("idx").cast("long").alias(c), F.col("cam").alias(f"cam_{c}"))
    rows = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    order = ["d", "i", "j"]
    placed = in_components(rows.join(cam("i"), "i").join(cam("j"), "j"), "i", "j")
    if max_unions is not None and placed.select("_part").distinct().limit(2).count() == 1:
        sets = functools.partial(sets, most=max_unions)
    elif max_unions is not None:
        last = ordered_fold(placed, order, unions, "d double, i long, j long").orderBy(*order).limit(max_unions).agg(F.max(F.struct(*order)).alias("last")).first().last
        placed = placed.where(F.struct(*order) <= F.struct(F.lit(last.d), F.lit(last.i).cast("long"), F.lit(last.j).cast("long"))) if last else placed.where("false")
    rooted = nodes.select(F.col("idx").cast("long").alias("idx")).join(ordered_fold(placed, order, sets, "idx long, root long"), "idx", "left")
    return numbered(rooted.withColumn("root", F.coalesce("root", "idx")), "root").select("idx", "label")


def agglomerate_groups(edges: DataFrame, threshold: float) -> DataFrame:
    """(cam, id, gid) from ``edges`` (cam1, id1, cam2, id2, d) under ``threshold``, nearest first; ties go by both cameras, then both ids.

    Two new groups found a set; a new one joins a set that lacks its camera; two sets that share no camera make a new set.
    gid numbers the sets that are left by when they were made.
    """
    born = ["d", "cam1", "cam2", "id1", "id2"]

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        of: dict[tuple, tuple] = {}
        sets: dict[tuple, list] = {}
        for key in zip(*[t[c].tolist() for c in born], strict=True):
            x, y = (key[1], key[3]), (key[2], key[4])
            gx, gy = of.get(x), of.get(y)
            if gx is None and gy is None:
                members = [x, y]
            elif gx is None or gy is None:
                g, new = (gy, x) if gx is None else (gx, y)
                if all(new[0] != c for c, _ in sets[g]):
                    sets[g].append(new)
                    of[new] = g
                continue
            elif gx != gy and {c for c, _ in sets[gx]}.isdisjoint(c for c, _ in sets[gy]):
                members = sets.pop(gx) + sets.pop(gy)
            else:
                continue
            sets[key] = members
            of.update(dict.fromkeys(members, key))
        out = pd.DataFrame([(*x, *key) for x, key in of.items()], columns=["cam", "id", *born])
        return out.astype({c: "float64" if c == "d" else "int64" for c in out.columns})

    rows = edges.where(F.col("d") < threshold).select(F.col("d").cast("double").alias("d"), *[F.col(c).cast("long").alias(c) for c in born[1:]])
    rows = rows.withColumns({"_a": F.xxhash64("cam1", "id1"), "_b": F.xxhash64("cam2", "id2")})
    found = ordered_fold(in_components(rows, "_a", "_b"), born, fold, "cam long, id long, d double, cam1 long, cam2 long, id1 long, id2 long")
    return numbered(found, *born).select("cam", "id", F.col("label").cast("long").alias("gid"))


def absorb_and_repel(links: DataFrame, groups: DataFrame, *, absorb: float = 0.8, repel: float = 0.3, close: DataFrame | None = None) -> DataFrame:
    """(idx, label) of groups: each, in order, founds a cluster with the groups of other cameras that have no label yet and a similarity
    of ``absorb`` or more, leaving the one that it was in.

    ``links``: (i, j, s) similarities of groups over cameras; ``groups``: (idx). A group left over whose best similarity is
    under ``repel`` stays -1, unless ``close`` (i, j: pairs that are near, both ways and with itself) clusters those left by density, two and more;
    any other gets a label of its own.
    """

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        founder: dict[int, int] = {}
        for i, near in t.groupby("i", sort=True).j:
            taken = [j for j in near.tolist() if j not in founder]
            if taken:
                founder.update(dict.fromkeys([*taken, int(i)], int(i)))
        return pd.DataFrame(list(founder.items()), columns=["idx", "founder"]).astype("int64")

    links = cut(links.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "s"))
    found = ordered_fold(in_components(links.where(F.col("s") >= absorb).select("i", "j"), "i", "j"), ["i", "j"], fold, "idx long, founder long")
    best = links.groupBy(F.col("i").alias("idx")).agg(F.max("s").alias("best"))
    phase = F.when(F.col("founder").isNotNull(), 0).when(F.col("best") >= repel, 1)
    rows = groups.select(F.col("idx").cast("long").alias("idx")).join(found, "idx", "left").join(best, "idx", "left").select("idx", phase.alias("phase"), F.coalesce("founder", "idx").alias("founder"))
    if close is not None:
        rows = cut(rows)
        left = rows.where("phase is null").select("idx")
        among = close.join(left.withColumnRenamed("idx", "i"), "i", "left_semi").join(left.withColumnRenamed("idx", "j"), "j", "left_semi")
        dense = dbscan(left, among, 2).select("idx", F.when(F.col("label") != -1, 2).alias("phase"), F.col("label").cast("long").alias("founder"))
        rows = rows.where("phase is not null").unionByName(dense)
    rows = cut(rows)
    return numbered(rows.where("phase is not null"), "phase", "founder").select("idx", "label").unionByName(rows.where("phase is null").select("idx", F.lit(-1).alias("label")))


def propagate_known(near: DataFrame, nodes: DataFrame, limit: float = 0.5, k: int = 5) -> DataFrame:
    """(idx, label): nodes with label -1 take, in order of idx, that of the first of their ``near`` (i, j, d, rk) to rank ``k`` and within ``limit`` that has one; else a new one.

    When a node's turn comes, all nodes before it have a label: so its first neighbour that is known or before it decides, and following
    these choices ends at the least node of a tree, which takes a known label or a new one. No step waits for another.
    """
    nodes = cut(nodes.select(F.col("idx").cast("long").alias("idx"), F.col("label").cast("int").alias("label")))
    fresh = nodes.where("label = -1").select("idx")
    known = nodes.select(F.col("idx").alias("j"), F.when(F.col("label") != -1, F.col("label")).alias("known"))
    lists = near.where((F.col("rk") <= k) & (F.col("d") <= limit)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "rk")
    lists = lists.join(fresh.withColumnRenamed("idx", "i"), "i", "left_semi").join(known, "j").where("known is not null or j < i")
    first = cut(lists.groupBy("i").agg(F.min_by(F.struct("j", "known"), "rk").alias("f")).select("i", "f.*"))
    roots = components(first.where("known is null").select(F.col("i").alias("a"), F.col("j").alias("b")))
    rooted = fresh.join(roots.withColumnRenamed("node", "idx"), "idx", "left").withColumn("root", F.coalesce("root", "idx"))
    rooted = cut(rooted.join(first.select(F.col("i").alias("root"), "known"), "root", "left"))
    last = nodes.agg(F.max("label").alias("last"))  # one row
    new = numbered(rooted.where("known is null"), "root").crossJoin(F.broadcast(last)).select("idx", (F.col("label") + F.col("last") + 1).alias("label"))
    return nodes.where("label <> -1").unionByName(rooted.where("known is not null").select("idx", F.col("known").alias("label"))).unionByName(new)


def multi_step(nodes: DataFrame, edges: DataFrame, close: DataFrame, min_samples: int = 2, merge_noise: bool = True) -> DataFrame:
    """(idx, label): components of ``edges`` (a, b), then density clusters within each (``close``: pairs within eps).

    With ``merge_noise`` the noise of a component is one more cluster of it; else its nodes stay -1. Labels follow (component, cluster).
    """
    comp = cut(component_labels(nodes, edges, None).withColumnRenamed("label", "comp"))
    inside = close.join(comp.select(F.col("idx").alias("i"), F.col("comp").alias("ci")), "i").join(comp.select(F.col("idx").alias("j"), F.col("comp").alias("cj")), "j").where("ci = cj")
    fine = comp.join(dbscan(nodes, inside.select("i", "j"), min_samples), "idx")
    if not merge_noise:
        keys = fine.where("label <> -1").select("comp", "label").distinct()
    else:
        keys = fine.select("comp", "label").distinct()
    keys = keys.withColumn("new", F.row_number().over(Window.orderBy("comp", "label")) - 1)
    return fine.join(keys, ["comp", "label"], "left").select("idx", F.coalesce("new", F.lit(-1)).cast("int").alias("label"))


def _cross(i, cam_i, j, cam_j, own):
    """Which pairs of ``meet_folds`` are of two cameras."""
    cross = cam_i[:, None] != cam_j[None]
    return cross & (i[:, None] < j[None]) if own else cross


#: Bits below those that a step of ``percentile_deviation`` looks at.
STEPS = (40, 18, 0)


def percentile_deviation(feat: DataFrame, percentile: float = 0.05) -> tuple[float | None, float | None]:
    """The exact percentile (between neighbouring values as DuckDB has it) and the population deviation of squared distances between cameras.

    Distances are at least 0, so they are in the order of their bits. A pass over the pairs counts them by their first bits; another one counts the values
    of the ranges that hold the two places, and their next bits are looked at in these: what comes to the driver is two ranges a step.
    """
    return _percentile_deviation(meeting_blocks(feat), percentile)


def _percentile_deviation(blocks: DataFrame, percentile: float) -> tuple[float | None, float | None]:
    def first(matrices):
        bins, n, mean, square = np.zeros(1 << 63 - STEPS[0], np.int64), 0, 0.0, 0.0
        for i, cam_i, j, cam_j, d, own in matrices:
            d = np.abs(d[_cross(i, cam_i, j, cam_j, own)])  # no -0.0
            if not len(d):
                continue
            bits = d.view(np.int64) >> STEPS[0]
            low = int(bits.min())
            of = np.bincount(bits - low)
            bins[low : low + len(of)] += of
            step = float(d.mean()) - mean
            square += float(np.square(d - d.mean()).sum()) + step * step * n * len(d) / (n + len(d))
            mean += step * len(d) / (n + len(d))
            n += len(d)
        if n:
            at = np.flatnonzero(bins)
            rest = np.zeros(len(at))
            yield {"bin": np.append(at, -1), "n": np.append(bins[at], n), "mean": np.append(rest, mean), "square": np.append(rest, square)}

    def inside(matrices):
        """The values of the bins from ``low`` to ``high``, and how many there are of each."""
        kept, waiting = (np.zeros(0, np.int64),) * 2, []

        def merged():
            value, at = np.unique(np.concatenate([kept[0], *waiting]), return_inverse=True)
            return value, np.bincount(at, np.concatenate([kept[1], *(np.ones(len(x), np.int64) for x in waiting)]), len(value)).astype(np.int64)

        for i, cam_i, j, cam_j, d, own in matrices:
            bits = np.abs(d).view(np.int64)
            waiting.append(bits[(bits >= low << STEPS[0]) & (bits < high + 1 << STEPS[0]) & _cross(i, cam_i, j, cam_j, own)])
            if sum(map(len, waiting)) > 1 << 20:
                kept, waiting = merged(), []
                if len(kept[0]) > 1 << 20:
                    yield {"bits": kept[0], "n": kept[1]}
                    kept = (np.zeros(0, np.int64),) * 2
        kept = merged()
        yield {"bits": kept[0], "n": kept[1]}

    def holding(found: DataFrame, place: int, before: int, within: tuple[int, int] | None) -> tuple[int, int]:
        """The bin that holds ``place``, and how many values come before it."""
        rows = found if within is None else found.where(F.expr(f"bin >> {within[1]} = {within[0]}"))
        w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # bins: some thousand an octave of distances at most, later 2^22
        at = rows.withColumn("upto", F.sum("n").over(w) + before).where(F.col("upto") > place).orderBy("bin").first()
        return at.bin, at.upto - at.n

    counted = cut(meet_folds(blocks, first, "bin long, n long, mean double, square double"))
    parts = counted.where("bin = -1").toPandas()  # a row a task
    every = int(parts.n.sum())
    if not every:
        return None, None
    mean = float((parts.n * parts["mean"]).sum()) / every
    deviation = math.sqrt(float((parts.square + parts.n * (parts["mean"] - mean) ** 2).sum()) / every)
    at = percentile * (every - 1)
    found = cut(counted.where("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n")))
    places = {p: holding(found, p, 0, None) for p in {math.floor(at), math.ceil(at)}}
    low, high = min(x for x, _ in places.values()), max(x for x, _ in places.values())
    values = cut(meet_folds(blocks, inside, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")))
    for above, shift in zip(STEPS[:-1], STEPS[1:], strict=True):
        found = cut(values.groupBy(F.shiftright("bits", shift).alias("bin")).agg(F.sum("n").alias("n")))
        places = {p: holding(found, p, before, (x, above - shift)) for p, (x, before) in places.items()}
    low, high = (float(np.array([places[p][0]], np.int64).view(np.float64)[0]) for p in (math.floor(at), math.ceil(at)))
    share = at - math.floor(at)
    return low if share == 0 else low * (1.0 - share) + high * share, deviation


def _affinities(feat: DataFrame, percentile: float, rows: Callable[..., dict], schema: str) -> DataFrame:
    """``rows(i, j, r, c, d, affinity)`` of the pairs of two cameras under the exact percentile, which are those at places ``r`` of i and ``c`` of j."""
    blocks = meeting_blocks(feat)
    limit, sigma = _percentile_deviation(blocks, percentile)

    def fold(matrices):
        for i, cam_i, j, cam_j, d, own in matrices:
            at = np.flatnonzero((d < (-1.0 if limit is None else limit)) & _cross(i, cam_i, j, cam_j, own))
            if len(at):
                near = d.ravel()[at]
                yield rows(i, j, at // len(j), at % len(j), near, np.exp(-near / ((sigma or 0.0) + 1e-6)))

    return meet_folds(blocks, fold, schema)


def affinity_graph(feat: DataFrame, percentile: float = 0.05) -> DataFrame:
    """(i, j, d, affinity), i < j of two cameras, of the pairs under the exact percentile of such distances; affinity is exp(-d / (population deviation + 1e-6))."""

    def rows(i, j, r, c, d, affinity):
        return {"i": np.minimum(i[r], j[c]), "j": np.maximum(i[r], j[c]), "d": d, "affinity": affinity}

    return _affinities(feat, percentile, rows, "i long, j long, d double, affinity double")


_PACKED = "a binary, b binary, r binary, c binary, w binary"


def packed_affinity_graph(feat: DataFrame, percentile: float = 0.05) -> DataFrame:
    """``affinity_graph`` in blocks: 12 bytes an edge, which are its places (16 bits) among the ids ``a`` and ``b`` and its weight."""
    return _affinities(feat, percentile, lambda i, j, r, c, d, affinity: _packed_edges(i, j, r, c, affinity), _PACKED)


def _packed_edges(a, b, r, c, w) -> dict:
    return {name: [x.astype(t).tobytes()] for name, x, t in (("a", a, np.int64), ("b", b, np.int64), ("r", r, np.uint16), ("c", c, np.uint16), ("w", w, np.float64))}


def packed_graph(edges: DataFrame) -> DataFrame:
    """Edges (i, j, affinity), each once, in the blocks of ``packed_affinity_graph``."""

    def apply(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 15):
                i, j, w = (batch.column(c).slice(k, 1 << 15).to_numpy(zero_copy_only=False) for c in ("i", "j", "w"))
                (a, r), (b, c) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                yield pa.record_batch({n: pa.array(x) for n, x in _packed_edges(a, b, r, c, w).items()})

    return edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("affinity").cast("double").alias("w")).mapInArrow(apply, _PACKED)


def _edges(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("a", np.int64), ("b", np.int64), ("r", np.uint16), ("c", np.uint16), ("w", np.float64))]


#: Values of a vector that are added up in one place.
CHUNK = 1 << 16


def _times(graph: DataFrame, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a packed graph times ``x``, whose places are those of ``ids`` (ascending). A task adds up its edges, Spark the tasks' sums."""
    shared = graph.sparkSession.sparkContext.broadcast((ids, x))

    def apply(batches):
        ids, x = shared.value
        y = np.zeros(len(ids))
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, r, c, w = _edges(batch, k)
                a, b = (np.minimum(np.searchsorted(ids, s), len(ids) - 1) for s in (a, b))  # an id without an edge gets a place, but adds 0
                np.add.at(y, a, np.bincount(r, w * x[b][c], len(a)))
                np.add.at(y, b, np.bincount(c, w * x[a][r], len(b)))
        for n in range(0, len(y), CHUNK):
            yield pa.record_batch({"chunk": pa.array([n // CHUNK]), "y": pa.array([y[n : n + CHUNK].tobytes()])})

    def add(batches):
        sums = {}
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, y = batch.column("chunk")[k].as_py(), np.frombuffer(batch.column("y")[k].as_buffer())
                sums[chunk] = sums[chunk] + y if chunk in sums else y.copy()
        for chunk, y in sums.items():
            yield pa.record_batch({"chunk": pa.array([chunk]), "y": pa.array([y.tobytes()])})

    schema = "chunk long, y binary"
    rows = graph.mapInArrow(apply, schema).repartition(-(-len(ids) // CHUNK), "chunk").mapInArrow(add, schema).collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r.y) for r in sorted(rows, key=lambda r: r.chunk)])


def line_means(x: np.ndarray, k: int, seed: int = 0, starts: int = 10) -> np.ndarray:
    """Labels of k-means of numbers, by ascending centre: the best of ``starts`` k-means++ starts. Fewer than k distinct numbers have fewer labels."""
    order = np.argsort(x, kind="stable")
    s = x[order] - x.mean()
    upto, rng, best = np.append(0.0, np.cumsum(s)), np.random.default_rng(seed), None
    for _ in range(starts):
        centres = s[[rng.integers(len(s))]]
        near = np.square(s - centres[0])
        while len(centres) < k and (total := near.sum()) > 0:
            centres = np.append(centres, s[rng.choice(len(s), p=near / total)])
            near = np.minimum(near, np.square(s - centres[-1]))
        centres = np.sort(centres)
        for _ in range(300):
            ends = np.concatenate([[0], np.searchsorted(s, (centres[1:] + centres[:-1]) / 2), [len(s)]])
            n = np.diff(ends)
            new = np.where(n > 0, np.diff(upto[ends]) / np.maximum(n, 1), centres)
            if (new == centres).all():
                break
            centres = new
        cost = np.square(s - np.repeat(centres, n)).sum()
        if best is None or cost < best[0]:
            best = cost, np.repeat(np.arange(len(n)), n)
    labels = np.empty(len(x), np.int64)
    labels[order] = best[1]
    return labels


def power_iteration_clusters(graph: DataFrame, k: int, seed: int = 0, iterations: int = 15) -> DataFrame:
    """(idx, label) of the nodes of a packed graph (``packed_affinity_graph``, ``packed_graph``) by power iteration clustering: related to spectral clustering, not equal to it.

    A seeded normal vector is multiplied with the matrix, its rows scaled to sum 1, until its step stops to change (as Spark's ``PowerIterationClustering``
    does); k-means divides its values. The edges are written once and read once a product; the vector (8 bytes a node) is on the driver and in each task.
    """
    spark, graph = graph.sparkSession, cut(graph)

    def nodes(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                a, b, r, c, _ = _edges(batch, n)
                seen = np.union1d(seen, np.append(a[np.bincount(r, minlength=len(a)) > 0], b[np.bincount(c, minlength=len(b)) > 0]))
        yield pa.record_batch({"idx": pa.array(seen)})

    ids = np.sort(graph.mapInArrow(nodes, "idx long").distinct().toPandas().idx.to_numpy(np.int64))
    schema = "idx long, label int"
    if not len(ids):
        return spark.createDataFrame([], schema)
    degree = np.maximum(_times(graph, ids, np.ones(len(ids))), np.finfo(np.float64).eps)
    x = np.random.default_rng(seed).normal(size=len(ids))
    x /= np.abs(x).sum()
    step = np.inf
    for _ in range(iterations):
        new = _times(graph, ids, x) / degree
        new /= np.abs(new).sum() or 1.0
        last, step, x = step, float(np.abs(new - x).sum()), new
        if abs(step - last) <= max(1e-5 / len(ids), 1e-8):
            break
    labels = line_means(x * len(ids), k, seed)
    return spark.createDataFrame(pd.DataFrame({"idx": ids, "label": labels.astype(np.int32)}), schema)
