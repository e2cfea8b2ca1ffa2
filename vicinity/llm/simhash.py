"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at ``MAX_DISTANCE`` = 4 or fewer differing bits. It is cut
into three segments (22, 21 and 21 bits, each read as a word of the perfect binary Golay code
[23, 12, 7]). A segment decodes to the indices of all codewords within distance 4: one or six.
Two words at distance 2 or less always have such a codeword in common (a property of the code,
which a test checks for all of its cosets). Of 4 errors over three segments, the two segments
with the fewest have at most 2 together, so a linked pair shares, for one pair of segments, an
index of both: the pair of segments and the two indices are the join key. Fingerprints with a
common key are verified by their distance.

Copies meet as one fingerprint, so only distinct fingerprints are joined. A key's group gives
a spanning forest of its links, found by breadth-first search, not its pairs; a group over
``GROUP`` fingerprints is dealt to blocks and all pairs of blocks are searched, each in a task
of its own. Nothing is left out.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows each come out.
A null doc_id comes out, with the component of its fingerprint, whose id is the least doc_id
that isn't null. A bit that is set in exactly half of the shingles (a tie) is 0. Texts are read whole, however long. Empty
tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from vicinity.llm import textblocks as tb
from vicinity.llm.shared import cut
from vicinity.operators.clustering import components, on_hub

MAX_DISTANCE = 4
SHINGLE = 4
SEED = 42
GROUP = 8192
KEYS_A_TASK = 2_000_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    whole = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(whole, seed)
    else:
        digests = b"".join([xxh64_digest(whole[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    n = len(bits)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes(), "big")


def fingerprints(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def apply(batches):
        for batch in batches:
            data, at = tb.raw_buffers(batch.column("text"))
            raw = memoryview(data)
            out = np.array([fingerprint(bytes(raw[a:b]), **options) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(out.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp long")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 12 low and 11 high bits of a word, and each coset's patterns of weight 4 or less (as many as there are, then the first again)."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low, high = (np.array([syndrome(x << s) for x in range(1 << n)], dtype=np.int64) for s, n in ((0, 12), (12, 11)))
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            patterns[low[e & 4095] ^ high[e >> 12]].append(e)
    return low, high, np.array([p + p[:1] * (6 - len(p)) for p in patterns], dtype=np.int64)


def indices(word: np.ndarray) -> np.ndarray:
    """(n, 6) indices (the 12 high bits) of the codewords within distance 4 of each 23-bit word; -1 where there are fewer."""
    low, high, patterns = golay()
    e = patterns[low[word & 4095] ^ high[word >> 12]]
    out = (word[:, None] ^ e) >> 11
    out[:, 1:][e[:, 1:] == e[:, :1]] = -1
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of fingerprints (uint64), and the position of the fingerprint of each."""
    each = [indices(((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    found, owner = [], []
    for k, (i, j) in enumerate(itertools.combinations(range(len(SEGMENTS)), 2)):
        key = (np.int64(k) << 24) | (each[i][:, :, None] << 12) | each[j][:, None, :]
        ok = (each[i][:, :, None] >= 0) & (each[j][:, None, :] >= 0)
        found.append(key[ok])
        owner.append(np.nonzero(ok)[0])
    return np.concatenate(found), np.concatenate(owner)


def forest(fp: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    left, a, b = fp, [], []
    queue = np.zeros(0, fp.dtype)
    while len(left) or len(queue):
        if not len(queue):
            queue, left = left[:1], left[1:]
        u, queue = queue[0], queue[1:]
        near = np.bitwise_count(left ^ u) <= max_distance
        if near.any():
            new = left[near]
            a.append(np.full(len(new), u))
            b.append(new)
            queue, left = np.concatenate([queue, new]), left[~near]
    empty = np.zeros(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(key: np.ndarray, fp: np.ndarray, max_distance: int, wide: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys (sorted): pairs where a group is small, a forest where it isn't."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(cuts)
    a, b = [], []
    for g in np.flatnonzero(sizes > wide):
        x, y = forest(fp[cuts[g] : cuts[g + 1]], max_distance)
        a.append(x)
        b.append(y)
    at = np.flatnonzero(np.repeat((sizes <= wide) & (sizes > 1), sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, wide):
        at = at[at + step < len(key)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            break
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= max_distance
        a.append(fp[at[near]])
        b.append(fp[at[near] + step])
    empty = np.zeros(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _batch(key, block, a, b) -> pa.RecordBatch:
    n = len(a)
    return pa.record_batch({"key": pa.array(np.broadcast_to(np.asarray(key, np.int64), n)), "block": pa.array(np.broadcast_to(np.asarray(block, np.int64), n)), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


_LINKS = "key long, block long, a long, b long"


def _search(batches, group: int, max_distance: int):
    """Of rows sorted by key: links (block -1), and the rows of groups over ``group``, by block, for the pairs of blocks."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spilled, blocks = None, 0  # the key whose first rows have been passed on
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held_key = np.concatenate([held_key, batch.column("key").to_numpy()])
            held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
        whole = len(held_key) if batch is None else int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
        key, fp = held_key[:whole], held_fp[:whole]
        held_key, held_fp = held_key[whole:], held_fp[whole:]
        if spilled is not None and len(key) and key[0] == spilled:
            n = int(np.searchsorted(key, spilled, "right"))
            yield _batch(spilled, blocks, fp[:n], fp[:n])
            key, fp = key[n:], fp[n:]
        if len(key):
            large = np.repeat(*(lambda u: (u[1] > group, u[1]))(np.unique(key, return_counts=True)))
            if large.any():
                k, f = key[large], fp[large]
                place = np.arange(len(k)) - np.searchsorted(k, k)
                yield _batch(k, place // group, f, f)
            a, b = _links(key[~large], fp[~large], max_distance)
            if len(a):
                yield _batch(-1, -1, a, b)
        if len(held_key) > group and batch is not None:  # one group, still open
            if spilled != held_key[0]:
                spilled, blocks = held_key[0], 0
            while len(held_key) > group:
                yield _batch(spilled, blocks, held_fp[:group], held_fp[:group])
                blocks += 1
                held_key, held_fp = held_key[group:], held_fp[group:]
        elif len(held_key) and spilled is not None and held_key[0] != spilled:
            spilled = None


def _search_pairs(batches, max_distance: int):
    """Of rows sorted by (key, i, j): links within each pair of blocks."""
    held: list[np.ndarray] = []
    at = None
    for batch in batches:
        cols = np.column_stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        fp = batch.column("fp").to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], (cols[1:] != cols[:-1]).any(1)])) if len(cols) else []
        for s, e in zip(cuts, [*cuts[1:], len(cols)], strict=True):
            if at is not None and tuple(cols[s]) != at:
                yield _batch(-1, -1, *forest(np.concatenate(held), max_distance))
                held = []
            at = tuple(cols[s])
            held.append(fp[s:e])
    if held:
        yield _batch(-1, -1, *forest(np.concatenate(held), max_distance))


def links(distinct: DataFrame, n: int, *, max_distance: int = MAX_DISTANCE, group: int = GROUP, keys_a_task: int = KEYS_A_TASK) -> DataFrame:
    """(a, b): links among ``n`` distinct fingerprints (fp) that connect all that any links connect."""

    def explode(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 8192):
                key, owner = keys(fp[i : i + 8192])
                yield pa.record_batch({"key": pa.array(key), "fp": pa.array(fp[i : i + 8192][owner].view(np.int64))})

    tasks = max(16, -(-n * 85 // keys_a_task))
    keyed = distinct.mapInArrow(explode, "key long, fp long").repartition(tasks, "key").sortWithinPartitions("key", "fp")
    found = cut(keyed.mapInArrow(lambda it: _search(it, group, max_distance), _LINKS).where("block >= 0 or a <> b").distinct())
    edges, large = found.where("block < 0").select("a", "b"), found.where("block >= 0").select("key", "block", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    count = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    pairs = large.join(count, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return edges.unionByName(pairs.mapInArrow(lambda it: _search_pairs(it, max_distance), _LINKS).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, *, max_distance: int = MAX_DISTANCE, shingle: int = SHINGLE, **options) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (least doc_id reachable) of every row."""
    rows = cut(fingerprints(docs, shingle=shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select("fp"), distinct.count(), max_distance=max_distance, **options))
    rooted = cut(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    by_root = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    by_fp = on_hub(rooted.select("fp", "root"), by_root, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
