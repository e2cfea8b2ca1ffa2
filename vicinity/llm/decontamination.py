"""Benchmark decontamination by greedy string tiling.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. Rolling hashes of
``MIN_TILE`` words (fewer for shorter items) are the seeds. Documents that have a seed passing a
Bloom bitmap of the benchmark's go to Spark, which joins seeds with the items that have them. A pair
goes on if its shared places could cover enough of the item at all. Its maximal matches, found by
running the rolling hashes of the item over the document and verified word by word, are then marked
longest first, none over marked words, until none of ``MIN_TILE`` words is left. The pair counts as
a leak if the tiles cover ``MIN_COVERAGE`` of the item's words, in whatever order they stand.

Null and empty texts and items never match. Ties between matches go to the earlier place in the
item, then in the document. Each of repeated rows is judged on its own; so is each repeated item.
Empty tables give an empty result. A null doc_id or item_id is carried through. Texts are taken whole, however long
and repetitive: what is held of a pair grows with the sum of its words, not with their product. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import textblocks as tb
from vicinity.llm.shared import cut, small

MIN_TILE = 5
MIN_COVERAGE = 0.8
PAIRS_AT_ONCE = 1 << 20
BLOOM_BITS = 1 << 23
ITEMS_TO_BROADCAST = 5_000


def _word_rows(rows: DataFrame, id_column: str, bloom: np.ndarray | None, min_tile: int, lengths: list[int]) -> DataFrame:
    """(id, uid, words, seeds): word hashes, and (seed, places) for each distinct seed; with a bitmap, rows without a passing seed are left out."""

    def apply(batches):
        for batch in batches:
            for block in tb.blocks(batch, "text"):
                words = block.lower().words(tb.ALNUM)
                hashes = words.hashes()
                in_row = words.rows()
                seeds: list[list] = [[] for _ in range(block.n)]
                for k in lengths:
                    grams, first = words.grams(hashes, k)
                    if bloom is None:
                        n = words.counts[in_row[first]]
                        hit = (n == k) if k < min_tile else np.ones(len(first), bool)
                    else:
                        hit = bloom[_bit(grams, 0)] & bloom[_bit(grams, 1)]
                    at = np.flatnonzero(hit)
                    pair, places = np.unique(np.column_stack([in_row[first[at]], grams[at].view(np.int64)]), axis=0, return_counts=True) if len(at) else (np.zeros((0, 2), np.int64), [])
                    for (r, g), c in zip(pair.tolist(), places, strict=True):
                        seeds[r].append({"seed": g, "places": int(c)})
                keep = [i for i in range(block.n) if seeds[i]]
                ids = batch.column("id").slice(block.first, block.n).take(pa.array(keep, pa.int64()))
                yield pa.record_batch({
                    "id": ids, "words": pa.array([hashes[words.at[i] : words.at[i + 1]].tobytes() for i in keep], pa.binary()),
                    "seeds": pa.array([seeds[i] for i in keep], pa.list_(pa.struct([("seed", pa.int64()), ("places", pa.int64())]))),
                })

    out = rows.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(apply, "id long, words binary, seeds array<struct<seed: long, places: long>>")
    return cut(out.withColumn("uid", F.monotonically_increasing_id()))


def _bit(grams: np.ndarray, which: int) -> np.ndarray:
    return ((grams >> np.uint64(32 * which)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bitmap(items: DataFrame) -> np.ndarray:
    """A Bloom bitmap of the items' seeds; ``BLOOM_BITS`` bits, gathered as at most that many / 32 numbers."""
    seed = F.explode("seeds.seed").alias("h")
    both = items.select(seed).select(F.explode(F.array(F.pmod(F.shiftrightunsigned("h", 32), F.lit(BLOOM_BITS)), F.pmod(F.col("h").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(BLOOM_BITS)))).alias("bit"))
    cells = both.groupBy(F.shiftright("bit", 5).alias("cell")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("bit").bitwiseAND(F.lit(31))).cast("long")).alias("bits")).toArrow()
    out = np.zeros((BLOOM_BITS // 32, 32), bool)
    for cell, bits in zip(cells["cell"].to_pylist(), cells["bits"].to_pylist(), strict=True):
        out[cell] |= (bits >> np.arange(32)) & 1 == 1
    return out.ravel()


def _starts(item: np.ndarray, doc: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """Where maximal matches begin: places in the item and in the document, some item places at a time.

    The pairs of a seed that both repeat are gone through, ``PAIRS_AT_ONCE`` at a time, but only the beginnings are kept:
    two runs of one word have as many as they have words, not as many as they have pairs.
    """
    n = high - low
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), PAIRS_AT_ONCE)).tolist()
    for a, b in zip([0, *cuts[1:]], [*cuts[1:], len(n)], strict=True) if cuts else [(0, 0)]:
        m = n[a:b]
        i = np.repeat(np.arange(a, b), m)
        j = order[np.repeat(low[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        first = (i == 0) | (j == 0) | (item[i - 1] != doc[j - 1])
        i, j = i[first], j[first]
        for s in range(k):
            same = item[i + s] == doc[j + s]
            i, j = i[same], j[same]
        yield i, j


def tiles(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (length, place in the item, place in the document) of each tile."""
    k = min(min_tile, len(item))
    if not k or len(doc) < k:
        return []

    def rolling(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + x[j : len(x) - k + 1 + j]
        return out

    a, b = rolling(item), rolling(doc)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    i, j = (np.concatenate(x) for x in zip(*_starts(item, doc, order, low, high, k), strict=True))
    if not len(i):
        return []
    length, on = np.full(len(i), k), np.arange(len(i))
    while len(on):  # a word further, where the match goes on
        x, y = i[on] + length[on], j[on] + length[on]
        on = on[(x < len(item)) & (y < len(doc))]
        x, y = i[on] + length[on], j[on] + length[on]
        on = on[item[x] == doc[y]]
        length[on] += 1
    queue = [(-int(m), int(x), int(y)) for m, x, y in zip(length, i, j, strict=True)]
    heapq.heapify(queue)
    in_item, in_doc, found = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while queue:
        m, x, y = heapq.heappop(queue)
        m = -m
        taken = in_item[x : x + m] | in_doc[y : y + m]
        if not taken.any():
            in_item[x : x + m] = in_doc[y : y + m] = True
            found.append((m, x, y))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # what is still free of it
            if e - s >= k:
                heapq.heappush(queue, (s - e, x + s, y + s))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile) of every pair that is a leak.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text).
    """
    items = _word_rows(benchmark, "item_id", None, min_tile, list(range(1, min_tile + 1)))
    items = items.withColumn("n", (F.octet_length("words") / 8).cast("long"))
    lengths = sorted(r.k for r in items.select(F.least("n", F.lit(min_tile)).cast("int").alias("k")).distinct().collect())
    rows = _word_rows(docs, "doc_id", _bitmap(items), min_tile, lengths)
    of_items = items.select(F.col("uid").alias("item"), "n", F.explode("seeds").alias("s")).select("item", "n", "s.seed", "s.places")
    shared = rows.select("uid", F.explode("seeds.seed").alias("seed")).join(of_items, "seed").groupBy("uid", "item", "n").agg(F.sum("places").alias("places"))
    pairs = shared.where(F.col("places") * F.least("n", F.lit(min_tile)) >= F.col("n") * min_coverage - 1e-9).select("uid", "item")
    right = items.select(F.col("uid").alias("item"), F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    both = pairs.join(rows.select("uid", F.col("id").alias("doc_id"), "words"), "uid").join(small(right, ITEMS_TO_BROADCAST), "item").select("doc_id", "words", "item_id", "item_words")

    def tile(batches):
        for batch in batches:
            out = []
            for doc, words, item, item_words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "words", "item_id", "item_words")), strict=True):
                a = np.frombuffer(item_words, np.uint64)
                got = tiles(a, np.frombuffer(words, np.uint64), min_tile)
                covered = sum(m for m, _, _ in got)
                if got and covered >= min_coverage * len(a) - 1e-9:
                    out.append((doc, item, len(a), covered, covered / len(a), len(got), max(got)[0]))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile"])

    return both.mapInArrow(tile, "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long, longest_tile long")
