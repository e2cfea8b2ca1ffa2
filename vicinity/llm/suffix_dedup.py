"""Exact removal of repeated byte strings with suffix arrays by bucket-pointer refinement.

Every byte is removed that a ``LENGTH``-byte string covers which also starts in a document with a
smaller doc_id, judged on the input. Texts are UTF-8 bytes; matches never cross documents.

The documents are dealt to blocks by hash. Of each ``LENGTH``-byte string the least 16-byte gram
(by hash, leftmost first) is its seed: equal strings have equal seeds, and neighbouring strings
mostly share theirs, so a block is a row of short segments, one a seed. Then

1. each block sends its seeds' hashes to buckets, which answer which of them occur in two
   documents or more, anywhere;
2. each block sends its distinct segments around those seeds to the seeds' buckets, each with the
   least doc_id that has it there;
3. each bucket sorts all suffixes of its segments up to depth ``LENGTH``: initial 5-gram buckets
   are refined by sorting on the bucket pointers 5, 10, 20, then ``LENGTH`` - 40 bytes on, where
   each pass writes the pointers that the next one reads and single suffixes drop out. Strings
   that end in one bucket are equal; the bucket answers, a bit a string, whether a smaller
   doc_id has it;
4. each block marks what the answers cover.

A block answers for copies within itself, so a passage or a text in any share of the documents
reaches a bucket once a block at most. Nothing but counts reaches the driver.

Hashes only choose candidates: what they call equal is compared byte by byte, within a block as in a bucket. Texts are
taken whole, however long.

Null and empty texts are kept, with nothing removed. Rows with one doc_id (ties) don't remove from one
another. Extra columns are ignored, or carried by ``kept_texts``, whatever their names. A null doc_id is larger than all others. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm import docblocks as db
from vicinity.llm import textblocks as tb

LENGTH = 50
SEED_BYTES = 16
INITIAL = 5  # bytes of the initial buckets
BLOCK_BYTES = 3 << 20
SLICE_BYTES = 1 << 19
_SEEDS = "bucket long, block long, hashes binary, several binary"
_ANSWERS = "block long, bucket long, pass int, bits binary"
_SEGMENTS = "bucket long, block long, docs binary, sizes binary, text binary"
_TEXTS = "doc_id long, text string, carried string"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Part(db.Documents):
    """A block's documents in one order, and their segments: ``[first, last + length)``, by seed."""

    def __init__(self, blobs: pa.Table, length: int):
        super().__init__(blobs)
        self.length = length
        self._segments()

    def _segments(self) -> None:
        """The segments of all documents, found some documents at a time: only the segments stay."""
        cuts, size = [0], 0
        for i, n in enumerate(self.sizes.tolist()):
            if size and size + n > SLICE_BYTES:
                cuts.append(i)
                size = 0
            size += n
        parts = [self._slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(self.sizes)], strict=True)]
        self.first, self.last, self.seed, self.content = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = np.searchsorted(self.at, self.first, "right") - 1

    def _slice(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last string, seed and content hash of each segment of documents a to b."""
        text, begin = self.text[self.at[a] : self.at[b]], self.at[a]
        n, q, length = len(text), SEED_BYTES, self.length
        long = self.sizes[a:b] >= length
        if not long.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        prefix = tb.Block(text, np.array([0, n]), 0).prefix()
        i = np.arange(n - q + 1)
        grams = tb.span_hash(prefix, i, i + q)
        low = (grams & ~np.uint64((1 << 31) - 1)) | i.astype(np.uint64)  # least hash, leftmost first
        w, have = length - q + 1, 1
        while 2 * have <= w:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        if w > have:
            low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
        at = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
        starts, ends = (self.at[a:b] - begin)[long], (self.at[a + 1 : b + 1] - begin - length)[long]
        ok = np.zeros(n - length + 2, dtype=np.int8)
        ok[starts] = 1
        ok[ends + 1] -= 1
        ok = np.cumsum(ok)[:-1] > 0
        ok[starts] = ok[ends] = True
        change = at[1:] != at[:-1]
        new, end = ok.copy(), ok.copy()
        new[1:] &= change
        end[:-1] &= change
        new[starts] = end[ends] = True
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        return first + begin, last + begin, grams[at[first]], tb.span_hash(prefix, first, last + length)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of seeds, and whether two doc_ids or more have each."""
        order = np.lexsort((self.doc, self.seed))
        h, ids = self.seed[order], self.ids[self.doc[order]]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        end = np.concatenate([edge[1:], [len(h)]]) - 1 if len(h) else edge
        return h[edge], ids[edge] != ids[end]

    def shared(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments around shared seeds; the first of each distinct content, by bucket; which of those each one is."""
        h, _ = self.seeds()
        is_shared = np.zeros(len(h), bool)
        bits = {r["bucket"]: r["bits"] for r in answers.to_pylist()}
        for b, mine in db.by_bucket(db.bucket_of(h, buckets)):
            is_shared[mine] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(mine)).astype(bool)
        rows = np.flatnonzero(is_shared[np.searchsorted(h, self.seed)]) if len(h) else np.zeros(0, np.int64)
        _, first, which = np.unique(self.content[rows], return_index=True, return_inverse=True)  # the first is of the least doc_id
        other = np.flatnonzero(~self._same(rows, rows[first[which]]))  # equal hashes, other bytes: each stands for itself
        which[other] = len(first) + np.arange(len(other))
        first = np.concatenate([first, other])
        order = np.lexsort((first, db.bucket_of(self.seed[rows[first]], buckets)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rows, rows[first[order]], rank[which]

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether segments a and b have the same bytes, eight at a time."""
        if not len(a):
            return np.zeros(0, bool)
        if self.length < 8:
            return np.array([np.array_equal(self.text[self.first[i] : self.last[i] + self.length], self.text[self.first[j] : self.last[j] + self.length]) for i, j in zip(a, b, strict=True)])
        eights = np.ndarray(len(self.text) - 7, np.uint64, np.ascontiguousarray(self.text), strides=(1,))
        size = self.last[a] - self.first[a] + self.length
        same = size == self.last[b] - self.first[b] + self.length
        for k in range(0, int(size.max()), 8):
            step = np.minimum(k, size - 8)
            at = np.flatnonzero(same & (a != b))
            same[at] = eights[(self.first[a] + step)[at]] == eights[(self.first[b] + step)[at]]
        return same


def _send_seeds(block: int, part: _Part, buckets: int) -> pa.Table:
    h, several = part.seeds()
    return db.table_of([(b, block, h[rows].tobytes(), np.packbits(several[rows]).tobytes()) for b, rows in db.by_bucket(db.bucket_of(h, buckets))], _SEEDS)


def _answer_seeds(rows: pa.Table) -> pa.Table:
    """Of each block's seeds in this bucket: is it in another block, or in several documents of its own?"""
    parts = rows.to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in parts]
    _, which, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(h)) for r, h in zip(parts, hashes, strict=True)]).astype(bool)
    yes = (count[which] > 1) | (np.bincount(which, several, minlength=len(count)) > 0)[which]
    at = np.cumsum([0, *map(len, hashes)])
    return db.table_of([(r["block"], r["bucket"], 1, np.packbits(yes[a:b]).tobytes()) for r, a, b in zip(parts, at[:-1], at[1:], strict=True)], _ANSWERS)


def _send_segments(block: int, part: _Part, answers: pa.Table, buckets: int) -> pa.Table:
    _, chosen, _ = part.shared(answers, buckets)
    sizes = part.last[chosen] + part.length - part.first[chosen]
    out = []
    for b, rows in db.by_bucket(db.bucket_of(part.seed[chosen], buckets)):
        text = b"".join(part.text[s : s + n] for s, n in zip(part.first[chosen[rows]].tolist(), sizes[rows].tolist(), strict=True))
        out.append((b, block, part.ids[part.doc[chosen[rows]]].tobytes(), sizes[rows].astype(np.int32).tobytes(), db.pack(text)))
    return db.table_of(out, _SEGMENTS)


def _sorted(high: np.ndarray, low: np.ndarray, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (high, low) in order, and where each one was. Where key and place fit 64 bits together, they are sorted as one number."""
    n = len(high)
    key = high.astype(np.uint64)
    key <<= np.uint64(low_bits)
    key |= low.astype(np.uint64)
    place = max(n - 1, 1).bit_length()
    if n and int(high.max()).bit_length() + low_bits + place <= 64:
        key <<= np.uint64(place)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << place) - 1)).astype(np.int32 if n < 2**31 else np.int64)
        key >>= np.uint64(place)
        return key, order
    order = np.argsort(key)
    return key[order], order


def _refine(pointer: np.ndarray, at: np.ndarray, on: int) -> None:
    """Splits the buckets of the suffixes ``at`` by the bucket pointers ``on`` bytes later, in place.

    A pointer is the place of a bucket's first suffix in the order so far; buckets of one suffix are left alone.
    """
    own = pointer[at]
    at = at[np.bincount(own)[own] > 1]
    if not len(at):
        return
    bits = len(pointer).bit_length()
    key, order = _sorted(pointer[at], pointer[at + on], bits)
    old = key >> np.uint64(bits)
    place = np.arange(len(key), dtype=np.int32)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    bucket = np.concatenate([[True], old[1:] != old[:-1]])
    begin = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(bucket, place, 0))
    pointer[at[order]] = old.astype(pointer.dtype) + begin.astype(pointer.dtype)


def repeated(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each ``length``-byte string of each segment, in order: does a segment of a smaller document have it?"""
    ends = np.cumsum(sizes)
    n, q = len(text), INITIAL
    padded = np.concatenate([text, np.zeros(q, np.uint8)])
    gram = np.zeros(n, np.uint64)
    for j in range(q):
        gram = (gram << np.uint64(8)) | padded[j : n + j]
    room = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)  # bytes from here to the segment's end
    at = np.flatnonzero(room >= q).astype(np.int32 if n < 2**31 else np.int64)
    key, order = _sorted(gram[at], np.zeros(1, np.uint64), 0)
    pointer = np.zeros(n, np.int32 if n < 2**31 else np.int64)
    pointer[at[order]] = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key), dtype=pointer.dtype), 0))
    del gram, order, key
    depth = q
    while 2 * depth < length:
        _refine(pointer, np.flatnonzero(room >= 2 * depth), depth)
        depth *= 2
    first = np.flatnonzero(room >= length)
    key, order = _sorted(pointer[first], pointer[first + length - depth], n.bit_length())
    owner = np.repeat(docs, sizes - length + 1)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(order) else order
    least = np.repeat(np.minimum.reduceat(owner[order], edge), np.diff([*edge, len(order)])) if len(order) else owner
    out = np.zeros(len(first), bool)
    out[order] = least < owner[order]
    return out


def _answer_segments(rows: pa.Table, length: int) -> pa.Table:
    parts = rows.to_pylist()
    sizes = [np.frombuffer(r["sizes"], np.int32).astype(np.int64) for r in parts]
    docs = [np.frombuffer(r["docs"], np.int64) for r in parts]
    text = np.frombuffer(b"".join(db.unpack(r["text"]) for r in parts), np.uint8)
    yes = repeated(text, np.concatenate(sizes), np.concatenate(docs), length)
    at = np.cumsum([0, *[int((s - length + 1).sum()) for s in sizes]])
    return db.table_of([(r["block"], r["bucket"], 2, np.packbits(yes[a:b]).tobytes()) for r, a, b in zip(parts, at[:-1], at[1:], strict=True)], _ANSWERS)


def _removed(part: _Part, answers: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the block's text go."""
    kind = answers.column("pass").to_numpy()
    rows, chosen, which = part.shared(answers.filter(pa.array(kind == 1)), buckets)
    strings = part.last[chosen] - part.first[chosen] + 1
    at = np.concatenate([[0], np.cumsum(strings)])
    yes = np.zeros(at[-1], bool)
    got = {r["bucket"]: r["bits"] for r in answers.filter(pa.array(kind == 2)).to_pylist()}
    for b, mine in db.by_bucket(db.bucket_of(part.seed[chosen], buckets)):
        lo, hi = at[mine[0]], at[mine[-1] + 1]  # the segments of a bucket stand together
        yes[lo:hi] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo).astype(bool)
    n = strings[which]
    later = part.ids[part.doc[rows]] > part.ids[part.doc[chosen[which]]]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = np.repeat(later, n) | yes[np.repeat(at[which], n) + step]
    begin = (np.repeat(part.first[rows], n) + step)[hit]
    depth = np.bincount(begin, minlength=len(part.text) + 1)
    depth -= np.bincount(begin + part.length, minlength=len(part.text) + 1)[: len(depth)]
    return np.cumsum(depth)[:-1] > 0


def _results(part: _Part, gone: np.ndarray) -> pa.Table:
    out = []
    for i, (doc, size) in enumerate(zip(part.ids.tolist(), part.sizes.tolist(), strict=True)):
        text, cut = part.text[part.at[i] : part.at[i + 1]], gone[part.at[i] : part.at[i + 1]]
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum()) if size else 0
        out.append((None if doc == db.NO_ID else doc, size, int(cut.sum()), spans, hashlib.sha256(text[~cut].tobytes()).hexdigest()))
    return db.table_of(out, _RESULT)


def _texts(part: _Part, gone: np.ndarray) -> pa.Table:
    kept = [part.text[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(part.at[:-1], part.at[1:], strict=True)]
    return db.table_of([(None if d == db.NO_ID else d, t, c) for d, t, c in zip(part.ids.tolist(), kept, part.carried, strict=True)], _TEXTS)


def _dedup(docs: DataFrame, finish, schema: str, length: int, block_bytes: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(16, -(-total // block_bytes))  # blocks
    m = 2 * n  # buckets
    blobs = docs.mapInArrow(lambda it: db.pack_documents(it, n), db.PACKED)
    by_block = blobs.groupBy("block")
    block_of = lambda t: t.column("block")[0].as_py()
    seeds = by_block.applyInArrow(lambda t: _send_seeds(block_of(t), _Part(t, length), m), _SEEDS)
    shared = seeds.groupBy("bucket").applyInArrow(_answer_seeds, _ANSWERS)

    def send(blob: pa.Table, answers: pa.Table) -> pa.Table:
        return _send_segments(block_of(blob), _Part(blob, length), answers, m)

    segments = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, _SEGMENTS)
    found = segments.groupBy("bucket").applyInArrow(lambda t: _answer_segments(t, length), _ANSWERS)

    def end(blob: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(blob, length)
        return finish(part, _removed(part, answers, m))

    return by_block.cogroup(shared.unionByName(found).groupBy("block")).applyInArrow(end, schema)


def removed_spans(docs: DataFrame, *, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    return _dedup(docs.select("doc_id", "text"), _results, _RESULT, length, block_bytes)


def kept_texts(docs: DataFrame, *, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with what is left of each text; a character that is cut in the middle goes as a whole.

    The other columns are carried as JSON, so they must be of types that JSON holds.
    """
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    carried = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in others])) if others else F.lit("{}")
    left = _dedup(docs.select("doc_id", "text", carried.alias("carried")), _texts, _TEXTS, length, block_bytes)
    if not others:
        return left.select("doc_id", "text")
    back = left.withColumn("o", F.from_json("carried", T.StructType(others)))
    return back.select(*[F.col(f"o.`{c}`") if c not in ("doc_id", "text") else F.col(c) for c in docs.columns])
