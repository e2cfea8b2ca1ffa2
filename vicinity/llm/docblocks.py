"""Documents dealt to blocks by hash and packed, and rows that blocks exchange with buckets."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from vicinity.llm import textblocks as tb

#: Stands for a null doc_id; larger than all others.
NO_ID = np.iinfo(np.int64).max
PACKED = "block long, ids binary, sums binary, sizes binary, text binary, carried binary"


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_documents(batches, blocks: int):
    """The documents (doc_id, text and, if there is one, a string ``carried``) of each batch, packed by block: rows of ``PACKED``."""
    for batch in batches:
        data, at = tb.raw_buffers(batch.column("text"))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        carried = batch.column("carried") if "carried" in batch.schema.names else None
        raw = memoryview(data)
        sums = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
        block = (tb.mix(ids.view(np.uint64) * np.uint64(31) + sums.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        out = []
        for b, rows in by_bucket(block):
            text = b"".join(raw[at[i] : at[i + 1]] for i in rows)
            out.append((b, ids[rows].tobytes(), sums[rows].tobytes(), (at[rows + 1] - at[rows]).tobytes(), pack(text), b"" if carried is None else pack(json.dumps(carried.take(pa.array(rows)).to_pylist()).encode())))
        for i in range(0, len(out), 64):
            yield from table_of(out[i : i + 64], PACKED).combine_chunks().to_batches()


class Documents:
    """A block's documents in an order that doesn't depend on how they came: ``text[at[i]:at[i + 1]]`` is that of ``ids[i]``."""

    def __init__(self, packed: pa.Table):
        rows = packed.to_pylist()
        ids, sums, sizes = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("ids", "sums", "sizes"))
        text = np.frombuffer(b"".join(unpack(r["text"]) for r in rows), np.uint8)
        carried = [x for r in rows for x in json.loads(unpack(r["carried"]))] if all(r["carried"] for r in rows) else None
        order = np.lexsort((sizes, sums, ids))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.carried = None if carried is None else [carried[i] for i in order]
        self.ids, self.sizes = ids[order], sizes[order]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.text = np.concatenate([text[a : a + n] for a, n in zip(starts[order], self.sizes, strict=True)]) if len(text) else text


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(h) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the places it occurs at."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else [0]
    return [(int(bucket[order[s]]), order[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, cols, strict=True)})
