"""Texts of Arrow batches as byte arrays, and their words, hashes and windows by numpy.

A text is read as UTF-8 bytes straight from the Arrow buffers (null counts as empty). Work is
done in blocks of a few MB, so memory does not depend on the size of a partition; a single
text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

#: Byte classes: True where a byte belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base & _MASK, dtype=np.uint64)
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[key][:n]


def raw_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Block:
    """Some rows of a batch: ``data`` is their texts' bytes, ``at[i]:at[i + 1]`` that of row ``first + i``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.first, self.n = first, len(at) - 1
        self.data = data[at[0] : at[-1]]
        self.at = at - at[0]

    def lower(self) -> "Block":
        out = Block.__new__(Block)
        out.first, out.n, out.at, out.data = self.first, self.n, self.at, LOWER[self.data]
        return out

    def words(self, inside: np.ndarray) -> "Words":
        return Words(self, inside)

    def prefix(self) -> np.ndarray:
        """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _powers(_ODD, len(self.data)), out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    inverse = pow(_ODD, -1, 1 << 64)
    return mix((prefix[ends] - prefix[starts]) * _powers(inverse, len(prefix))[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Maximal runs of bytes of a class within each row's text."""

    def __init__(self, block: Block, inside: np.ndarray):
        data, at = block.data, block.at
        is_in = inside[data]
        begin, end = is_in.copy(), is_in.copy()
        begin[1:] &= ~is_in[:-1]
        end[:-1] &= ~is_in[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word doesn't run on into the next text
        begin[edges] = is_in[edges]
        end[edges - 1] = is_in[edges - 1]
        self.block = block
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.starts, at)  # words at[i]:at[i + 1] are row i's
        self.counts = np.diff(self.at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return span_hash(self.block.prefix() if prefix is None else prefix, self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, and the index of each one's first word."""
        if len(hashes) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ok = np.ones(len(hashes) - k + 1, dtype=bool)
        for edge in range(1, k):  # not across texts
            cut = self.at[1:-1] - edge
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        first = np.flatnonzero(ok)
        out = np.zeros(len(first), np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[first + j]
        return mix(out + np.uint64(k)), first


def blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a batch in blocks of about ``block_bytes`` of text (one text at least)."""
    if batch.num_rows == 0:
        return
    data, at = raw_buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(at, at[i] + block_bytes, "right")) - 1
        j = min(max(j, i + 1), batch.num_rows)
        yield Block(data, at[i : j + 1], i)
        i = j


def word_hash(word: str) -> int:
    """The hash that ``Words.hashes`` gives this word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Block(raw, np.array([0, len(raw)]), 0).words(np.ones(256, bool)).hashes()[0])
