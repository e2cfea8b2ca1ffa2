"""A causal self-attention language model, trained in numpy on subword ids, scores every text.

Tokens are lower-cased words (runs of bytes other than ASCII white space) and one end a text; a
public tokenizer splits words into subword ids, and an end is one more id. The model predicts each
id from the ids before it. A place's input is the embedding of the id before it plus one of the two ids before
it (hashed to ``PAIR_ROWS`` rows); one head of masked attention with relative position weights over the
window is added, and a two-level softmax gives the id's class: first its group, then the class within the group.
Frequent ids have a class of their own, the others share classes by hash, and the ids of a class share its
probability by their counts in the training documents. So each id's probability is proper: all ids' sum to 1 in any context.

``score`` is the sum of the log10 probabilities of a text's ids, the end included: the model's alone.

Training is data parallel and takes every training document, whole. The blocks of documents are dealt by hash
to ``TURNS``, a small one first; in a turn each task trains from the common parameters on its own blocks, in windows that
don't overlap, and the mean of the tasks' parameters is the next turn's (embedding rows weighted by how often
each task met them). Corpora of fewer than ``LEAST_IDS`` ids are passed over up to ``MOST_PASSES`` times. What reaches the
driver (one set of parameters, and counts by id) doesn't grow with the corpus.

Scoring cuts a document's ids into windows that overlap by ``CONTEXT``; a window scores the ids after its
context, so each id is scored once. Beside it stands ``base_score``, that of unigram counts smoothed with
0.1 over all training documents: blocks ask buckets for the counts of their distinct words, and nothing is left out.

Texts are tokenised once and whole, however long; their ids are kept in the checkpoint folder. A process keeps the ids of words
that it has split, by their hashes, and starts anew beyond ``KNOWN_WORDS``. Null and empty texts
are one end. Repeated rows get a row each and count each; ties in frequency go to the lower id. A null
doc_id is never held out. With no training documents, counts are 0 and the model is as it starts. Empty tables give
empty results. Other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import docblocks as db
from vicinity.llm import textblocks as tb
from vicinity.llm.shared import cut

CONTEXT, WINDOW = 8, 32
WIDTH, KEY_WIDTH = 16, 8
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
SHARED_CLASSES = 64
PAIR_ROWS = 1 << 14
WINDOWS_A_STEP = 256
RATE, ROW_RATE = 0.01, 0.1
TURNS = (1, 3, 12)  # of 16 parts of the blocks
LEAST_IDS, MOST_PASSES = 4_000_000, 4
TASK_IDS = 1 << 20
BLOCK_BYTES = 4 << 20
BUCKET_WORDS = 1 << 21
KNOWN_WORDS = 1 << 20
ALPHA = 0.1
_END = np.uint64(0xE4D0E4D0E4D0E4D1)  # the end's word hash
_BLOCKS = "block long, turn int, ids long, words long, docs binary, sizes binary, tokens binary, subwords binary, which binary, hashes binary, counts binary"
_ASKS = "bucket long, block long, hashes binary, counts binary"
_ANSWERS = "block long, bucket long, counts binary, tokens long, types long"
_SCORED = "block long, docs binary, tokens binary, scores binary, which binary, hashes binary"
_PIECES = "name string, piece long, weights binary, rows binary"
_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_MASKED = np.float32(-1e9)
_HIGHEST = np.float32(60)
_FEW = 4  # times that a row is met
_AT_ONCE, _PIECE = 2048, 512  # rows of the softmax, and of one product


def is_held_out(ids: np.ndarray) -> np.ndarray:
    """crc32 of the doc_id's decimal text, modulo 10, is 0."""
    return np.array([i != db.NO_ID and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.tolist()], dtype=bool)


class Subwords:
    """A byte-pair tokenizer over single words; the id after the last rank is the end."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.size = self.end + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in table.items() if t[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.known_at, self.known_sizes, self.known_ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int32))

    def by_hash(self, hashes: np.ndarray, words: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """As a call, for words of ascending ``hashes``: ``words`` gives those at some places, of which only new ones are split; the process keeps up to ``KNOWN_WORDS``."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.known))
        new[inside] = self.known[at[inside]] != hashes[inside]
        new = np.flatnonzero(new)
        ids, sizes = self(words(new))
        self.known_at = np.insert(self.known_at, at[new], len(self.known_ids) + np.cumsum(sizes) - sizes)
        self.known_sizes = np.insert(self.known_sizes, at[new], sizes)
        self.known = np.insert(self.known, at[new], hashes[new])
        self.known_ids = np.concatenate([self.known_ids, ids.astype(np.int32)])
        at = np.searchsorted(self.known, hashes)
        sizes = self.known_sizes[at]
        first = np.cumsum(sizes) - sizes
        return self.known_ids[np.repeat(self.known_at[at] - first, sizes) + np.arange(sizes.sum())], sizes

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int64)
        first = np.flatnonzero(self.begins[ids])
        if len(first) == len(words) and first[0] == 0:
            return ids, np.diff([*first, len(ids)])
        each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)


_LOADED: dict[tuple, Subwords] = {}


def _subwords(shared) -> Subwords:
    """The tokenizer of a broadcast (ranks, pattern), made once a worker process."""
    ranks, pattern = shared.value[:2]
    key = (zlib.crc32(ranks), pattern)
    if key not in _LOADED:
        _LOADED[key] = Subwords(ranks, pattern)
    return _LOADED[key]


class Tokens:
    """The tokens of some texts: distinct hashes, which one each token is, and each text's tokens; with the subword ids, if asked for."""

    def __init__(self, block: tb.Block, subwords: Subwords | None):
        low = block.lower()
        words = low.words(tb.NOT_SPACE)
        n = words.counts + 1
        self.at = np.concatenate([[0], np.cumsum(n)])
        every = np.full(self.at[-1], _END, np.uint64)
        inside = np.ones(len(every), bool)
        inside[self.at[1:] - 1] = False
        every[inside] = words.hashes()
        order = np.argsort(every)
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        self.hashes, first = every[new], order[new]  # any place of a word will do
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.rows = np.repeat(np.arange(block.n), n)
        if subwords is None:
            return
        place = np.cumsum(inside) - 1  # of each token among the words
        raw = low.data.tobytes()
        real = np.flatnonzero(inside[first])
        at = place[first[real]]
        ids, sizes = subwords.by_hash(self.hashes[real], lambda new: [raw[a:b] for a, b in zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist(), strict=True)])
        count = np.ones(len(self.hashes), np.int64)
        count[real] = sizes
        table = np.full(count.sum(), subwords.end, np.int64)
        begin = np.cumsum(count) - count
        table[np.repeat(begin[real], sizes) + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids
        n = count[self.which]
        self.token_at = np.concatenate([[0], np.cumsum(n)])  # each token's first id
        self.ids = table[np.repeat(begin[self.which] - self.token_at[:-1], n) + np.arange(self.token_at[-1])]
        self.ids_at = self.token_at[self.at]


def _planes(values: np.ndarray, kind: type) -> bytes:
    """Numbers packed byte by byte, so that their empty high bytes cost nothing."""
    return db.pack(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes())


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(db.unpack(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def encode(docs: DataFrame, shared, block_bytes: int) -> DataFrame:
    """``_BLOCKS``: documents in blocks, with their subword ids, distinct words and which word each token is."""

    def apply(batches):
        subwords, number = _subwords(shared), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").fill_null(db.NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in tb.blocks(batch, "text", block_bytes):
                t = Tokens(block, subwords)
                mine = ids[block.first : block.first + block.n]
                counts = np.bincount(t.which[~is_held_out(mine)[t.rows]], minlength=len(t.hashes))
                part = int(tb.mix(np.array([number + 1], np.uint64))[0] % np.uint64(sum(TURNS)))
                turn = int(np.searchsorted(np.cumsum(TURNS), part, "right"))
                row = (number, turn, len(t.ids), len(t.hashes), mine.tobytes(), _planes(np.diff(t.ids_at), np.int64), _planes(np.diff(t.at), np.int64), _planes(t.ids, np.int32), _planes(t.which, np.int32), _planes(np.diff(t.hashes, prepend=np.uint64(0)), np.uint64), _planes(counts, np.int64))
                yield db.table_of([row], _BLOCKS).to_batches()[0]
                number += 1

    return docs.select("doc_id", "text").mapInArrow(apply, _BLOCKS)


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's training documents, and where each document's begin."""
    sizes, ids = _numbers(row["sizes"], np.int64), _numbers(row["subwords"], np.int32)
    train = ~is_held_out(np.frombuffer(row["docs"], np.int64))
    return ids[np.repeat(train, sizes)], np.concatenate([[0], np.cumsum(sizes[train])])


def _rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


def id_counts(blocks: DataFrame, size: int) -> DataFrame:
    """(id, n): subword ids in the training documents."""

    def count(batches):
        out = np.zeros(size, np.int64)
        for row in _rows_of(batches):
            out += np.bincount(_training(row)[0], minlength=size)
        some = np.flatnonzero(out)
        yield pa.record_batch({"id": pa.array(some), "n": pa.array(out[some])})

    return blocks.select("docs", "sizes", "subwords").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The class of each id, its log share of the class, and the classes' shares."""

    def __init__(self, counts: np.ndarray):
        n, own = len(counts), CLASSES - SHARED_CLASSES
        mixed = tb.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        top = np.argsort(-counts, kind="stable")[:own]
        self.classes = (own + (mixed % np.uint64(SHARED_CLASSES)).astype(np.int64)).astype(np.int16)
        self.classes[top] = np.arange(len(top))
        smooth = counts + 0.5
        total = np.bincount(self.classes, smooth, minlength=CLASSES)
        self.log_share = np.log(smooth / total[self.classes]).astype(np.float32)
        total = np.maximum(total, 1e-300).reshape(GROUPS, MEMBERS)
        logs = np.log(total.sum(1) / total.sum()), np.log(total / total.sum(1, keepdims=True))
        self.log_group, self.log_member = (np.where(x < -200, _MASKED, x).astype(np.float32) for x in logs)  # a small vocabulary has classes without ids


#: Parameters that are tables of embedding rows; the others are dense.
_TABLES = ("one", "two")


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """one, two: embeddings of an id (the last row is a text's start) and of two; group, member: the softmax's levels."""
    rng = np.random.default_rng(11)
    d, normal = WIDTH, lambda sd, *shape: rng.normal(0, sd, shape).astype(np.float32)
    return {"one": normal(0.1, CLASSES + 1, d), "two": normal(0.02, PAIR_ROWS, d), "wq": normal(d**-0.5, d, KEY_WIDTH), "wk": normal(d**-0.5, d, KEY_WIDTH),
            "wv": normal(d**-0.5, d, d), "wo": normal(0.1 * d**-0.5, d, d), "rel": np.zeros(WINDOW, np.float32), "group": normal(0.3 * d**-0.5, d, GROUPS),
            "group_b": vocabulary.log_group.copy(), "member": normal(0.3 * d**-0.5, GROUPS, d, MEMBERS), "member_b": vocabulary.log_member.copy()}


@cache
def _pair_rows() -> np.ndarray:
    """The row of each two classes."""
    return (tb.mix(np.arange((CLASSES + 1) ** 2, dtype=np.uint64) + np.uint64(7)) % np.uint64(PAIR_ROWS)).astype(np.int16)


class Windows:
    """Texts' ids in windows of ``WINDOW`` places, of which the first ``context`` are only read."""

    def __init__(self, classes: np.ndarray, at: np.ndarray, context: int):
        self.context, self.classes, self.at = context, classes, at
        n = np.diff(at)
        some = at[:-1][n > 0]
        self.one = np.empty(len(classes), np.int16)  # the id before each place
        self.one[1:], self.one[some] = classes[:-1], CLASSES
        pair = np.empty(len(classes), np.int32)  # the id before that, and it
        pair[1:], pair[some] = self.one[:-1], CLASSES
        pair *= CLASSES + 1
        pair += self.one
        self.two = _pair_rows()[pair]
        scored = WINDOW - context
        count = -(-n // scored)
        self.text = np.repeat(np.arange(len(n)), count)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        self.begin = number * scored - context
        self.end = n[self.text]

    def __len__(self) -> int:
        return len(self.text)

    def places(self, chosen) -> tuple[np.ndarray, np.ndarray]:
        """The chosen windows' places among all ids, and whether each is in its text."""
        place = self.begin[chosen][:, None] + np.arange(WINDOW)
        ok = (place >= 0) & (place < self.end[chosen][:, None])
        return np.where(ok, place + self.at[:-1][self.text[chosen]][:, None], 0), ok


def _offsets(context: int) -> np.ndarray:
    return np.arange(context, WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def _with_last(x: np.ndarray, last: np.ndarray | float, axis: int = -1) -> np.ndarray:
    """``x`` with one more column (or, along axis -2, row)."""
    out = np.empty([n + (k == axis % x.ndim) for k, n in enumerate(x.shape)], np.float32)
    if axis == -1:
        out[..., :-1], out[..., -1] = x, last
    else:
        out[..., :-1, :], out[..., -1, :] = x, last
    return out


def _joined(p: dict[str, np.ndarray]) -> np.ndarray:
    """What gives a place's query, key and value at once; the value's goes through ``wo`` right away."""
    return np.concatenate([p["wq"] * np.float32(KEY_WIDTH**-0.5), p["wk"], p["wv"] @ p["wo"]], axis=1)


def forward(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, ok: np.ndarray, context: int) -> tuple:
    """States (windows x scored places, WIDTH) from rows of the tables (windows, WINDOW), and what training needs.

    Rows may also be one array: the first window's context and then all windows' scored places, each window's context being the end of the one before.
    """
    n, d = len(ok), WIDTH
    e = p["one"].take(one, 0)
    e += p["two"].take(two, 0)
    qkv = e.reshape(-1, d) @ _joined(p)
    if one.ndim == 1:
        a, b = qkv.strides
        qkv, x = as_strided(qkv, (n, WINDOW, qkv.shape[1]), ((WINDOW - context) * a, a, b), writeable=False), e[context:].reshape(n, -1, d)
    else:
        qkv, x = qkv.reshape(n, WINDOW, -1), e[:, context:]
    q, k, v = qkv[:, context:, :KEY_WIDTH], qkv[:, :, KEY_WIDTH : 2 * KEY_WIDTH], qkv[:, :, 2 * KEY_WIDTH :]
    s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))  # small products are slow on a transposed view
    off = _offsets(context)
    s += np.where(off >= 0, p["rel"][np.maximum(off, 0)], _MASKED)
    some = np.flatnonzero(~ok[:, :context].all(1))  # places behind a text's end are later than all that count
    if len(some):
        s[some] += np.where(ok[some], np.float32(0), _MASKED)[:, None, :]
    if s.max() > _HIGHEST:
        s -= s.max(2, keepdims=True)
    a = np.exp(s, out=s)
    r = (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(1e-30))).reshape(n, -1, 1)
    o = a @ v
    o *= r
    return (x + o).reshape(-1, d), (e, q, k, v, a, o, r)


def _exp(z: np.ndarray) -> np.ndarray:
    if z.size and z.max() > _HIGHEST:
        z -= z.max(1, keepdims=True)
    return np.exp(z, out=z)


def class_log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, train: bool, target: np.ndarray | None = None) -> tuple:
    """Log probability of class y in each state h; in training also the gradients of their mean's negative, over the rows in ``target``.

    Rows are sorted by group, so that both levels of a group's rows are one product, and taken ``_AT_ONCE`` at a time, which
    stay in the cache; biases are one more row of the weights.
    """
    n, d = h.shape
    group = y // np.int16(MEMBERS)
    order = np.argsort(group, kind="stable")  # 16-bit numbers: a radix sort
    back = np.empty_like(order)
    back[order] = np.arange(n)
    hs, group, member = _with_last(h, 1.0).take(order, 0), group.take(order), (y % np.int16(MEMBERS)).take(order)
    both = np.empty((GROUPS, d + 1, GROUPS + MEMBERS), np.float32)
    both[:, :-1, :GROUPS], both[:, -1, :GROUPS], both[:, :-1, GROUPS:], both[:, -1, GROUPS:] = p["group"], p["group_b"], p["member"], p["member_b"]
    logs = np.empty(n, np.float32)
    if train:
        share = np.full(n, 1 / n, np.float32) if target is None else target.take(order).astype(np.float32) / np.float32(target.sum())
        ds, dm, turned = np.empty_like(h), np.zeros_like(both), np.ascontiguousarray(both[:, :-1].transpose(0, 2, 1))
    for i in range(0, n, _AT_ONCE):
        part = slice(i, i + _AT_ONCE)
        x, m = hs[part], len(group[part])
        new = np.arange(m) % _PIECE == 0  # where another product begins
        new[1:] |= group[part][1:] != group[part][:-1]
        cuts = np.flatnonzero(new)
        spans = list(zip(group[part][cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), m], strict=True))
        z = np.empty((m, GROUPS + MEMBERS), np.float32)
        for g, a, b in spans:
            np.matmul(x[a:b], both[g], out=z[a:b])
        levels = _exp(z.reshape(2 * m, -1))  # two rows a state, as GROUPS == MEMBERS
        total = (levels @ np.ones(MEMBERS, np.float32)).reshape(m, 2)
        own = np.empty((m, 2), np.int64)
        own[:, 0], own[:, 1] = group[part], member[part]
        own += np.arange(0, 2 * m * MEMBERS, MEMBERS).reshape(m, 2)
        got = z.ravel().take(own) / total
        two = np.log(got)
        np.add(two[:, 0], two[:, 1], out=logs[part])
        if not train:
            continue
        weight = share[part][:, None]
        levels *= (weight / total).reshape(-1, 1)
        z.ravel()[own] = got * weight - weight
        for g, a, b in spans:
            np.matmul(z[a:b], turned[g], out=ds[i + a : i + b])
            dm[g] += x[a:b].T @ z[a:b]
    if not train:
        return logs.take(back), None, None
    dg = dm[:, :, :GROUPS].sum(0)
    return logs.take(back), ds.take(back, 0), {"group": dg[:-1], "group_b": dg[-1], "member": dm[:, :-1, GROUPS:], "member_b": dm[:, -1, GROUPS:]}


def _row_sums(rows: np.ndarray, d: np.ndarray, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of d by row, and how many each has; of the chosen places or all."""
    if chosen is not None:
        rows = rows.take(chosen)
    order = np.argsort(rows, kind="stable")
    r = rows.take(order)
    if chosen is not None:
        order = chosen.take(order)
    new = np.ones(len(r) + 1, bool)
    new[1:-1] = r[1:] != r[:-1]
    bounds = np.flatnonzero(new)
    first, counts = bounds[:-1], bounds[1:] - bounds[:-1]
    if len(first) * 8 < len(r):
        return r.take(first), np.add.reduceat(d.take(order, 0), first, axis=0), counts
    out = d.take(order.take(first), 0)  # most rows are met once or twice: reduceat would cost a call each
    few = counts <= _FEW
    for k in range(1, _FEW):
        some = np.flatnonzero(few & (counts > k))
        out[some] = out.take(some, 0) + d.take(order.take(first.take(some) + k), 0)
    if not few.all():
        many = np.flatnonzero(~few)
        n = counts.take(many)
        out[many] = np.add.reduceat(d.take(order[np.repeat(~few, counts)], 0), np.cumsum(n) - n, axis=0)
    return r.take(first), out, counts


def gradients(p: dict[str, np.ndarray], w: Windows, chosen) -> tuple[dict, dict]:
    """Of the mean cross entropy of the classes in the chosen windows: dense ones, and (rows, sums, counts) of the tables."""
    place, ok = w.places(chosen)
    one, two = w.one.take(place), w.two.take(place)
    h, (e, q, k, v, a, o, r) = forward(p, one, two, ok, w.context)
    d, whole = WIDTH, ok.all()
    y = w.classes.take(place[:, w.context :].ravel())
    _, dh, g = class_log_probabilities(p, h, y, True, None if whole else ok[:, w.context :].ravel())
    flat = lambda t: t.reshape(-1, t.shape[-1])
    wide = np.empty((*o.shape[:2], d + 1), np.float32)
    do = np.multiply(dh.reshape(o.shape), r, out=wide[:, :, :-1])
    np.negative(np.einsum("nij,nij->ni", do, o), out=wide[:, :, -1])
    ds = wide @ _with_last(v.transpose(0, 2, 1), 1.0, -2)
    ds *= a
    dqkv = np.empty((len(e), WINDOW, 2 * KEY_WIDTH + d), np.float32)
    dqkv[:, : w.context, :KEY_WIDTH] = 0
    np.matmul(ds, k, out=dqkv[:, w.context :, :KEY_WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, KEY_WIDTH : 2 * KEY_WIDTH])
    np.matmul(a.transpose(0, 2, 1), do, out=dqkv[:, :, 2 * KEY_WIDTH :])
    dqkv, off = flat(dqkv), _offsets(w.context)
    g["rel"] = np.bincount(np.maximum(off, 0).ravel(), np.where(off >= 0, ds.sum(0), 0).ravel(), minlength=WINDOW).astype(np.float32)
    joined = sum(flat(e)[i : i + _PIECE].T @ dqkv[i : i + _PIECE] for i in range(0, len(dqkv), _PIECE))
    dwq, dwk, dwv = joined[:, :KEY_WIDTH], joined[:, KEY_WIDTH : 2 * KEY_WIDTH], joined[:, 2 * KEY_WIDTH :]
    g |= {"wq": dwq * np.float32(KEY_WIDTH**-0.5), "wk": dwk, "wv": dwv @ p["wo"].T, "wo": p["wv"].T @ dwv}
    de = (dqkv @ _joined(p).T).reshape(e.shape)
    de[:, w.context :] += dh.reshape(o.shape)
    de, read = flat(de), None if whole else np.flatnonzero(ok)
    return g, {"one": _row_sums(one.ravel(), de, read), "two": _row_sums(two.ravel(), de, read)}


class Trainer:
    """Parameters on their way: Adam for the dense ones, Adagrad by row for the tables."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.names = [k for k in p if k not in _TABLES]
        self.dense = np.concatenate([p[k].ravel() for k in self.names])  # one array, of which ``p`` has parts
        parts = np.split(self.dense, np.cumsum([p[k].size for k in self.names])[:-1])
        self.p = {k: v.copy() for k, v in p.items()} | {k: x.reshape(p[k].shape) for k, x in zip(self.names, parts, strict=True)}
        self.mean, self.square = np.zeros_like(self.dense), np.zeros_like(self.dense)
        self.rows = {k: np.full(len(p[k]), 1e-10, np.float32) for k in _TABLES}
        self.met = {k: np.zeros(len(p[k])) for k in _TABLES}
        self.steps, self.ids = 0, 0

    def step(self, w: Windows, chosen) -> None:
        self.steps += 1
        dense, tables = gradients(self.p, w, chosen)
        slower = 1 / (1 + self.steps / 1000)
        g, m, s = np.concatenate([dense[k].ravel() for k in self.names]), self.mean, self.square
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        self.dense -= np.float32(RATE * slower / (1 - 0.9**self.steps)) * m / (np.sqrt(s / np.float32(1 - 0.99**self.steps)) + np.float32(1e-8))
        for k, (rows, g, met) in tables.items():
            s = self.rows[k].take(rows) + (g * g) @ np.full(WIDTH, 1 / WIDTH, np.float32)
            self.rows[k][rows] = s
            g *= (np.float32(ROW_RATE * slower) / np.sqrt(s))[:, None]
            self.p[k][rows] = self.p[k].take(rows, 0) - g
            self.met[k][rows] += met

    def learn(self, vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray, seed: int) -> None:
        """Takes every window of these texts once."""
        w = Windows(vocabulary.classes[ids], at, 0)
        order = np.random.default_rng(seed).permutation(len(w))
        for i in range(0, len(order), WINDOWS_A_STEP):
            self.step(w, order[i : i + WINDOWS_A_STEP])
        self.ids += len(ids)


def _pieces(t: Trainer) -> pa.Table:
    """A task's parameters by piece, with the rows' weights."""
    out = []
    for k, v in t.p.items():
        rows = v if k in _TABLES else v.reshape(1, -1)
        weight = t.met[k] + 1e-6 if k in _TABLES else np.array([t.ids + 1e-6])
        out += [(k, i, weight[i : i + 512].astype(np.float32).tobytes(), rows[i : i + 512].tobytes()) for i in range(0, len(rows), 512)]
    return db.table_of(out, _PIECES)


def _mean(table: pa.Table) -> pa.Table:
    """The weighted mean of the tasks' rows of one piece."""
    total, weights = 0.0, 0.0
    for r in table.to_pylist():
        w = np.frombuffer(r["weights"], np.float32).astype(np.float64)
        total = total + np.frombuffer(r["rows"], np.float32).reshape(len(w), -1) * w[:, None]
        weights = weights + w
    return db.table_of([(r["name"], r["piece"], weights.astype(np.float32).tobytes(), (total / weights[:, None]).astype(np.float32).tobytes())], _PIECES)


def train(blocks: DataFrame, vocabulary: Vocabulary, *, least_ids: int = LEAST_IDS, task_ids: int = TASK_IDS) -> dict[str, np.ndarray]:
    """Parameters after all turns over ``_BLOCKS``."""
    spark, p = blocks.sparkSession, start(vocabulary)
    ids = {r["turn"]: r["ids"] for r in blocks.groupBy("turn").agg(F.sum("ids").alias("ids")).collect()}
    passes = min(MOST_PASSES, max(1, -(-least_ids // max(1, sum(ids.values())))))
    for turn in sorted(ids):
        at = spark.sparkContext.broadcast((p, vocabulary))  # its size doesn't depend on the data

        def fit(batches, at=at, turn=turn):
            trainer, kept = Trainer(at.value[0]), []
            for row in _rows_of(batches):
                got = _training(row)
                trainer.learn(at.value[1], *got, seed=turn)
                if passes > 1:  # then the whole corpus is small
                    kept.append(got)
            for again in range(1, passes):
                for got in kept:
                    trainer.learn(at.value[1], *got, seed=again * 100 + turn)
            yield from _pieces(trainer).to_batches()

        rows = blocks.where(F.col("turn") == turn).select("docs", "sizes", "subwords").coalesce(max(1, -(-ids[turn] // task_ids)))
        pieces = rows.mapInArrow(fit, _PIECES).groupBy("name", "piece").applyInArrow(_mean, _PIECES).orderBy("name", "piece").collect()
        p = {k: np.frombuffer(b"".join(bytes(r["rows"]) for r in pieces if r["name"] == k), np.float32).reshape(v.shape).copy() for k, v in p.items()}
    return p


def log_probabilities(p: dict, vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray, batch: int = WINDOWS_A_STEP) -> np.ndarray:
    """Natural log probability of each id given those before it in its text."""
    out = np.zeros(len(ids))
    w = Windows(vocabulary.classes[ids], at, CONTEXT)
    for i in range(0, len(w), batch):
        place, ok = w.places(slice(i, i + batch))
        rows = np.concatenate([place[0, :CONTEXT], place[:, CONTEXT:].ravel()])
        h, _ = forward(p, w.one.take(rows), w.two.take(rows), ok, CONTEXT)
        target = ok[:, CONTEXT:].ravel()
        where = place[:, CONTEXT:].ravel()
        if not target.all():
            some = np.flatnonzero(target)
            h, where = h.take(some, 0), where.take(some)
        out[where] = class_log_probabilities(p, h, w.classes.take(where), False)[0]
    return out + vocabulary.log_share[ids]


def _ask(batches, buckets: int):
    """Each block's distinct words and their counts in its training documents, by bucket."""
    for row in _rows_of(batches):
        hashes, counts = np.cumsum(_numbers(row["hashes"], np.uint64), dtype=np.uint64), _numbers(row["counts"], np.int64)
        out = [(b, row["block"], _planes(np.diff(hashes[r], prepend=np.uint64(0)), np.uint64), _planes(counts[r], np.int64)) for b, r in db.by_bucket(db.bucket_of(hashes, buckets))]
        yield from db.table_of(out, _ASKS).to_batches()


def _answer(rows: pa.Table) -> pa.Table:
    parts = rows.to_pylist()
    hashes = [np.cumsum(_numbers(r["hashes"], np.uint64), dtype=np.uint64) for r in parts]
    _, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, np.concatenate([_numbers(r["counts"], np.int64) for r in parts])).astype(np.int64)
    at = np.cumsum([0, *map(len, hashes)])
    out = [(r["block"], r["bucket"], _planes(total[which[a:b]], np.int64), 0, 0) for r, a, b in zip(parts, at[:-1], at[1:], strict=True)]
    out[0] = (*out[0][:3], int(total.sum()), int((total > 0).sum()))
    return db.table_of(out, _ANSWERS)


def score(docs: DataFrame, ranks: bytes, pattern: str, *, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS, alpha: float = ALPHA, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``ranks`` are the lines of a byte-pair vocabulary, ``pattern`` its pre-tokenisation.
    """
    sc = docs.sparkSession.sparkContext
    words = Subwords(ranks, pattern)
    shared = sc.broadcast((ranks, pattern))  # a vocabulary file: its size doesn't depend on the data
    blocks = cut(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shared, block_bytes))
    counts = np.zeros(words.size)
    for row in id_counts(blocks, words.size).toArrow().to_pylist():
        counts[row["id"]] = row["n"]
    vocabulary = Vocabulary(counts)
    model = sc.broadcast((train(blocks, vocabulary, **options), vocabulary))
    buckets = max(16, -(-(blocks.agg(F.sum("words")).first()[0] or 0) // bucket_words))
    asks = blocks.select("block", "hashes", "counts").mapInArrow(lambda it: _ask(it, buckets), _ASKS)
    answers = cut(asks.groupBy("bucket").applyInArrow(_answer, _ANSWERS))
    known = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = known.tokens or 0, known.types or 0

    def model_scores(batches):
        for row in _rows_of(batches):
            ids, at = _numbers(row["subwords"], np.int32), np.concatenate([[0], np.cumsum(_numbers(row["sizes"], np.int64))])
            scores = np.add.reduceat(log_probabilities(*model.value, ids, at), at[:-1]) / np.log(10)  # a text has one id at least
            yield from db.table_of([(row["block"], row["docs"], row["tokens"], scores.tobytes(), row["which"], row["hashes"])], _SCORED).to_batches()

    def finish(scored: pa.Table, answers: pa.Table) -> pa.Table:
        row = scored.to_pylist()[0]
        hashes, which, n = np.cumsum(_numbers(row["hashes"], np.uint64), dtype=np.uint64), _numbers(row["which"], np.int32), _numbers(row["tokens"], np.int64)
        c = np.zeros(len(hashes), np.int64)
        got = {r["bucket"]: r["counts"] for r in answers.to_pylist()}
        for b, r in db.by_bucket(db.bucket_of(hashes, buckets)):
            c[r] = _numbers(got[b], np.int64)
        first = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((c + alpha) / (tokens + alpha * (types + 1)))[which], first)
        seen = np.add.reduceat((c > 0)[which].astype(np.int64), first)
        ids = pa.array([None if i == db.NO_ID else i for i in np.frombuffer(row["docs"], np.int64).tolist()], pa.int64())
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n), "n_known": pa.array(seen), "base_score": pa.array(base), "score": pa.array(np.frombuffer(row["scores"], np.float64))})

    scored = blocks.select("block", "docs", "sizes", "tokens", "subwords", "which", "hashes").mapInArrow(model_scores, _SCORED)
    scored = scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _SCORES)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
