"""Quality rules: plain text rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word 1- and 2-grams: one of trusted documents,
one of the raw corpus. A document's score is the mean over its n-grams of
log(p_trusted / p_raw), so length doesn't matter, and every document is kept exactly if its
score reaches a fixed threshold. Counts cover all documents. Each task adds its documents' n-grams up
in a table of ``BUCKETS`` and sends what isn't 0, part by part; the sums make one table of ratios, whose size (4
bytes a bucket) is a parameter and doesn't grow with the corpus, and which scores every document without a shuffle.

The bucket space may fill up: the rare n-grams of a large corpus then lie evenly over all buckets, about 1 /
``BUCKETS`` of the corpus in each, so an n-gram that is more frequent than that keeps its ratio, whatever the corpus's
size, and a rarer one's goes to 0, as ``rare`` has it in small corpora anyway.

Null and empty texts have no words: they fail the base rules, with score 0. Texts are read whole,
however long. Repeated rows are scored one by one, so ties get equal verdicts. If no document is trusted,
or there are none, all ratios are 0. Empty tables give empty results. Other columns of ``docs`` are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import docblocks as db
from vicinity.llm import textblocks as tb
from vicinity.llm.shared import small

BUCKETS = 1 << 24
SMOOTHING = 0.3
SMOOTHED = 1 << 15
RARE = 10.0
THRESHOLD = -0.27
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
LABELS_TO_BROADCAST = 1_000_000
PART = 1 << 18
_COUNTED = 1 << 31  # n-grams after which a task sends its counts, which are 32-bit numbers
_COUNTS = "part long, found binary, raw binary, trusted binary"
_SUMS = _COUNTS + ", all_raw long, all_trusted long"
_ROWS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def gram_buckets(words: tb.Words, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 1- and 2-gram, and the row it is in."""
    rows = words.rows()
    pairs, first = words.grams(hashes, 2)
    h = np.concatenate([hashes, pairs])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[first]])


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers packed byte by byte, so that their empty high bytes cost nothing."""
    return db.pack(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(db.unpack(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _packed_counts(raw: np.ndarray, good: np.ndarray) -> pa.Table:
    """The counts that aren't 0, by part."""
    out = []
    for part in range(-(-len(raw) // PART)):
        r, g = raw[part * PART :][:PART], good[part * PART :][:PART]
        found = np.flatnonzero(r)
        if len(found):
            out.append((part, _planes(np.diff(found, prepend=0)), _planes(r[found]), _planes(g[found])))
    return db.table_of(out, _COUNTS)


def _count(batches, buckets: int):
    """The n-grams of documents (text, trusted) by bucket: in all rows, and in the trusted ones."""
    raw, good = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint32)
    counted = 0
    for batch in batches:
        flag = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        for block in tb.blocks(batch, "text"):
            words = block.lower().words(tb.NOT_SPACE)
            b, rows = gram_buckets(words, words.hashes(), buckets)
            np.add.at(raw, b, np.ones(len(b), np.uint32))
            b = b[flag[block.first + rows]]
            np.add.at(good, b, np.ones(len(b), np.uint32))
            counted += len(rows)
            if counted >= _COUNTED:
                yield from _packed_counts(raw, good).to_batches()
                raw[:], good[:], counted = 0, 0, 0
    if counted:
        yield from _packed_counts(raw, good).to_batches()


def _sum(rows: pa.Table) -> pa.Table:
    """The counts of one part's buckets over all tasks."""
    total = np.zeros((2, PART), np.int64)
    for row in rows.to_pylist():
        at = np.cumsum(_numbers(row["found"]))
        for t, k in zip(total, ("raw", "trusted"), strict=True):
            t[at] += _numbers(row[k])
    found = np.flatnonzero(total[0])
    return db.table_of([(rows.column("part")[0].as_py(), _planes(np.diff(found, prepend=0)), *(_planes(t[found]) for t in total), *(int(t.sum()) for t in total))], _SUMS)


def log_ratios(raw: np.ndarray, good: np.ndarray, all_raw: int, all_good: int, buckets: int, smoothing: float = SMOOTHING, rare: float = 0.0) -> np.ndarray:
    """log(p_trusted / p_raw) of buckets with these counts, of ``all_raw`` and ``all_good`` n-grams.

    ``smoothing`` a bucket, in no more than ``SMOOTHED`` buckets, draws the trusted counts towards the raw distribution;
    ``rare`` draws each bucket's ratio to 0 as that many neutral occurrences would, whatever the corpus and the bucket space.
    """
    if not all_good:
        return np.zeros(len(raw))
    mass = smoothing * min(buckets, SMOOTHED)
    p_raw = (raw + rare + mass / buckets) / (all_raw + mass)
    return np.log((good + rare * all_good / all_raw + mass * p_raw) / (all_good + mass)) - np.log(p_raw)


def ratio_table(flagged: DataFrame, buckets: int, rare: float) -> np.ndarray:
    """The log ratio of every bucket; ``flagged`` is (text, trusted)."""
    parts = flagged.select("text", "trusted").mapInArrow(lambda it: _count(it, buckets), _COUNTS).groupBy("part").applyInArrow(_sum, _SUMS).collect()
    all_raw, all_good = (sum(r[k] for r in parts) for k in ("all_raw", "all_trusted"))
    out = np.empty(buckets, np.float32)
    out[:] = log_ratios(np.zeros(1), np.zeros(1), all_raw, all_good, buckets, rare=rare)[0] if all_raw else 0
    for r in parts:
        out[r["part"] * PART + np.cumsum(_numbers(r["found"]))] = log_ratios(_numbers(r["raw"]), _numbers(r["trusted"]), all_raw, all_good, buckets, rare=rare)
    return out


def _rows_of(block: tb.Block, ratios: np.ndarray) -> dict:
    """Counts and scores of rows; ``ratios`` are those of the buckets."""
    words = block.words(tb.NOT_SPACE)
    prefix = block.prefix()
    n = words.counts
    rows = words.rows()
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])  # code points before each byte
    word_chars = np.bincount(rows, lead[words.ends] - lead[words.starts], minlength=block.n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])[block.at]
    grams, first = words.grams(words.hashes(prefix), WINDOW)
    repeated = np.zeros(len(rows) + 1, np.int64)
    if len(grams):
        order = np.lexsort((grams, rows[first]))
        g, r = grams[order], rows[first][order]
        same = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = first[order][twice]
        repeated += np.bincount(start, minlength=len(rows) + 1)[: len(rows) + 1]
        repeated -= np.bincount(start + WINDOW, minlength=len(rows) + 1)[: len(rows) + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated)[:-1] > 0)])[words.at]
    low = block.lower().words(tb.NOT_SPACE)
    buckets, in_row = gram_buckets(low, low.hashes(), len(ratios))
    total, grams_in = np.bincount(in_row, ratios[buckets], minlength=block.n), np.bincount(in_row, minlength=block.n)
    dup = np.zeros(block.n, np.int64)
    raw = block.data.tobytes()
    for i, (a, b) in enumerate(zip(block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": n.astype(np.int64), "word_chars": word_chars, "n_symbols": np.diff(symbols), "n_dup_lines": dup, "n_repeat_words": np.diff(covered), "score": total / np.maximum(grams_in, 1)}


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD, rare: float = 0.0, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) judged against those whose doc_id is in ``trusted_ids`` (doc_id): every row's doc_id, base counts, ``base_failed``, ``score`` and ``kept``."""
    keys = trusted_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = docs.join(small(keys, LABELS_TO_BROADCAST), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(flagged, buckets, rare))  # 4 bytes a bucket, whatever the data

    def rules(batches):
        for batch in batches:
            for block in tb.blocks(batch, "text"):
                out = _rows_of(block, table.value)
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * out["n_words"])
                out |= {"base_failed": failed, "kept": ~failed & (np.round(out["score"], 9) >= threshold)}
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(block.first, block.n)} | {k: pa.array(v) for k, v in out.items()})

    return docs.mapInArrow(rules, _ROWS)
