"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), which is
linear in the number of features and factors. It is fitted with Adam on at most ``max_rows``
labelled rows (those with the smallest hashes of doc_id), which is the one bounded sample here;
every row is scored, over its whole text.

Null and empty texts have no words and are scored by their statistics. Repeated rows get equal
scores; ties among the sampled hashes go to the lower doc_id. Without labelled rows every score is 0.5. Null metadata
counts as 0. Texts are read whole, however long. Empty tables give empty results. Columns that aren't named are ignored, or
carried by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import textblocks as tb

WORD_BUCKETS = 1 << 14
FACTORS = 8
MAX_ROWS = 8192
METADATA = ("n_chars",)
_STATISTICS = 11


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = [_class(x) for x in (bytes(range(0x41, 0x5B)), b"#*$%&<>", b"|", b"0123456789", b"!?", b"\n", b".,;:")]


def features(block: tb.Block, metadata: np.ndarray, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), by row. Word counts have length 1 in each row; statistics lie in about 0 to 1."""
    low = block.lower()
    words = low.words(tb.NOT_SPACE)
    hashes, rows, n = words.hashes(), words.rows(), words.counts
    key, count = np.unique(rows * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    r = key // buckets
    norm = np.sqrt(np.bincount(r, count.astype(float) ** 2, minlength=block.n))
    size, some = np.maximum(np.diff(block.at), 1), np.maximum(n, 1)
    shares = [np.diff(np.concatenate([[0], np.cumsum(c[block.data])])[block.at]) for c in _CLASSES]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    stats = [np.log1p(n) / 12, size / some / 20, *[s / size * 4 for s in shares], np.bincount(r, minlength=block.n) / some, np.bincount(rows[again], minlength=block.n) / some]
    dense = np.column_stack([*stats, *np.log1p(np.maximum(metadata, 0)).T / 15])
    m = dense.shape[1]
    row = np.concatenate([r, np.repeat(np.arange(block.n), m)])
    index = np.concatenate([key % buckets, buckets + np.tile(np.arange(m), block.n)])
    value = np.concatenate([count / norm[r], np.minimum(dense, 2).ravel()])
    order = np.argsort(row, kind="stable")
    return row[order], index[order], value[order]


def raw_scores(model: Model, row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and each row's sums of v * x."""
    vx = model.v[index] * value[:, None]
    sums = np.column_stack([np.bincount(row, vx[:, f], minlength=n) for f in range(vx.shape[1])])
    squares = np.bincount(row, (vx * vx).sum(1), minlength=n)
    return model.bias + np.bincount(row, model.w[index] * value, minlength=n) + 0.5 * ((sums * sums).sum(1) - squares), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], n_features: int, *, factors: int = FACTORS, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> Model:
    """Adam on the logistic loss. ``rows``: (features, values, label) each."""
    rng = np.random.default_rng(7)
    p = {"b": np.zeros(1), "w": np.zeros(n_features), "v": rng.normal(0, 0.05, (n_features, factors))}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            part = [rows[j] for j in order[i : i + batch]]
            n = len(part)
            row = np.repeat(np.arange(n), [len(x[0]) for x in part])
            index, value, label = np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part]), np.array([x[2] for x in part])
            out, sums = raw_scores(Model(p["b"][0], p["w"], p["v"]), row, index, value, n)
            g = (sigmoid(out) - label) / n
            gx = g[row] * value
            dv = gx[:, None] * (sums[row] - p["v"][index] * value[:, None])
            grad = {"b": np.array([g.sum()]), "w": np.bincount(index, gx, minlength=n_features) + decay * p["w"],
                    "v": np.column_stack([np.bincount(index, dv[:, f], minlength=n_features) for f in range(factors)]) + decay * p["v"]}
            step += 1
            for k, d in grad.items():
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.001 * (d * d - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(p["b"][0]), p["w"], p["v"])


def _metadata(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    cols = [np.nan_to_num(batch.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)) for c in columns]
    return np.column_stack(cols) if cols else np.zeros((batch.num_rows, 0))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, buckets: int = WORD_BUCKETS, metadata: tuple[str, ...] = METADATA) -> Model:
    """A model of ``labels`` (doc_id, label 0 or 1) over ``docs``; at most ``max_rows`` rows reach the driver."""
    sample = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.select("doc_id", "text", *metadata).join(F.broadcast(sample), "doc_id")

    def extract(batches):
        for batch in batches:
            extra = _metadata(batch, metadata)
            for block in tb.blocks(batch, "text"):
                row, index, value = features(block, extra[block.first : block.first + block.n], buckets)
                at = np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(block.first, block.n), "label": batch.column("label").slice(block.first, block.n),
                    "index": pa.ListArray.from_arrays(pa.array(at), pa.array(index.astype(np.int32))), "value": pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32))),
                })

    got = chosen.withColumn("label", F.col("label").cast("double")).mapInArrow(extract, "doc_id long, label double, index array<int>, value array<float>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toArrow()
    index, value, label = got["index"].combine_chunks(), got["value"].combine_chunks(), got["label"].to_numpy()
    rows = [(index[i].values.to_numpy(), value[i].values.to_numpy().astype(float), float(label[i])) for i in range(got.num_rows)]
    n_features = buckets + _STATISTICS + len(metadata)
    return fit(rows, n_features) if rows else Model(0.0, np.zeros(n_features), np.zeros((n_features, 1)))


def score(docs: DataFrame, model: Model, *, buckets: int = WORD_BUCKETS, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.5 on) of every row."""
    schema = docs.select("doc_id").schema.add("score", "double").add("predicted", "integer")

    def apply(batches):
        for batch in batches:
            extra = _metadata(batch, metadata)
            for block in tb.blocks(batch, "text"):
                p = sigmoid(raw_scores(model, *features(block, extra[block.first : block.first + block.n], buckets), block.n)[0])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(block.first, block.n), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.select("doc_id", "text", *metadata).mapInArrow(apply, schema)


def keep_good(docs: DataFrame, model: Model, *, buckets: int = WORD_BUCKETS, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""

    def apply(batches):
        for batch in batches:
            extra, keep = _metadata(batch, metadata), np.zeros(batch.num_rows, bool)
            for block in tb.blocks(batch, "text"):
                p = sigmoid(raw_scores(model, *features(block, extra[block.first : block.first + block.n], buckets), block.n)[0])
                keep[block.first : block.first + block.n] = p >= 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(apply, docs.schema)
