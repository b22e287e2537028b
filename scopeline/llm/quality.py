"""Quality classifier: averaged subword embeddings with a softmax on top.

Each word and each run of three or four bytes is hashed to a learned vector, and
so is whether a word repeats the one before it; a document is the mean of the vectors of all its features, and a softmax over a
linear layer gives the label's probability. Vectors and layer are trained by
plain stochastic gradient descent in numpy on a bounded sample.

Because the layer is linear, a trained model folds to one number a feature (the
vector times the difference of the two output rows). Scoring then is one gather
and one mean over the text's bytes, with a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _fit, _text

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 2000
WORD_BITS, GRAM_BITS = 15, 16
#: After the words and both lengths of byte runs: a word that differs from the one before it, and one that repeats it.
SHAPE = (1 << WORD_BITS) + 2 * (1 << GRAM_BITS)
BUCKETS = SHAPE + 2
#: The mean is taken as if a text had so many further features without a vector, so that short texts lean to the prior.
PRIOR_FEATURES = 60


@dataclass(frozen=True)
class QualityModel:
    """``weight``: of each feature bucket, ``bias``: of an empty text."""

    weight: np.ndarray
    bias: float


def features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature, its buckets in text order, and where each row's begin and end."""
    start, end, row = _text.words(buf, off)
    word = _text.between(_text.prefix_hash(buf), start, end)
    rows = np.arange(len(off) - 1)
    begin, end = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    yield (word >> np.uint64(64 - WORD_BITS)).astype(np.int32), begin, end
    again = np.full(len(word), SHAPE, dtype=np.int32)
    again[1:] += (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    yield again, begin, end
    byte = buf.astype(np.uint32)
    for width, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        n = max(len(buf) - width + 1, 0)
        gram = byte[:n].copy()
        for k in range(1, width):
            gram <<= np.uint32(8)
            gram |= byte[k : k + n]
        bucket = ((gram * np.uint32(salt)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
        bucket += (1 << WORD_BITS) + (width - 3) * (1 << GRAM_BITS)
        begin = np.minimum(off[:-1], n)
        yield bucket, begin, np.maximum(begin, off[1:] - width + 1)  # no run reaches into the next row


def fit(pairs: list[tuple[str, int]], dim: int = 16, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> QualityModel:
    """Model of the label (1 or not) of (text, label) pairs; without pairs every score is 0.5."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, label in pairs:
        buf, off = _fit.joined([text])
        parts = [bucket[a[0] : b[0]] for bucket, a, b in features(buf, off)]
        bucket, count = np.unique(np.concatenate(parts), return_counts=True)
        if len(bucket):
            rows.append((bucket, (count / (count.sum() + PRIOR_FEATURES)).astype(np.float32), int(label == 1)))
    if not rows:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0)
    share = np.clip(np.mean([y for _, _, y in rows]), 1e-3, 1 - 1e-3)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, weight, y = rows[i]
            now = rate * (1 - step / steps)
            hidden = weight @ table[bucket]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= now * np.outer(hidden, p)
            bias -= 0.05 * now * p
            # the mean spreads a document's gradient over its features; scaled back by the count of distinct ones
            table[bucket] -= now * min(len(bucket), 400) * weight[:, None] * back[None, :]
            step += 1
    return QualityModel((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: QualityModel, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row; an empty row gets the prior."""
    rows = len(off) - 1
    total, count = np.zeros(rows), np.zeros(rows)
    for bucket, begin, end in features(buf, off):
        run = np.concatenate([[0.0], np.cumsum(model.weight[bucket], dtype=np.float64)])
        total += run[end] - run[begin]
        count += end - begin
    logit = model.bias + total / (count + PRIOR_FEATURES)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fits on at most ``rows`` labelled documents for which ``keep`` (a column over ``labels``) holds."""
    try:
        return fit(_fit.unlike(_fit.labelled(docs, labels, label, F.lit(True) if keep is None else keep, rows)))
    finally:
        _text.release()


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of ``docs``, in one pass without a shuffle.

    Null texts count as empty, repeated rows are each scored, other columns are
    ignored whatever their names, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _text.flat(batch.column(1))
            out = [scores(sent.value, b, o) for _, _, b, o in _text.chunks(buf, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return _text.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, score double")
