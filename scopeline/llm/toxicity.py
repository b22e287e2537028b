"""Toxic spans: a two-tag conditional random field, its marginals summed up to documents.

Documents, not tokens, carry labels, so the labelled tokens come first: a word
of a toxic document is a toxic token if the word, or its first four or five
bytes, occurs in labelled documents of which at least ``MIN_SHARE`` are toxic,
and in so many that among all words less than one would be marked by chance (by
Chernoff's bound, at the labels' own rate). The chain learns from these tokens through its word,
prefix and suffix features and its transitions; forward-backward gives each
word's probability of being toxic. A document's score is a logistic function of
its most toxic word and of the expected count of toxic words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _crf, _fit, _text

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 2500
MIN_SHARE = 0.8
AFFIXES = (("prefix", 4), ("prefix", 5), ("suffix", 4))
#: A word from this probability on belongs to an offending span.
SPAN_FROM = 0.5


def _digest(marginal: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Two columns a row: log-odds of the most toxic word, log of the expected count of toxic words."""
    top = np.zeros(rows)
    if len(row):
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        top[row[edge]] = np.maximum.reduceat(marginal, edge)
    mass = np.bincount(row, weights=np.where(marginal >= 0.1, marginal, 0), minlength=rows)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(mass)], axis=1)


def _token_tags(words: _crf.Chain, toxic: np.ndarray) -> np.ndarray:
    """1 for each word whose own form or prefix is a mark of toxic documents."""
    tag = np.zeros(len(words.row), dtype=np.int64)
    for f in words.feature[:3]:
        pair = np.unique(f.astype(np.int64) * len(toxic) + words.row)
        bucket, doc = pair // len(toxic), pair % len(toxic)
        size = 1 << _crf.BITS
        of = np.bincount(bucket, weights=toxic[doc], minlength=size)
        n = np.bincount(bucket, minlength=size)
        rate = np.clip(toxic.mean(), 1e-6, 1 - 1e-6)
        share = np.clip(of / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        surprise = n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
        mark = (share >= MIN_SHARE) & (share > rate) & (surprise >= np.log(np.count_nonzero(n) + 1))
        tag |= mark[f]
    return tag * toxic[words.row]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and intercept by damped Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge @ w
        w -= 0.7 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + ridge, slope)
    return w


def fit(pairs: list[tuple[str, int]]) -> _crf.Crf:
    """Model of (text, toxic) pairs; without a toxic pair every score is 0."""
    toxic = np.array([int(y == 1) for _, y in pairs], dtype=np.int64)
    buf, off = _fit.joined([t for t, _ in pairs])
    words = _crf.chain(buf, off, AFFIXES)
    tag = _token_tags(words, toxic) if len(toxic) else np.zeros(0, np.int64)
    if not tag.any():
        model = _crf.fit(_crf.chain(*_fit.joined([]), AFFIXES), tag[:0], [0, 1])
        model.extra["logistic"] = None
        return model
    # all sentences with a toxic token, and an eighth of the others: clean words are in great surplus
    sentence = np.repeat(np.arange(len(words.first)), words.length)
    keep = np.bincount(sentence, weights=tag) > 0
    keep |= np.random.default_rng(3).random(len(keep)) < 1 / 8
    model = _crf.fit(_crf.Chain(words.row, words.start, words.end, words.feature, words.first[keep], words.length[keep]), tag, [0, 1])
    marginal = _crf.marginals(model, words)[:, 1]
    model.extra["logistic"] = _logistic(_digest(marginal, words.row, len(toxic)), toxic)
    return model


def scores(model: _crf.Crf, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, _crf.Chain]:
    """Each row's score, each word's probability, and the words."""
    rows = len(off) - 1
    words = _crf.chain(buf, off, AFFIXES)
    if model.extra["logistic"] is None:
        return np.zeros(rows), np.zeros(len(words.row)), words
    marginal = _crf.marginals(model, words)[:, 1]
    w = model.extra["logistic"]
    logit = _digest(marginal, words.row, rows) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60))), marginal, words


def spans(buf: np.ndarray, off: np.ndarray, words: _crf.Chain, marginal: np.ndarray) -> list[list[dict]]:
    """Runs of toxic words of each row, as code-point offsets with the mean probability."""
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    hit = np.flatnonzero(marginal >= SPAN_FROM)
    if len(hit) == 0:
        return out
    point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    begin = np.flatnonzero((np.diff(hit, prepend=-9) != 1) | (np.diff(words.row[hit], prepend=-1) != 0))
    for a, b in zip(begin, np.append(begin[1:], len(hit)), strict=True):
        row = int(words.row[hit[a]])
        base = point[off[row]]
        out[row].append({"start": int(point[words.start[hit[a]]] - base), "end": int(point[words.end[hit[b - 1]]] - base), "score": float(marginal[hit[a:b]].mean())})
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, rows: int = TRAIN_ROWS) -> _crf.Crf:
    """Fits on at most ``rows`` labelled documents for which ``keep`` (a column over ``labels``) holds."""
    try:
        return fit(_fit.unlike(_fit.labelled(docs, labels, label, F.lit(True) if keep is None else keep, rows)))
    finally:
        _text.release()


def tag(docs: DataFrame, model: _crf.Crf) -> DataFrame:
    """doc_id, score, n_toxic_words and toxic_spans (start, end, score; code points) of every row.

    One pass over whole texts without a shuffle. Null texts count as empty and
    have no span; repeated rows are each scored; other columns are ignored
    whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many, total = [], [], [np.zeros(0)]
            buf, off = _text.flat(batch.column(1))
            for _, _, b, o in _text.chunks(buf, off):
                score, marginal, words = scores(sent.value, b, o)
                total.append(score)
                many += np.bincount(words.row[marginal >= SPAN_FROM], minlength=len(o) - 1).tolist()
                found += spans(b, o, words, marginal)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(total)), pa.array(many, pa.int64()), pa.array(found, span)], ["doc_id", "score", "n_toxic_words", "toxic_spans"])

    return _text.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, score double, n_toxic_words long, toxic_spans array<struct<start:int,end:int,score:double>>")


def below(docs: DataFrame, model: _crf.Crf, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``.

    The score goes along with the rows, so there is no join. Nulls and repeated
    rows as in ``tag``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _text.flat(batch.column("text"))
            score = np.concatenate([np.zeros(0), *(scores(sent.value, b, o)[0] for _, _, b, o in _text.chunks(buf, off))])
            yield batch.filter(pa.array(score < threshold))
            _text.release()

    return _text.map_batches(docs, run, docs.schema)
