"""Language of each word in code-switched text by a linear-chain conditional random field.

A word's features are its form (the lexicon), prefixes and suffixes, and the
runs of three bytes after its first, second and third; they cover ``LONGEST`` bytes,
and a longer run without spaces stands as several words, in even pieces, so all of
a text counts. Learned transitions say how readily neighbours change
language. Training text is whole documents of one language, cut into sentences,
and sequences that splice sentences of two languages, so that transitions are
learned from switches too. Forward-backward gives each word's language
probabilities; a document takes the language with the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _crf, _fit, _text

#: Documents of each language that a fit uses at most.
TRAIN_ROWS = 200
AFFIXES = (("prefix", 2), ("prefix", 3), ("suffix", 2), ("suffix", 3), ("suffix", 4), ("inner", 1), ("inner", 2), ("inner", 3))
#: Bytes of a word that the affixes cover: six from its start, four from its end.
LONGEST = 10
NONE = "und"
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _splice(words: _crf.Chain, tag: np.ndarray, rng: np.random.Generator) -> tuple[_crf.Chain, np.ndarray]:
    """The chain's sequences, a third of them joined by pieces with pieces of other sequences."""
    pick = rng.permutation(len(words.first))[: len(words.first) // 3 * 2]
    at, first, length, here = [], [], [], 0
    for a, b in zip(pick[::2], pick[1::2], strict=False):
        for one, two in ((a, b),):
            x = np.arange(words.first[one], words.first[one] + words.length[one])
            y = np.arange(words.first[two], words.first[two] + words.length[two])
            cut_x, cut_y = rng.integers(1, len(x) + 1), rng.integers(1, len(y) + 1)
            part = np.concatenate([x[:cut_x], y[:cut_y], x[cut_x:]])[: _crf.SPAN]
            at.append(part)
            first.append(here)
            length.append(len(part))
            here += len(part)
    index = np.concatenate(at) if at else np.zeros(0, np.int64)
    base = len(words.row)
    every = np.concatenate([np.arange(base), index])
    joined = _crf.Chain(words.row[every], every, every, [f[every] for f in words.feature], np.concatenate([words.first, base + np.array(first, np.int64)]), np.concatenate([words.length, np.array(length, np.int64)]))
    return joined, tag[every]


def fit(pairs: list[tuple[str, str]]) -> _crf.Crf:
    """Model of (text, language) pairs; without pairs nothing is ever recognised."""
    tags = sorted({y for _, y in pairs})
    buf, off = _fit.joined([t for t, _ in pairs])
    words = _crf.chain(buf, off, AFFIXES, LONGEST)
    tag = np.array([tags.index(y) for _, y in pairs], dtype=np.int64)[words.row] if pairs else np.zeros(0, np.int64)
    joined, tag = _splice(words, tag, np.random.default_rng(5))
    return _crf.fit(joined, tag, tags, epochs=3, rate=0.2)


def _lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    run = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    out = run[off[1:]] > run[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def shares(model: _crf.Crf, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, _crf.Chain]:
    """Each row's share of every language, each word's marginals, and the words."""
    rows, k = len(off) - 1, len(model.tags)
    words = _crf.chain(buf, off, AFFIXES, LONGEST)
    marginal = _crf.marginals(model, words)
    total = np.stack([np.bincount(words.row, weights=marginal[:, j], minlength=rows) for j in range(k)], axis=1) if k else np.zeros((rows, 0))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9), marginal, words


def train(docs: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS) -> _crf.Crf:
    """Fits on at most ``rows`` documents of each language for which ``keep`` (a column over ``docs``) holds."""
    try:
        return fit(_fit.unlike(_fit.labelled_by(docs, "lang", F.lit(True) if keep is None else keep, rows)))
    finally:
        _text.release()


def identify(docs: DataFrame, model: _crf.Crf, word_shares: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (the language's share) of every row; with ``word_shares`` all shares too.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. One pass over whole texts without a shuffle; repeated rows are each
    judged, other columns ignored whatever their names; equal shares go to the
    language first in order; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    names = np.array([*model.tags, NONE], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _text.flat(batch.column(1))
            names_out, scores_out, parts = [], [np.zeros(0)], []
            for _, _, b, o in _text.chunks(buf, off):
                share, _, _ = shares(sent.value, b, o)
                known = _lettered(b, o) & (share.sum(axis=1) > 0)
                best = np.where(known, share.argmax(axis=1) if share.shape[1] else 0, len(names) - 1)
                names_out += names[best].tolist()
                scores_out.append(np.where(known, share.max(axis=1, initial=0), 0.0))
                parts += share.tolist()
            columns = [batch.column(0), pa.array(names_out, pa.string()), pa.array(np.concatenate(scores_out))]
            if word_shares:
                columns.append(pa.array(parts, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares"][: len(columns)])

    schema = f"doc_id {kind.simpleString()}, lang_pred string, score double" + (", shares array<double>" if word_shares else "")
    return _text.map_batches(docs.select("doc_id", "text"), run, schema)
