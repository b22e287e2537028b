"""Linear-chain conditional random field over hashed word features, many sequences at once.

A sequence is a sentence: it ends with a text, after a word that ends in one of
``.!?``, and after ``SPAN`` words. Forward and backward passes step through word
positions and handle every sequence of a chunk in one numpy call, so the cost is
``SPAN`` steps a chunk whatever the lengths of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import _text

SPAN = 48
BITS = 17
#: Tag pairs of words that a fit holds at a time, about.
PAIRS = 4_000_000
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
#: Marks that are no part of a word at either end.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?\"'()[]{}*#$%&|<>-_")] = True


@dataclass
class Chain:
    """Words of a chunk as sequences; ``feature``: one bucket a word for each kind."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: list[np.ndarray]
    first: np.ndarray
    length: np.ndarray


@dataclass
class Crf:
    """Log-linear weights; ``table[kind]`` has a row a bucket and a column a tag."""

    tags: list
    table: list[np.ndarray]
    move: np.ndarray
    begin: np.ndarray
    extra: dict = field(default_factory=dict)


def pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words cut into even pieces of at most ``longest`` bytes (4 at least), between characters, and each one's word."""
    size = end - start
    many = np.where(size > longest, -(-size // (longest - 3)), 1)
    word = np.repeat(np.arange(len(start)), many)
    at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    cut = start[word] + at * size[word] // many[word]
    for _ in range(3):  # a character has at most three bytes after its first
        cut -= (at > 0) & ((buf[cut] & 0xC0) == 0x80)
    after = np.append(cut[1:], 0)
    after[at == many[word] - 1] = end
    return cut, after, word


def chain(buf: np.ndarray, off: np.ndarray, affixes: tuple[tuple[str, int], ...], longest: int | None = None) -> Chain:
    """Sequences of the lower-cased words; marks at a word's ends are not part of its features.

    With ``longest``, longer words stand as several, in pieces of at most so many bytes.
    The texts are worked on a chunk at a time, so that little but the result is held.
    """
    parts, words = [], 0
    for first, _, b, o in _text.chunks(buf, off):
        part = _chain(b, o, affixes, longest)
        part.row += first
        part.start += off[first]
        part.end += off[first]
        part.first += words
        words += len(part.row)
        parts.append(part)
    if len(parts) == 1:
        return parts[0]
    none = np.zeros(0, np.int64)

    def every(of) -> np.ndarray:
        return np.concatenate([none, *(of(p) for p in parts)])

    feature = [np.concatenate([none.astype(np.int32), *(p.feature[k] for p in parts)]) for k in range(len(affixes) + 1)]
    return Chain(every(lambda p: p.row), every(lambda p: p.start), every(lambda p: p.end), feature, every(lambda p: p.first), every(lambda p: p.length))


def _chain(buf: np.ndarray, off: np.ndarray, affixes: tuple[tuple[str, int], ...], longest: int | None) -> Chain:
    low = _text.LOWER[buf]
    start, end, row = _text.words(low, off)
    if longest is not None and len(start):
        start, end, word = pieces(low, start, end, longest)
        row = row[word]
    n = len(start)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Chain(none.copy(), none.copy(), none.copy(), [none.astype(np.int32) for _ in range(len(affixes) + 1)], none.copy(), none.copy())
    new = np.ones(n, dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | _STOP[low[end[:-1] - 1]]
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    first = np.flatnonzero(since % SPAN == 0)
    length = np.diff(np.append(first, n))
    left, right = start.copy(), end.copy()
    for _ in range(3):
        left += (_MARK[low[left]]) & (right - left > 1)
        right -= (_MARK[low[right - 1]]) & (right - left > 1)
    run = _text.prefix_hash(low)
    shift = np.uint64(64 - BITS)
    feature = [_text.between(run, left, right) >> shift]
    for side, k in affixes:
        if side == "inner":  # the run of three bytes that starts k bytes into the word
            a, b, salt = np.minimum(left + k, right), np.minimum(left + k + 3, right), 0
        else:
            a = left if side == "prefix" else np.maximum(left, right - k)
            b = right if side == "suffix" else np.minimum(right, left + k)
            salt = k * 2 + (side == "suffix")
        feature.append(_text.mix(_text.between(run, a, b) + np.uint64(salt)) >> shift)
    return Chain(row, left, right, [f.astype(np.int32) for f in feature], first, length)


def potentials(model: Crf, words: Chain) -> np.ndarray:
    score = model.table[0][words.feature[0]]
    for table, f in zip(model.table[1:], words.feature[1:], strict=True):
        score = score + table[f]
    return np.exp(score - score.max(axis=1, keepdims=True))


def passes(model: Crf, words: Chain, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward values of each word, each scaled to sum to one."""
    order = np.argsort(-words.length, kind="stable")
    first, length = words.first[order], words.length[order]
    ahead, back = np.empty_like(psi), np.ones_like(psi)
    move, begin = np.exp(model.move).astype(psi.dtype), np.exp(model.begin).astype(psi.dtype)
    longest = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]  # sequences of more than t words
    for t in range(longest):
        at = first[: live[t]] + t
        value = psi[at] * (begin if t == 0 else ahead[at - 1] @ move)
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        value = (psi[at + 1] * back[at + 1]) @ move.T
        back[at] = value / value.sum(axis=1, keepdims=True)
    return ahead, back


def marginals(model: Crf, words: Chain) -> np.ndarray:
    """Probability of each tag for each word by forward-backward."""
    if len(words.row) == 0 or not model.tags:
        return np.zeros((len(words.row), len(model.tags)), np.float32)
    ahead, back = passes(model, words, potentials(model, words))
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def fit(
    words: Chain, tag: np.ndarray, tags: list, weight: np.ndarray | None = None, epochs: int = 6, batch: int = 400, rate: float = 0.3, decay: float = 1e-4, seed: int = 7
) -> Crf:
    """Maximum likelihood by minibatch AdaGrad over the sequences; ``weight`` scales each word's gradient."""
    k, size = len(tags), 1 << BITS
    model = Crf(tags, [np.zeros((size, k), np.float32) for _ in words.feature], np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if len(words.row) == 0:
        return model
    rng = np.random.default_rng(seed)
    square = [np.full((size, k), 1e-4, np.float32) for _ in words.feature]
    square_move, square_begin = np.full((k, k), 1e-2, np.float32), np.full(k, 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(words.first))
        for i in range(0, len(order), batch):
            pick = np.sort(order[i : i + batch])
            length = words.length[pick]
            first = np.concatenate([[0], np.cumsum(length)])[:-1]
            at = np.repeat(words.first[pick] - first, length) + np.arange(length.sum())
            part = Chain(words.row[at], at, at, [f[at] for f in words.feature], first, length)
            psi = potentials(model, part)
            ahead, back = passes(model, part, psi)
            both = ahead * back
            gold = np.zeros_like(both)
            gold[np.arange(len(at)), tag[at]] = 1
            slope = gold - both / both.sum(axis=1, keepdims=True)
            inner = np.ones(len(at), dtype=bool)
            inner[first] = False
            after = np.flatnonzero(inner)
            summed = np.zeros((k, k), psi.dtype)
            step = max(1, PAIRS // (k * k))
            for some in (after[j : j + step] for j in range(0, len(after), step)):
                pair = ahead[some - 1][:, :, None] * np.exp(model.move)[None] * (psi[some] * back[some])[:, None, :]
                summed += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            seen = np.zeros((k, k))
            np.add.at(seen, (tag[at][after - 1], tag[at][after]), 1)
            begun = slope[first].mean(axis=0)
            moved = (seen - summed) / max(len(after), 1)
            square_move += moved**2
            square_begin += begun**2
            model.move += rate * moved / np.sqrt(square_move)
            model.begin += rate * begun / np.sqrt(square_begin)
            if weight is not None:
                slope = slope * weight[at][:, None]
            for table, total, f in zip(model.table, square, part.feature, strict=True):
                bucket, where = np.unique(f, return_inverse=True)
                step = np.stack([np.bincount(where, weights=slope[:, j], minlength=len(bucket)) for j in range(k)], axis=1)
                step -= decay * table[bucket]
                total[bucket] += step**2
                table[bucket] += rate * step / np.sqrt(total[bucket])
    return model
