"""Scoring by an n-gram language model as a weighted backoff automaton.

States are histories: the root (the empty history), the start of a text, every
word learned, and every pair of words that was learned ``STATE_COUNT`` times or
more. A state has an arc for each word seen after it, with the smoothed
log-probability as its weight, to the longest history that is a state after that
word; and a failure arc to the state of its last word, or from a word to the
root, with the log of the mass left for unseen words. The probabilities are
Dirichlet-smoothed: p(w | h) = (c(hw) + B p(w | h')) / (c(h) + B), where h' is h
without its first word, and p(w) = (c(w) + 1) / (N + V + 1). So a failure arc
weighs B / (c(h) + B), and the arcs and failures of every state sum to one.

Counts cover all training documents. Each block of documents sends the counts of
its distinct words and pairs to buckets, which add them up and answer with the
totals; then it does the same with the runs of three words whose first two are a
state. A frequent run of words crosses the network once a block. A block then
has every state and arc that its own texts can reach, and the texts are read
from left to right, carrying the state, following failure arcs where the state
has no arc, and adding up the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

#: Weight of the shorter history's distribution in every history.
STRENGTH = 50.0
#: A pair of words is a state of its own from so many occurrences on; a rarer one backs off to its last word.
STATE_COUNT = 200
BLOCK_BYTES, BUCKET_KEYS = 4 << 20, 1 << 20
#: Tokens that a lane of the traversal reads, and the words that a state can remember.
LANE, MEMORY = 64, 2
#: Hashes of the end of a text, and of the start as a history.
END, START = np.uint64(0xE5D0F7A39C1B2468), np.uint64(0x57A27B1D6E3C9F05)
_PAIR, _TRIPLE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
WORDS, PAIRS, TRIPLES = 0, 1, 2


@dataclass
class Tokens:
    """Tokens of some texts in order: each text's words, then its end."""

    word: np.ndarray
    edge: np.ndarray

    @property
    def pair(self) -> np.ndarray:
        """Key of each token with the one before it, the start before the first."""
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.edge[:-1]] = START
        return _text.mix(before * _PAIR + self.word)

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.word), dtype=bool)
        out[self.edge[:-1]] = True
        return out


def tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    """Tokens of every row; a row without words is its end alone."""
    parts, sizes = [], []
    for _, _, b, o in _text.chunks(buf, off):
        word, row = _text.word_hashes(b, o)
        rows = len(o) - 1
        size = np.bincount(row, minlength=rows) + 1
        out = np.full(len(word) + rows, END, dtype=np.uint64)
        out[np.arange(len(word)) + row] = word
        parts.append(out)
        sizes.append(size)
    word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return Tokens(word, edge.astype(np.int64))


@dataclass
class Automaton:
    """The part of the automaton that some texts can reach; state 0 is the root.

    ``key``: state and word of each arc, the root's aside, sorted (``arc_key``);
    ``weight`` and ``to``: its log10 weight and the state it leads to. ``root`` and
    ``root_to``: the same for the root, which has an arc for every word. ``fail``
    and ``fail_to``: weight and end of each state's failure arc, the root's unused.
    """

    key: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    root: np.ndarray
    root_to: np.ndarray
    fail: np.ndarray
    fail_to: np.ndarray
    start: int

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and log10 weight after reading a word in each state: its arc, or the failure arc and again from there."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_, now = np.arange(len(state)), state
        while len(open_):
            key = arc_key(now, word[open_])
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = (self.key[at] == key) & (now > 0) if len(self.key) else np.zeros(len(now), bool)
            weight[open_[hit]] += self.weight[at[hit]]
            to[open_[hit]] = self.to[at[hit]]
            base = open_[now == 0]
            weight[base] += self.root[word[base]]
            to[base] = self.root_to[word[base]]
            back = ~hit & (now > 0)
            open_, now = open_[back], now[back]
            weight[open_] += self.fail[now]
            now = self.fail_to[now]
        return to, weight

    def walk(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 weight of each token; ``word`` numbers the tokens' words, ``first`` marks where a text starts.

        The tokens are read in lanes side by side. A state remembers ``MEMORY``
        words at most, so a lane that begins inside a text reads so many words
        before its own from the root, and is then in the state that the whole
        text would have led to.
        """
        out = np.zeros(len(word))
        begin = np.arange(0, len(word), LANE)
        state = np.zeros(len(begin), np.int64)
        for step in range(-MEMORY, LANE):
            at = begin + step
            lane = np.flatnonzero((at >= 0) & (at < len(word)))
            at = at[lane]
            to, weight = self.step(np.where(first[at], self.start, state[lane]), word[at])
            state[lane] = to
            if step >= 0:
                out[at] = weight
        return out


def arc_key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (state.astype(np.int64) << 32) | word


@dataclass
class Counts:
    """Distinct keys of one kind in some texts: each token's place among them (-1: none), a token of each, and learned counts."""

    place: np.ndarray
    token: np.ndarray
    count: np.ndarray


def automaton(text: Tokens, words: Counts, pairs: Counts, triples: Counts, learned: int, distinct: int, starts: int, state_count: int = STATE_COUNT) -> Automaton:
    """States, arcs and failure arcs over the keys of some texts, from their learned counts.

    ``starts``: learned texts; ``learned``, ``distinct``: tokens and distinct words learned.
    """
    n = len(words.token)
    p_word = (words.count + 1) / (learned + distinct + 1)
    # nothing follows an end, so it is no history
    end = words.place[text.edge[1] - 1]
    word_state = np.where((words.count > 0) & (np.arange(n) != end), np.arange(1, n + 1), 0)
    start = n + 1
    is_state = (pairs.count >= state_count) & (words.place[pairs.token] != end)
    pair_state = np.where(is_state, start + np.cumsum(is_state), 0)
    held = np.concatenate([[0], words.count, [starts], pairs.count[is_state]]).astype(np.float64)

    def after(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.where(pair_state[pair] > 0, pair_state[pair], word_state[word])

    # arcs of words and the start: pairs that were learned
    seen = np.flatnonzero(pairs.count > 0)
    token = pairs.token[seen]
    word = words.place[token]
    last = np.where(text.first[token], start, word_state[words.place[np.maximum(token - 1, 0)]])
    p_pair = (pairs.count[seen] + STRENGTH * p_word[word]) / (held[last] + STRENGTH)
    key, weight, to = [arc_key(last, word)], [p_pair], [after(seen, word)]
    # arcs of pairs: triples that were learned, whose own last pairs were learned too
    of_pair = np.zeros(len(pairs.token))
    of_pair[seen] = p_pair
    seen = np.flatnonzero(triples.count > 0)
    token = triples.token[seen]
    word, pair = words.place[token], pairs.place[token]
    last = pair_state[pairs.place[token - 1]]
    key.append(arc_key(last, word))
    weight.append((triples.count[seen] + STRENGTH * of_pair[pair]) / (held[last] + STRENGTH))
    to.append(after(pair, word))
    key, weight, to = (np.concatenate(x) for x in (key, weight, to))
    order = np.argsort(key, kind="stable")
    pair_token = pairs.token[is_state]
    fail_to = np.concatenate([np.zeros(n + 2, np.int64), word_state[words.place[pair_token]]])
    return Automaton(key[order], np.log10(weight[order]), to[order], np.log10(p_word), word_state, np.log10(STRENGTH / (held + STRENGTH)), fail_to, start)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, by its upper half, so that sorted keys are sorted by bucket."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _edges(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins and ends among sorted bucket numbers."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


_FAR = np.uint64((1 << 48) - 1)


def _pack(key: np.ndarray) -> bytes:
    """Sorted distinct keys, all 64 bits of them, as steps of six bytes; larger steps follow as eight."""
    head = len(key).to_bytes(4, "little")
    step = np.diff(key)
    far = step >= _FAR
    if len(key) == 0 or 8 * far.sum() > 2 * len(key):
        return head + b"\0" + key.tobytes()
    near = np.minimum(step, _FAR)
    return head + b"\1" + key[:1].tobytes() + near.astype(np.uint32).tobytes() + (near >> np.uint64(32)).astype(np.uint16).tobytes() + step[far].tobytes()


def _unpack(data: pa.Buffer) -> np.ndarray:
    raw = data.to_pybytes()
    n = int.from_bytes(raw[:4], "little")
    if n == 0:
        return np.zeros(0, np.uint64)
    if raw[4] == 0:
        return np.frombuffer(raw, np.uint64, n, 5)
    step = np.empty(n, np.uint64)
    step[0] = np.frombuffer(raw, np.uint64, 1, 5)[0]
    step[1:] = np.frombuffer(raw, np.uint32, n - 1, 13)
    step[1:] |= np.frombuffer(raw, np.uint16, n - 1, 13 + 4 * (n - 1)).astype(np.uint64) << np.uint64(32)
    far = np.flatnonzero(step[1:] == _FAR) + 1
    if len(far):
        step[far] = np.frombuffer(raw, np.uint64, len(far), 13 + 6 * (n - 1))
    return np.cumsum(step)


def _small(count: np.ndarray) -> bytes:
    """Counts as one byte each; those from 255 on follow as eight bytes each."""
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype(np.int64).tobytes()


def _large(data: pa.Buffer, n: int) -> np.ndarray:
    count = np.frombuffer(data, np.uint8, n).astype(np.int64)
    big = count == 255
    count[big] = np.frombuffer(bytes(data)[n:], np.int64)
    return count


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
_NOTE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64())])
_SENT_TYPE = "bucket long, block long, kind int, data binary, counts binary"
_NOTE_TYPE = "block long, kind int, bucket long, counts binary, total long, kinds long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Block:
    """Tokens of a block, and what its notes say about their keys."""

    def __init__(self, docs: pa.Table, notes: pa.Table | None = None):
        self.text = tokens(*_text.flat(docs.column("text")))
        learn = docs.column("_learn").to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight, self.starts = np.repeat(learn, np.diff(self.text.edge)), int(learn.sum())
        self.notes = notes
        if notes is not None:
            self.kinds = notes.column("kind").to_numpy()

    def distinct(self, value: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, Counts]:
        """Sorted distinct keys of the tokens that are ``live``, and where they are, with the block's own counts."""
        at = np.arange(len(value)) if live is None else np.flatnonzero(live)
        key, token, back = np.unique(value[at], return_index=True, return_inverse=True)
        place = np.full(len(value), -1, np.int64)
        place[at] = back
        count = np.bincount(back, weights=self.weight[at], minlength=len(key)).astype(np.int64)
        return key, Counts(place, at[token], count)

    def triples(self, pairs: Counts, state_count: int) -> tuple[np.ndarray, Counts]:
        """As ``distinct``, for the runs of three tokens whose first two are a state."""
        live = np.zeros(len(self.text.word), dtype=bool)
        live[1:] = (pairs.count >= state_count)[pairs.place[:-1]] & ~self.text.first[1:]
        value = np.zeros(len(live), np.uint64)
        value[1:] = _text.mix(self.text.pair[:-1] * _TRIPLE + self.text.word[1:])
        return self.distinct(value, live)

    def answered(self, kind: int, key: np.ndarray, counts: Counts, buckets: int) -> Counts:
        """``counts`` with the totals of all blocks."""
        edge = _edges(_bucket(key, buckets), buckets)
        total = np.zeros(len(key), np.int64)
        of, data = self.notes.column("bucket"), self.notes.column("counts")
        for i in np.flatnonzero(self.kinds == kind):
            a, b = edge[of[int(i)].as_py()], edge[of[int(i)].as_py() + 1]
            total[a:b] = _large(data[int(i)].as_buffer(), b - a)
        return Counts(counts.place, counts.token, total)


def _messages(block: int, kind: int, key: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple]:
    """One row a bucket; words go to every bucket, as every bucket's totals come back with them."""
    edge = _edges(_bucket(key, buckets), buckets)
    runs = [(i, int(edge[i]), int(edge[i + 1])) for i in range(buckets)]
    return [(i, block, kind, _pack(key[a:b]), _small(count[a:b])) for i, a, b in runs if b > a or kind == WORDS]


def _send(buckets: int):
    def run(block: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        own, rows = _Block(docs), []
        for kind, value in ((WORDS, own.text.word), (PAIRS, own.text.pair)):
            key, found = own.distinct(value)
            rows += _messages(block[0].as_py(), kind, key, found.count, buckets)
        return _table(rows, _SENT)

    return run


def _send_triples(buckets: int, state_count: int):
    def run(block: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _table([], _SENT)
        own = _Block(docs, notes)
        pairs = own.answered(PAIRS, *own.distinct(own.text.pair), buckets)
        key, found = own.triples(pairs, state_count)
        return _table(_messages(block[0].as_py(), TRIPLES, key, found.count, buckets), _SENT)

    return run


def _answer(bucket: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """Totals for each block's keys; with words, the bucket's learned tokens and distinct words."""
    rows = []
    for kind in (WORDS, PAIRS, TRIPLES):
        part = sent.filter(pc.equal(sent.column("kind"), kind))
        if part.num_rows == 0:
            continue
        keys = [_unpack(x.as_buffer()) for x in part.column("data")]
        counts = [_large(x.as_buffer(), len(k)) for x, k in zip(part.column("counts"), keys, strict=True)]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        in_all, distinct = (int(total.sum()), int((total > 0).sum())) if kind == WORDS else (0, 0)
        at = 0
        for block, key in zip(part.column("block").to_pylist(), keys, strict=True):
            rows.append((block, kind, bucket[0].as_py(), _small(total[place[at : at + len(key)]]), in_all, distinct))
            at += len(key)
    return _table(rows, _NOTE)


def _score(buckets: int, state_count: int, kind: pa.DataType):
    def run(block: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _SCORED.set(0, pa.field("doc_id", kind)).empty_table()
        own = _Block(docs, notes)
        text = own.text
        learned, distinct = pc.sum(notes.column("total")).as_py(), pc.sum(notes.column("kinds")).as_py()
        words = own.answered(WORDS, *own.distinct(text.word), buckets)
        pairs = own.answered(PAIRS, *own.distinct(text.pair), buckets)
        triples = own.answered(TRIPLES, *own.triples(pairs, state_count), buckets)
        # every text has one end, so the ends learned are the starts learned
        starts = int(words.count[words.place[text.edge[1] - 1]])
        model = automaton(text, words, pairs, triples, learned, distinct, starts, state_count)
        edge = text.edge

        def summed(each: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros(1, each.dtype), np.cumsum(each)])
            return run[edge[1:]] - run[edge[:-1]]

        return pa.table(
            {
                "doc_id": docs.column("doc_id").combine_chunks().cast(kind),
                "n_tokens": pa.array(np.diff(edge)),
                "n_known": pa.array(summed((words.count[words.place] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(docs.num_rows, learned, np.int64)),
                "base_score": pa.array(summed(model.root[words.place])),
                "score": pa.array(summed(model.walk(words.place, text.first))),
            }
        )

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, learn: Column, state_count: int = STATE_COUNT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``docs``.

    ``learn`` says which rows the model is counted from; where it is null a row is
    learned from. Null texts count as empty and are the end alone. Repeated rows
    are each counted and each scored. Other columns are ignored whatever their
    names; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(32, total // BLOCK_BYTES))
    buckets = int(max(16, total // 10 // BUCKET_KEYS))
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).alias("_block"), "doc_id", F.coalesce(learn, F.lit(True)).alias("_learn"), text.alias("text"))

    def with_notes(notes: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("_block").cogroup(notes.groupBy("block")).applyInArrow(_text.tidy(run), schema)

    sent = dealt.groupBy("_block").applyInArrow(_text.tidy(_send(buckets)), _SENT_TYPE)
    counts = sent.groupBy("bucket").applyInArrow(_text.tidy(_answer), _NOTE_TYPE)
    more = with_notes(counts, _send_triples(buckets, state_count), _SENT_TYPE)
    notes = counts.unionByName(more.groupBy("bucket").applyInArrow(_text.tidy(_answer), _NOTE_TYPE))
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_notes(notes, _score(buckets, state_count, to_arrow_type(kind)), schema)
