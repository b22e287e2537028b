"""Exact substring deduplication over suffixes in deep-shallow order.

A byte goes if a 50-byte string over it also starts in a document with a smaller
id. Strings that are equal must meet in one place without any document or any
popular string being gathered there, so the work is dealt out twice:

*Blocks* hold a bounded number of bytes of documents. *Buckets* hold a bounded
number of anchors. The anchor of a 50-byte window is its 26-byte substring with
the smallest hash, so equal windows have equal anchors, and a text has an anchor
for about every 13 bytes.

1. Each block sends each distinct anchor's hash to the anchor's bucket, once,
   however many of its documents have it.
2. Buckets answer which anchors occur in another block too.
3. For these, and for those that several of its documents share, a block sends
   the distinct suffixes: the bytes of the windows around the anchor, with the
   block's smallest id for them. They are found by sorting the block's suffixes.
4. Buckets sort the suffixes of all blocks deep-shallow. Equal ones take the
   smallest id; where an anchor's suffixes differ, their windows are sorted the
   same way. A block gets one bit for each window of each suffix it sent: whether
   a smaller id has it.
5. Blocks mark the windows, cover the bytes, and cut them out.

A document whose whole text is a copy of another's with a smaller id needs none
of this: only its copy with the least id takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sort, _text

LENGTH = 50
GRAM = 26
#: Starts of a window that share an anchor at most.
REACH = LENGTH - GRAM + 1
#: Bytes of a suffix: the anchor first, what follows it, what precedes it, and the first and last start.
CELL = LENGTH + REACH - 1 + 2
WIDE = (CELL + 7) // 8 * 8
#: The columns of a suffix that lie around its anchor, in the order in which they are sorted.
_TURN = np.concatenate([np.arange(REACH - 1, CELL - 2), np.arange(REACH - 1)])
#: Bytes of text in a block and anchors in a bucket, about.
BLOCK_BYTES, BUCKET_ANCHORS = 2 << 20, 1 << 19
#: Bytes in which anchors are looked for at once.
CHUNK_BYTES = 1 << 18
#: Windows sorted at once in a bucket, about.
SORT_WINDOWS = 50_000
_LAST = (1 << 63) - 1
_PLACE_BITS = np.uint64(30)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of every anchor of every row."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    run = _text.prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    value = _text.between(run, at, at + GRAM)
    key = (value >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    least, span = key, 1
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = REACH - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for edge in off[1:-1]:
        inside[max(edge - LENGTH + 1, 0) : edge] = False
    start = np.flatnonzero(inside)
    place = place[start]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(new[1:] - 1, len(start) - 1) if len(new) else new
    place = place[new]
    return _text.mix(value[place] + np.uint64(1)), place, start[new], start[last]


def cells(buf: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffixes of some anchors as rows of bytes; what lies outside their windows is 0."""
    out = np.zeros((len(place), WIDE), dtype=np.uint8)
    step = 8192
    for i in range(0, len(place), step):
        p, a, b = place[i : i + step, None], first[i : i + step, None], last[i : i + step, None]
        at = p + (_TURN - (REACH - 1))[None, :]
        live = (at >= a) & (at < b + LENGTH)
        out[i : i + step, : CELL - 2] = np.where(live, buf[np.clip(at, 0, len(buf) - 1)], 0)
        out[i : i + step, CELL - 2] = (a - p + REACH - 1)[:, 0]
        out[i : i + step, CELL - 1] = (b - p + REACH - 1)[:, 0]
    return out


class _Block:
    """The texts of one block, of which each distinct (id, text) takes part once if it is its text's least copy."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        self.key = docs.column("_key").to_numpy()
        digest = docs.column("_digest").to_pylist()
        kinds, keys, data = notes.column("kind").to_numpy(), notes.column("key").to_numpy(), notes.column("data")
        leads = {(int(keys[i]), data[int(i)].as_py()) for i in np.flatnonzero(kinds == 0)}
        self.lead = np.array([(int(k), bytes.fromhex(d)) in leads for k, d in zip(self.key, digest, strict=True)], dtype=bool)
        self.buf, self.off = _text.flat(docs.column("text"))
        self.notes = {kind: {int(keys[i]): data[int(i)].as_buffer() for i in np.flatnonzero(kinds == kind)} for kind in (1, 2)}
        parts = []
        for row in np.flatnonzero(self.lead & (np.diff(self.off) >= LENGTH)):
            parts.append(row)
        self.rows = np.array(parts, dtype=np.int64)
        self._find()

    def _find(self) -> None:
        """Anchors of the rows that take part, over runs of them of about a chunk."""
        size = np.diff(self.off)[self.rows]
        out, i = [[], [], [], [], []], 0
        while i < len(self.rows):
            j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), CHUNK_BYTES, side="right")) + i)
            take = self.rows[i:j]
            off = np.concatenate([[0], np.cumsum(size[i:j])])
            buf = np.concatenate([self.buf[self.off[r] : self.off[r + 1]] for r in take])
            value, place, first, last = anchors(buf, off)
            local = np.searchsorted(off, place, side="right") - 1
            shift = self.off[take][local] - off[local]
            for part, x in zip(out, (value, place + shift, first + shift, last + shift, take[local]), strict=True):
                part.append(x)
            i = j
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
        self.value, self.place, self.first, self.last, self.row = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True))

    def shared(self, buckets: int) -> None:
        """Keeps the anchors that other blocks have, or several documents of this one."""
        bucket, piece = split(self.value, buckets)
        whole = (bucket.astype(np.uint64) << np.uint64(32)) | piece
        known = [np.frombuffer(d, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, d in self.notes[1].items()]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        at = np.searchsorted(known, whole)
        hit = (known[np.minimum(at, len(known) - 1)] == whole) if len(known) else np.zeros(len(whole), bool)
        # anchors of several ids here
        order = np.lexsort((self.key[self.row], self.value))
        v, k = self.value[order], self.key[self.row][order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = v[1:] != v[:-1]
        group = np.cumsum(new) - 1
        many = k[np.append(np.flatnonzero(new)[1:], len(v)) - 1] != k[np.flatnonzero(new)] if len(v) else new
        hit[order] |= many[group] if len(v) else False
        self.value, self.place, self.first, self.last, self.row, self.bucket = (x[hit] for x in (self.value, self.place, self.first, self.last, self.row, bucket))

    def suffixes(self) -> None:
        """Sorts the kept anchors' suffixes: ``cell`` is each one's group, ``least`` each group's smallest id."""
        grid = cells(self.buf, self.place, self.first, self.last)
        place, group = _sort.order(grid)
        self.cell = np.zeros(len(place), np.int64)
        self.cell[place] = group
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        key = self.key[self.row]
        self.least = np.minimum.reduceat(key[place], begin) if len(place) else key[:0]
        self.grid, of = grid[place[begin], :CELL], self.bucket[place[begin]]
        # groups by bucket, in sorted order inside it: the order in which they are sent and answered
        self.sent = np.argsort(of, kind="stable")
        self.of = of[self.sent]


def split(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each anchor, and the 32 bits of its hash that go there."""
    return (value % np.uint64(buckets)).astype(np.int64), value >> np.uint64(32)


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], names=[n for n, _ in schema])


_SENT = [("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.binary())]
_NOTE = [("block", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("data", pa.binary())]


def _send_anchors(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        block = _Block(docs, notes)
        bucket, piece = split(block.value, buckets)
        whole = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | piece)
        of, data = (whole >> np.uint64(32)).astype(np.int64), whole.astype(np.uint32)
        edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        return _rows(_SENT, [(int(of[a]), key[0].as_py(), data[a:b].tobytes(), b"") for a, b in zip(edge[:-1], edge[1:], strict=True)])

    return run


def _answer_anchors(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in sent.column("data")]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for block, part in zip(sent.column("block").to_pylist(), parts, strict=True):
        at = np.minimum(np.searchsorted(twice, part), max(len(twice) - 1, 0))
        hit = part[twice[at] == part] if len(twice) else part[:0]
        if len(hit):
            rows.append((block, 1, key[0].as_py(), hit.tobytes()))
    return _rows(_NOTE, rows)


def _send_suffixes(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        block = _Block(docs, notes)
        block.shared(buckets)
        block.suffixes()
        edge = np.append(np.flatnonzero(np.diff(block.of, prepend=-1)), len(block.of))
        rows = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            take = block.sent[a:b]
            rows.append((int(block.of[a]), key[0].as_py(), block.grid[take].tobytes(), block.least[take].tobytes()))
        return _rows(_SENT, rows)

    return run


def _window_bits(grid: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct suffixes in sorted order: a bit for each window that a suffix of a smaller id has too."""
    bits = np.zeros(len(grid), dtype=np.uint32)
    if len(grid) == 0:
        return bits
    same = np.zeros(len(grid), dtype=bool)
    same[1:] = (grid[1:, :GRAM] == grid[:-1, :GRAM]).all(axis=1)
    group = np.cumsum(~same) - 1
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    many = (grid[:, CELL - 1].astype(np.int64) - grid[:, CELL - 2] + 1)[live]
    total = np.cumsum(many)
    back = np.argsort(_TURN)
    i = 0
    while i < len(live):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + SORT_WINDOWS, side="right"))
        j = max(j, i + 1)
        while j < len(live) and group[live[j]] == group[live[j - 1]]:  # an anchor's suffixes stay together
            j += 1
        take = live[i:j]
        plain = grid[take][:, :-2][:, back]
        owner = np.repeat(np.arange(len(take)), many[i:j])
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + np.repeat(grid[take, CELL - 2].astype(np.int64), many[i:j])
        window = np.zeros((len(owner), (LENGTH + 7) // 8 * 8), dtype=np.uint8)
        window[:, :LENGTH] = plain[owner[:, None], start[:, None] + np.arange(LENGTH)]
        place, equal = _sort.order(window)
        key = least[take][owner]
        begin = np.flatnonzero(np.diff(equal, prepend=-1))
        low = np.zeros(len(owner), np.int64)
        low[place] = np.minimum.reduceat(key[place], begin)[equal]
        hit = low < key
        np.bitwise_or.at(bits, take[owner[hit]], np.uint32(1) << start[hit].astype(np.uint32))
        i = j
    return bits


def _answer_suffixes(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    grids = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, CELL) for x in sent.column("data")]
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in sent.column("ids")])
    grid = np.zeros((len(ids), WIDE), dtype=np.uint8)
    grid[:, :CELL] = np.concatenate(grids)
    place, group = _sort.order(grid)
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(ids[place], begin)
    bits = _window_bits(grid[place[begin], :CELL], least)
    cell = np.zeros(len(ids), np.int64)
    cell[place] = group
    answer = np.where(ids > least[cell], np.uint32((1 << REACH) - 1), bits[cell])
    rows, at = [], 0
    for block, part in zip(sent.column("block").to_pylist(), grids, strict=True):
        rows.append((block, 2, key[0].as_py(), answer[at : at + len(part)].astype(np.uint32).tobytes()))
        at += len(part)
    return _rows(_NOTE, rows)


def _cut(buckets: int, schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        block = _Block(docs, notes)
        size = np.diff(block.off)
        gone = np.zeros(len(block.buf) + 1, dtype=np.int32)
        copy = ~block.lead & (size >= LENGTH)
        for row in np.flatnonzero(copy):
            gone[block.off[row]] += 1
            gone[block.off[row + 1]] -= 1
        block.shared(buckets)
        if len(block.value):
            block.suffixes()
            bits = np.zeros(len(block.least), np.uint32)
            edge = np.append(np.flatnonzero(np.diff(block.of, prepend=-1)), len(block.of))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                bits[block.sent[a:b]] = np.frombuffer(block.notes[2][int(block.of[a])], np.uint32)
            mask = np.where(block.key[block.row] > block.least[block.cell], np.uint32((1 << REACH) - 1), bits[block.cell])
            many = block.last - block.first + 1
            owner = np.repeat(np.arange(len(many)), many)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + block.first[owner]
            hit = (mask[owner] >> (start - block.place[owner] + REACH - 1).astype(np.uint32)) & np.uint32(1) == 1
            np.add.at(gone, start[hit], 1)
            np.add.at(gone, start[hit] + LENGTH, -1)
        out = np.cumsum(gone[:-1]) > 0
        before = np.concatenate([[False], out[:-1]]) if len(out) else out
        before[block.off[:-1][block.off[:-1] < len(out)]] = False
        runs = np.concatenate([[0], np.cumsum(out & ~before)])
        lost = np.concatenate([[0], np.cumsum(out)])
        kept_off = block.off - lost[block.off]
        left = block.buf[~out]
        columns = {name: docs.column(name).combine_chunks() for name in docs.column_names if not name.startswith("_") and name != "text"}
        columns |= {"n_bytes": pa.array(size), "n_removed": pa.array(np.diff(lost[block.off])), "n_spans": pa.array(np.diff(runs[block.off]))}
        if "kept" in schema.names:
            columns["kept"] = _text.binary(left, kept_off)
        else:
            texts = [left[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(kept_off[:-1], kept_off[1:], strict=True)]
            columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        return pa.table(columns).select(schema.names).cast(schema)

    return run


def dedup(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, ``carry``, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of ``docs``.

    With ``as_text`` text and n_chars (code points) stand for kept; what is left
    of a character cut in two goes too. Null texts count as empty. A null id
    counts as larger than all others and is returned as null. Rows with the same id are judged each on its own, against
    smaller ids only. Texts below 50 bytes lose nothing. Columns that are not
    named in ``carry`` are ignored whatever their names; an empty table gives an
    empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(32, total // BLOCK_BYTES)
    buckets = max(16, total // (GRAM // 2) // BUCKET_ANCHORS)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"),
        "doc_id",
        *carry,
        F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.pmod(F.xxhash64("_key", "_digest"), F.lit(blocks))
    # the least id of each distinct text; counted from ids and digests only
    leads = keyed.groupBy("_digest").agg(F.min("_key").alias("_key"))
    leads = leads.select(block.alias("block"), F.lit(0).alias("kind"), F.col("_key").alias("key"), F.unhex("_digest").alias("data"))
    dealt = keyed.withColumn("_block", block)
    sent_type, note_type = "bucket long, block long, data binary, ids binary", "block long, kind int, key long, data binary"

    def with_notes(notes: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("_block").cogroup(notes.groupBy("block")).applyInArrow(_text.tidy(run), schema)

    shared = with_notes(leads, _send_anchors(buckets), sent_type).groupBy("bucket").applyInArrow(_text.tidy(_answer_anchors), note_type)
    known = leads.unionByName(shared)
    answers = with_notes(known, _send_suffixes(buckets), sent_type).groupBy("bucket").applyInArrow(_text.tidy(_answer_suffixes), note_type)
    kinds = dict(docs.dtypes)
    names = ["doc_id", *carry]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_bytes long, n_removed long, n_spans long, " + ("text string, n_chars long" if as_text else "kept binary")
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return with_notes(known.unionByName(answers), _cut(buckets, arrow), schema)
