"""Whole-column text kernels: a string column becomes one byte buffer with row offsets.

All functions work on UTF-8 bytes of many texts at once with numpy, so that no
Python object is made per text or word.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000
#: Bytes whose powers are kept; those of a longer text are put together from two.
TILE_BITS = 17
TILE = 1 << TILE_BITS

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _MUL modulo 2**64.
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that Arrow and the C library hold but do not use back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of ``BATCH_ROWS`` rows.

    Ten thousand whole texts, Spark's own number, take an executor some 500 MB
    outside its heap. A session that has set another number keeps it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def tidy(run: Callable) -> Callable:
    """``run`` over a group (key, rows) or a pair of groups, with ``release`` once its own data are gone.

    Spark counts a function's own arguments, so both shapes are written out.
    """

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        try:
            return run(key, rows)
        finally:
            release()

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(key, left, right)
        finally:
            release()

    return two if len(inspect.signature(run).parameters) == 3 else one


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, end row, bytes, offsets."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def _power(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of ``_MUL`` and of its inverse up to ``TILE``, and of the inverse at every ``TILE``-th place up to ``n``."""
    if "up" not in _powers:
        up, down = np.full(TILE, _MUL, dtype=np.uint64), np.full(TILE, _INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"], _powers["far"] = np.cumprod(up), np.cumprod(down), np.ones(1, np.uint64)
    if len(_powers["far"]) < n // TILE + 1:
        far = np.full(n // TILE + 1, np.uint64(pow(int(_INV), TILE, 1 << 64)), dtype=np.uint64)
        far[0] = 1
        _powers["far"] = np.cumprod(far)
    return _powers["up"], _powers["down"], _powers["far"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``between`` turns two of its entries into a substring's hash.

    Worked out tile by tile: beside the result it takes the same memory for any length.
    """
    up, _, _ = _power(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    for i in range(0, len(buf), TILE):
        part = buf[i : i + TILE].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        if i:
            part *= np.uint64(pow(int(_MUL), i, 1 << 64))
        part[:1] += out[i : i + 1]
        np.cumsum(part, out=out[i + 1 : i + 1 + len(part)])
    return out


def between(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), equal for equal bytes."""
    _, down, far = _power(len(run) - 1)
    out = run[end] - run[start]
    out *= down[start & (TILE - 1)]
    if len(run) > TILE:
        out *= far[start >> TILE_BITS]
    out += (end - start).astype(np.uint64) * _STEP
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are no white space; rows never share a word."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[buf]
    cut = off[1:-1]
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[cut[cut < len(buf)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, letters A-Z lower-cased."""
    low = LOWER[buf]
    start, end, row = words(low, off)
    return between(prefix_hash(low), start, end), row


def shingles(word: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words; a shorter text is one run of all its words."""
    ends = np.searchsorted(row, np.arange(rows), side="right")
    begins = np.searchsorted(row, np.arange(rows), side="left")
    parts, owners = [], []
    if len(word) >= width:
        run = word[: len(word) - width + 1].copy()
        for k in range(1, width):
            run = run * _MUL + word[k : len(word) - width + 1 + k]
        whole = row[: len(run)] == row[width - 1 :]
        parts.append(mix(run[whole]))
        owners.append(row[: len(run)][whole])
    few = np.flatnonzero((ends - begins > 0) & (ends - begins < width))
    if len(few):
        out = np.zeros(len(few), dtype=np.uint64)
        for k in range(width - 1):
            at = begins[few] + k
            live = at < ends[few]
            out[live] = out[live] * _MUL + word[at[live]]
        parts.append(mix(out + (ends[few] - begins[few]).astype(np.uint64) * _STEP))
        owners.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    if len(few):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def distinct_rows(value: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, concatenated, with row offsets."""
    edge = np.searchsorted(owner, np.arange(rows + 1), side="left")
    parts = [np.unique(value[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def binary(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def blobs(value: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs of a numeric array, cut at ``edges`` (element counts), as binary rows."""
    return binary(value.view(np.uint8), edges * value.itemsize)
