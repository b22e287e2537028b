"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

1. Spark splits texts into the tokenizer's words with its own regular expression
   (JVM side) and counts the distinct words of the whole corpus, which are merged
   inside each task before they are shuffled.
2. Each distinct word that occurs twice or more becomes a row of the word table
   and is encoded there, once. The table is broadcast, so its size is checked:
   where it would be above ``TABLE_WORDS`` rows, it holds the most frequent words
   only, those from the least power of two on with which it fits.
3. Texts are split again, and ids are joined back by position: a word's place in
   the table gives its ids. A word without a row, which is rare, is encoded where
   it stands, so the result is the library's whatever the table holds.
4. Decoding joins each id to its row of the piece table, again by position.

Texts cross no shuffle, and a lost task only repeats its own batches.

The tokenizer file is a parameter; byte-level BPE files of the ``tokenizers``
library are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import _text

#: Words handed to the library at a time; an encoded word is much larger than its ids.
ENCODE_WORDS = 4096
#: Rows of the distinct-word table at most, and bytes of a word in it: the size of what is broadcast is bounded by both.
TABLE_WORDS, WORD_BYTES = 1 << 19, 64
#: Bytes of text in an output batch, about.
OUT_BYTES = 4 << 20
#: The word pattern of byte-level tokenizers, with white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"

_loaded: dict[str, Tokenizer] = {}


@dataclass
class Tokenizer:
    """One loaded file: ``special`` maps added strings to ids, ``piece`` holds the bytes of all ids."""

    model: object
    special: dict[str, int]
    piece: np.ndarray
    piece_off: np.ndarray


@dataclass(frozen=True)
class WordTable:
    """Distinct words; ``ids`` holds the ids of all of them, one word after another, cut at ``off``."""

    words: pa.Array
    ids: np.ndarray
    off: np.ndarray


#: A table without rows: every word is encoded where it stands.
NO_WORDS = WordTable(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64))


def _byte_of_char() -> dict[str, int]:
    """The byte for each printable stand-in of byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the
    code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def added(path: str) -> dict[str, int]:
    """The file's added strings, which are cut out of a text before its words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE file")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take white space are not supported")
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def load(path: str) -> Tokenizer:
    """The tokenizer, loaded once in each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        model = Library.from_file(path)
        model.no_truncation()
        model.no_padding()
        special = added(path)
        back, names = _byte_of_char(), model.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            pieces[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        _loaded[path] = Tokenizer(model, special, np.frombuffer(b"".join(pieces), np.uint8), off)
    return _loaded[path]


def split(text: Column, special: dict[str, int]) -> Column:
    """The text's words in order, added strings as words of their own."""
    pattern = F.lit(WORDS)
    plain = F.regexp_extract_all(text, pattern, F.lit(0))
    if not special:
        return plain
    names = sorted(special, key=lambda s: (-len(s), s))
    any_name = "|".join(re.sub(r"([^\w])", r"\\\1", n) for n in names)
    # the strings found, and the texts between them, of which there is always one more
    between = F.split(text, any_name, -1)
    found = F.regexp_extract_all(text, F.lit(any_name), F.lit(0))
    parts = F.transform(between, lambda s, i: F.concat(F.when(i > 0, F.array(F.get(found, i - 1))).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(s, pattern, F.lit(0))))
    has = F.lit(False)
    for n in names:
        has = has | F.contains(text, F.lit(n))
    return F.when(has, F.flatten(parts)).otherwise(plain)


def word_ids(tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct word, concatenated, with offsets."""
    flat: list[int] = []
    size = np.zeros(len(words) + 1, dtype=np.int64)
    encode = getattr(tokenizer.model, "encode_batch_fast", tokenizer.model.encode_batch)
    for i in range(0, len(words), ENCODE_WORDS):
        part = words[i : i + ENCODE_WORDS]
        for k, e in enumerate(encode(part, add_special_tokens=False), i + 1):
            ids = e.ids
            size[k] = len(ids)
            flat += ids
    return np.array(flat, dtype=np.uint32), np.cumsum(size)


def _gather(value: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``value`` that ``index`` names, one after another, with their offsets."""
    size = off[index + 1] - off[index]
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(off[index] - out[:-1], size)
    at += np.arange(len(at))
    return value[at], out


def encode_words(tokenizer: Tokenizer, words: pa.Array, known: WordTable = NO_WORDS, size: int = OUT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a list-of-words column: first row, end row, their ids, and offsets into them."""
    edge = words.offsets.to_numpy().astype(np.int64)
    row, rows = 0, len(words)
    while row < rows:
        end = min(max(int(np.searchsorted(edge, edge[row] + size // 6, side="right")) - 1, row + 1), rows)
        here = words.slice(row, end - row).flatten().dictionary_encode()
        row_of = pc.index_in(here.dictionary, value_set=known.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(row_of < 0)
        ids, off = word_ids(tokenizer, here.dictionary.take(pa.array(new)).to_pylist())
        row_of[new] = len(known.words) + np.arange(len(new))
        flat, flat_off = np.concatenate([known.ids, ids]), np.concatenate([known.off, known.off[-1] + off[1:]])
        ids, off = _gather(flat, flat_off, row_of[here.indices.to_numpy(zero_copy_only=False)])
        yield row, end, ids, off[edge[row : end + 1] - edge[row]]
        row = end


def decode_ids(tokenizer: Tokenizer, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """The text of each row of ids; bytes that are no UTF-8 become replacement characters."""
    raw, edge = _gather(tokenizer.piece, tokenizer.piece_off, ids.astype(np.int64))
    at = edge[off]
    whole = raw.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _words(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    return docs.select(*keep, split(F.coalesce(F.col("text"), F.lit("")), added(path)).alias("_words"))


def word_table(docs: DataFrame, path: str, rows: int = TABLE_WORDS) -> WordTable:
    """The distinct words that occur twice or more in all texts, each encoded once; at most ``rows`` of them, the most frequent.

    Words of more than ``WORD_BYTES`` bytes have no row. An empty table of documents gives an empty one.
    """
    word = _words(docs, path, []).select(F.explode("_words").alias("word")).where(F.octet_length("word") <= WORD_BYTES)
    counts = cut(word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    least, held = None, 0
    # at most one row a power of two
    for level, n in sorted(((r.level, r.n) for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        held += n
        if held > rows:
            break
        least = 1 << level
    if least is None:
        return NO_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            ids, off = word_ids(tokenizer, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _text.blobs(ids, off)], ["word", "ids"])

    table = counts.where(F.col("n") >= least).select("word").mapInArrow(run, "word string, ids binary").toArrow().combine_chunks()
    raw, off = _text.flat(table.column("ids"))
    words = table.column("word").combine_chunks()
    return WordTable(words.chunk(0) if isinstance(words, pa.ChunkedArray) else words, np.frombuffer(raw.tobytes(), "<u4").astype(np.uint32), off // 4)


def encode(docs: DataFrame, path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row's whole text.

    Null texts count as empty and get no ids; repeated rows are each encoded;
    other columns are ignored whatever their names; an empty table gives an
    empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, table_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for a, b, ids, off in encode_words(tokenizer, batch.column(1), known.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), _text.blobs(ids, off)], ["doc_id", "n_tokens", "ids"])
            _text.release()

    return _text.map_batches(_words(docs, path, ["doc_id"]), run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encode``'s result; null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            buf, off = _text.flat(batch.column(1))
            for a, b, part, o in _text.chunks(buf, off, OUT_BYTES):
                texts = decode_ids(tokenizer, np.frombuffer(part.tobytes(), dtype="<u4"), o // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _text.map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    The digests are of the ids as little-endian unsigned 32-bit integers and of
    the decoded text. Nulls, repeated rows and other columns as in ``encode``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, table_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for a, b, ids, off in encode_words(tokenizer, batch.column(1), known.value):
                raw = ids.astype("<u4").tobytes()
                digest = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(off[:-1], off[1:], strict=True)]
                decoded = [hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(tokenizer, ids, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(digest), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            _text.release()

    return _text.map_batches(_words(docs, path, ["doc_id"]), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

