"""Bounded, repeatable training samples and the held-out rule that queries share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import _text

#: Characters that all training texts have together at most, but for the shortest of each label; scoring has no such bound.
MAX_TRAIN_CHARS = 16_000_000
#: Rows of all labels together that ``labelled_by`` returns at most, but for one of each label.
MAX_ROWS = 12_800
#: Labels up to which their counts are broadcast, so that ids are thinned where they are.
BROADCAST_LABELS = 200_000


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> list[tuple[str, object]]:
    """At most ``rows`` pairs (text, label), the ids with the smallest hashes first.

    ``keep`` says which labelled ids may be learned from. Null ids, texts and
    labels are left out; an id with several labels takes the largest, one with
    several texts the least. The chosen ids are at most ``rows``, so they are
    broadcast and the documents are read once without a shuffle.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return _texts(docs, chosen)


def labelled_by(docs: DataFrame, label: str, keep: Column, rows: int) -> list[tuple[str, object]]:
    """As ``labelled``, with the label in a column of ``docs``; at most ``rows`` ids of each label.

    Every label is learned. Where ``rows`` of each would be more than ``MAX_ROWS``, each has an equal share of that, one id at least.
    """
    ids = docs.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.col("text").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("_label"))
    # a label's ids are thinned by their hashes to some four times what is asked for before they meet in one task
    counts = cut(ids.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")))
    n_labels = counts.count()
    rows = min(rows, max(1, MAX_ROWS // max(1, n_labels)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    order = Window.partitionBy("_label").orderBy(share, "doc_id")
    chosen = (
        ids.join(F.broadcast(counts) if n_labels <= BROADCAST_LABELS else counts, "_label")
        .where(share * F.col("_n") < 4 * rows + 100)
        .withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= rows)
        .select("doc_id", "_label")
    )
    return _texts(docs, chosen)


def _texts(docs: DataFrame, chosen: DataFrame) -> list[tuple[str, object]]:
    """The chosen rows' whole texts; where all have more than ``MAX_TRAIN_CHARS`` characters, the longest are left out.

    ``chosen`` has a bounded number of rows, so one task can add up their lengths.
    """
    held = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    size = F.length("text")
    total = F.sum(size).over(Window.orderBy(size, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("_label").orderBy(size, "doc_id")) == 1
    texts = held.withColumn("_total", total).withColumn("_first", first).where((F.col("_total") <= MAX_TRAIN_CHARS) | F.col("_first")).select("doc_id", "text", "_label").collect()
    return [(r.text, r._label) for r in sorted(texts, key=lambda r: r.doc_id)]


def unlike(pairs: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """``pairs`` without copies: of the texts that share their least shingle hash, the first stays.

    A group of near copies would else count as that many independent witnesses
    for each of its words.
    """
    seen, out = set(), []
    for text, label in pairs:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        word, row = _text.word_hashes(raw, np.array([0, len(raw)]))
        run, _ = _text.shingles(word, row, 1)
        key = int(run.min()) if len(run) else -1
        if key not in seen:
            seen.add(key)
            out.append((text, label))
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a list of texts."""
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), off
