"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity says little; what
counts is containment, the share of an item's distinct five-word shingles that a
document has. Items are partitioned by size (powers of two of their shingle
count). An item's sketch holds its smallest shingle hashes, a bottom-k MinHash
whose k its size and the threshold give: of n shingles, n - ceil(t n) + 1. A
partition's *bound* is the largest hash in any sketch of it. A document's
signature for a partition is its MinHash below that bound: all its shingle
hashes up to it, or nothing if it has fewer shingles than the partition's least
need. A document that contains at least ceil(t n) of an item's n shingles lacks
fewer than k of them, so its signature meets the item's sketch: the search loses
nothing, however long the document is.

Signatures are joined with sketches in the one pass that hashes all documents.
The pairs that meet are few and are written down; then the documents among them
are read again and verified by the shingles themselves, not by their hashes.
What is broadcast has a checked row count, and is joined by a shuffle beyond it.
All of it is built-in functions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import _native

THRESHOLD = 0.75
#: Rows up to which item shingles, and ids of candidate documents, are broadcast (some 60 bytes each at most).
BROADCAST_ROWS = 200_000


def _worded(table: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep`` and the lower-cased words (_words) of each text."""
    return table.select(*keep, _native.words(_native.spaced(F.lower("text"))).alias("_words"))


def item_table(items: DataFrame, key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct shingle of an item: item_id, n_item, need, size_part, in_sketch, hash, shingle.

    Rows with the same id are one item; items without words have no row.
    """
    percent = round(threshold * 100)
    each = _worded(items, F.col(key).alias("item_id")).select("item_id", F.explode_outer(_native.shingles(F.col("_words"))).alias("shingle"))
    each = each.where("shingle is not null").distinct().withColumn("hash", _native.shingle_hash(F.col("shingle")))
    whole = Window.partitionBy("item_id")
    at = F.row_number().over(whole.orderBy("hash", "shingle"))
    sized = each.select("item_id", "shingle", "hash", F.count(F.lit(1)).over(whole).cast("int").alias("n_item"), at.alias("_at"))
    sized = sized.withColumn("need", F.ceil(F.col("n_item") * percent / 100).cast("int"))
    part = F.floor(F.log2("n_item")).cast("int")
    return sized.select("item_id", "n_item", "need", part.alias("size_part"), (F.col("_at") <= F.col("n_item") - F.col("need") + 1).alias("in_sketch"), "hash", "shingle")


def bounds(table: DataFrame) -> list[tuple[int, int]]:
    """Each size partition's least need and the largest hash of its sketches; at most one a power of two."""
    parts = table.where("in_sketch").groupBy("size_part").agg(F.min("need").alias("need"), F.max("hash").alias("bound"))
    return sorted((r.need, r.bound) for r in parts.collect())


def _in_signature(parts: list[tuple[int, int]]) -> Column:
    """Whether a shingle hash belongs to the signature of any partition that the document is large enough for.

    One comparison of both: of a test on the size alone, Spark would make a filter
    below the columns that build the array, and build it again for every shingle.
    """
    none = F.lit(-(1 << 63))
    bound = none
    for need, top in parts:
        bound = F.greatest(bound, F.when(F.col("n_doc") >= need, F.lit(top)).otherwise(none))
    return F.col("hash") <= bound


def candidates(docs: DataFrame, table: DataFrame, parts: list[tuple[int, int]], hint) -> DataFrame:
    """doc_id, _row (a hash of the text) and item_id of each pair whose signature and sketch meet; one pass over ``docs``."""
    hashed = _worded(docs, "doc_id", F.xxhash64("text").alias("_row")).select("doc_id", "_row", _native.shingle_hashes(F.col("_words")).alias("_hashes"))
    # the size is taken before the array is exploded: after, every exploded row would carry the whole array
    sized = hashed.select("doc_id", "_row", "_hashes", F.size("_hashes").alias("n_doc"))
    # explode_outer: for explode, Spark would push a test of the array's size below the columns that build it
    signature = sized.select("doc_id", "_row", "n_doc", F.explode_outer("_hashes").alias("hash")).where(_in_signature(parts))
    least = table.groupBy("size_part").agg(F.min("need").alias("part_need"))
    sketch = table.where("in_sketch").select("item_id", "size_part", "hash").join(F.broadcast(least), "size_part")
    met = signature.join(hint(sketch), "hash").where(F.col("n_doc") >= F.col("part_need"))
    return met.select("doc_id", "_row", "item_id").distinct()


def verified(docs: DataFrame, items: DataFrame, key: str = "item_id", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, _digest (SHA-256 of the text), item_id, n_item and n_shared of each text that contains an item."""
    table = cut(item_table(items, key, threshold))
    hint = F.broadcast if table.count() <= broadcast_rows else (lambda df: df)
    found = cut(candidates(docs, table, bounds(table), hint))
    chosen = found.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_of")).distinct()
    few = F.broadcast if chosen.count() <= broadcast_rows else (lambda df: df)
    row = F.xxhash64("text")
    held = docs.select("doc_id", "text", row.alias("_row")).join(few(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")), "left_semi")
    # repeated rows are told apart by a number, so that no text is shuffled to find them
    worded = _worded(held, "doc_id", F.sha2(F.col("text"), 256).alias("_digest"), F.monotonically_increasing_id().alias("_at"))
    of_doc = worded.select("doc_id", "_digest", "_at", F.explode_outer(F.array_distinct(_native.shingles(F.col("_words")))).alias("shingle"))
    shared = of_doc.join(hint(table.select("item_id", "n_item", "need", "shingle")), "shingle")
    counted = shared.groupBy("doc_id", "_digest", "_at", "item_id", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= need")
    return counted.select("doc_id", "_digest", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared")


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of each pair at or above ``threshold``.

    Of rows with the same id each is judged alone and the best counts. Null texts have no shingles; a
    text or item of fewer than five words is one shingle of all its words. Rows
    with a null id are compared like others, under the id null. Other columns
    are ignored whatever their names. An empty table gives an empty result.
    """
    best = verified(docs, items, key, threshold, broadcast_rows).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, key: str = "item_id", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows whose own text contains an item; all columns stay as they are.

    Of rows that share an id, a null one too, only those go whose text has an
    item. Null and empty texts stay, repeated rows go or stay together; an
    empty table on either side leaves ``docs`` as it is.
    """
    bad = cut(verified(docs, items, key, threshold, broadcast_rows).select(F.col("doc_id").alias("_bad_id"), F.col("_digest").alias("_bad_text")).distinct())
    few = F.broadcast if bad.count() <= broadcast_rows else (lambda df: df)
    same = docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (F.sha2(docs["text"], 256) == F.col("_bad_text"))
    return docs.join(few(bad), same, "left_anti")
