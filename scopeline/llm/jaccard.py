"""N-gram Jaccard join: links of documents by their five-word shingles, and the classes they form.

Two documents link when their distinct shingles overlap by three quarters of
their union. Links are exact. What is dealt out where:

1. Documents with the same set are one *node*, whose number is its own even where
   rows share an id; the least id stands for them.
2. Blocks of documents send their distinct shingles (32 bits each) to buckets,
   which answer how many documents have each. A shingle of one document alone
   can be in no overlap, so a document takes part only if three quarters of its
   shingles are shared, and only these are kept.
3. Shared shingles are ordered by frequency. Two sets that link have a shingle in
   common among the first n_shared - ceil(0.75 n) + 1 of each (the prefix), so
   documents meet over prefix shingles. Those that meet over a shingle form a
   group around the least node among them; groups with the same least node are one
   *cell*, so a document is sent to few cells however many shingles it shares.
   A member whose size and shared shingles rule out a link with even the smallest
   set of the cell is left out of it.
4. Each cell is joined by a signature tree (``_tree``). A cell above ``CELL``
   members is split by size, its hub in each part; after the components of all
   links are known, its members outside its largest component are joined by dual
   traversal with those parts of it whose sizes allow a link, which is settled
   before any set is sent. Nothing is capped: a pair that meets is compared, is
   ruled out by sizes, or is already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import _text, _tree, graph

#: Overlap of at least PART / WHOLE of the union.
PART, WHOLE = 75, 100
#: Members of a cell that are joined in one task.
CELL = 400
BLOCK_BYTES, BUCKET_SHINGLES = 2 << 20, 1 << 20
_LAST = (1 << 63) - 1


def _sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, concatenated, with offsets."""
    rows = len(off) - 1
    word, row = _text.word_hashes(buf, off)
    return _text.distinct_rows(*_text.shingles(word, row, rows), rows)


def _digests(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each row's hashes that equal sets share."""
    out = []
    for salt in (0x51ED270B, 0xA3B19535):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(value ^ np.uint64(salt)))])
        out.append((run[off[1:]] - run[off[:-1]]).view(np.int64))
    return out[0], out[1]


def shingle_counts(docs: DataFrame) -> DataFrame:
    """_key, the text's _digest, n_shingles and the set's digest (one, two) of every row, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            buf, off = _text.flat(batch.column(1))
            for a, b, part, o in _text.chunks(buf, off):
                value, edge = _sets(part, o)
                one, two = _digests(value, edge)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(edge)), pa.array(one), pa.array(two)], ["_key", "_digest", "n_shingles", "one", "two"])
            _text.release()

    return _text.map_batches(docs.select("_key", "text", "_digest"), run, "_key long, _digest binary, n_shingles long, one long, two long")


class _Block:
    """Sets of the documents of a block that stand for their equals."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        kind, key, data = notes.column("kind").to_numpy(), notes.column("key").to_numpy(), notes.column("data")
        leads = set(key[kind == 0].tolist())
        keys = docs.column("_key").to_numpy()
        # rows that share an id are told apart by their sets' digests, after which a note has the set's node
        told = [(int(key[i]), data[int(i)].as_py()) for i in np.flatnonzero(kind == 0)]
        node = {(k, d[:16]): int.from_bytes(d[16:], "little") for k, d in told}
        buf, off = _text.flat(docs.column("text"))
        ids, sets = [], []
        for a, b, part, o in _text.chunks(buf, off):
            at = [i for i in range(a, b) if int(keys[i]) in leads]
            if not at:
                continue
            rows = np.array(at) - a
            size = np.diff(o)[rows]
            sub = np.concatenate([part[o[r] : o[r + 1]] for r in rows])
            value, edge = _sets(sub, np.concatenate([[0], np.cumsum(size)]))
            one, two = _digests(value, edge)
            for j, i in enumerate(at):
                mark = (int(keys[i]), one[j].tobytes() + two[j].tobytes())
                if mark in node:
                    ids.append(node.pop(mark))
                    sets.append(value[edge[j] : edge[j + 1]])
        self.ids, self.sets = ids, sets
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.value, self.index, self.count = np.unique(every, return_inverse=True, return_counts=True)
        self.answers = {int(key[i]): data[int(i)].as_buffer() for i in np.flatnonzero(kind == 1)}

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, 32 bits of hash) of the block's shingles, their counts, and the place of each value among them."""
        bucket = self.value % np.uint64(buckets)
        piece, place = np.unique((bucket << np.uint64(32)) | (self.value >> np.uint64(32)), return_inverse=True)
        return (piece >> np.uint64(32)).astype(np.int64), piece.astype(np.uint32), np.bincount(place, weights=self.count, minlength=len(piece)), place


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("many", pa.binary())])
_NOTE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("data", pa.binary())])
_KEPT = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _send(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        bucket, piece, many, _ = _Block(docs, notes).dealt(buckets)
        many = np.minimum(many, 255).astype(np.uint8)
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        return _table([(int(bucket[a]), key[0].as_py(), piece[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)], _SENT)

    return run


def _answer(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """For each shingle that a block sent: 0 if one document has it, else one more than the power of two in the count."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in sent.column("data")]
    many = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in sent.column("many")])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    sort = every[order]
    new = np.ones(len(sort), dtype=bool)
    new[1:] = sort[1:] != sort[:-1]
    begin = np.flatnonzero(new)
    total = np.add.reduceat(many[order].astype(np.int64), begin)
    level = np.zeros(len(every), np.uint8)
    level[order] = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)[np.cumsum(new) - 1]
    rows, at = [], 0
    for block, part in zip(sent.column("block").to_pylist(), parts, strict=True):
        rows.append((block, 1, key[0].as_py(), level[at : at + len(part)].tobytes()))
        at += len(part)
    return _table(rows, _NOTE)


def _keep(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        block = _Block(docs, notes)
        bucket, piece, _, place = block.dealt(buckets)
        level = np.zeros(len(piece), np.uint8)
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            level[a:b] = np.frombuffer(block.answers[int(bucket[a])], np.uint8)
        level = level[place][block.index]
        rows, at = [], 0
        for i, s in zip(block.ids, block.sets, strict=True):
            mine = level[at : at + len(s)]
            at += len(s)
            shared = mine > 0
            need = -(-PART * len(s) // WHOLE)
            if len(s) and shared.sum() >= need:
                token = s[shared]
                first = token[np.argsort(mine[shared], kind="stable")][: int(shared.sum()) - need + 1]
                rows.append((i, len(s), first.view(np.int64).tolist(), token.tobytes()))
        return _table(rows, _KEPT)

    return run


def _join(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    """Links inside one part of a cell; with strays, between them and the whole part."""
    members = members.sort_by([("stray", "descending"), ("id", "ascending")])
    ids = members.column("id").to_numpy()
    new = np.ones(len(ids), dtype=bool)
    if not members.column("stray")[0].as_py():
        new[1:] = ids[1:] != ids[:-1]
    keep = np.flatnonzero(new)
    sets = [np.frombuffer(members.column("tokens")[int(i)].as_buffer(), np.uint64) for i in keep]
    strays = int(members.column("stray").to_numpy(zero_copy_only=False)[keep].sum())
    found = _tree.links(sets, members.column("size").to_numpy()[keep], members.column("known").to_numpy()[keep], strays, PART, WHOLE)
    a = [int(ids[keep[x]]) for x, _ in found]
    b = [int(ids[keep[y]]) for _, y in found]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def members(kept: DataFrame) -> DataFrame:
    """hub, id, size and cap of the sets of every cell, the hub among them.

    A set of size a whose shared tokens are h can only link with sets of a size
    up to its *cap*, (WHOLE + PART) / PART * h - a. A set whose cap is below the
    least size in its cell links with nothing there and is left out of it: so are
    all documents that share a template and have too much text of their own.
    """
    token = kept.select("id", F.explode("prefix").alias("token"))
    hubs = token.groupBy("token").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "hub")
    held = F.floor(F.octet_length("tokens") / 8 * (WHOLE + PART) / PART).cast("long")
    sized = kept.select("id", "size", (held - F.col("size")).alias("cap"))
    rows = cut(token.join(hubs, "token").select("hub", "id").distinct().join(sized, "id").select("hub", "id", "size", "cap"))
    least = rows.groupBy("hub").agg(F.min("size").alias("least"))
    return rows.join(least, "hub").where("cap >= least").drop("least")


def _dealt(rows: DataFrame, cell: int, name: str) -> DataFrame:
    """``rows`` with the number of their part: about ``cell`` members of a hub that are next to each other in size."""
    each = rows.groupBy("hub", "size").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("hub").orderBy("size")) - F.col("_n")
    placed = rows.join(each.withColumn("_before", before), ["hub", "size"])
    return placed.withColumn(name, F.floor((F.col("_before") + F.pmod(F.xxhash64("id"), "_n")) / cell)).drop("_n", "_before")


def live_pairs(every: DataFrame, strays: DataFrame) -> DataFrame:
    """hub, part and stray_part of the parts whose sizes and caps allow a link between them."""
    one = every.groupBy("hub", "part").agg(F.min("size").alias("low"), F.max("cap").alias("top"))
    two = strays.groupBy("hub", "stray_part").agg(F.min("size").alias("stray_low"), F.max("cap").alias("stray_top"))
    return one.join(two, "hub").where("low <= stray_top and stray_low <= top").select("hub", "part", "stray_part")


def links(kept: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that span every class of linked sets in ``kept`` (id, size, prefix, tokens), a set an id."""
    placed = cut(_dealt(members(kept), cell, "part"))
    count = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).where("n > 1").select("hub", "last")
    placed = placed.join(count, "hub")
    # the hub goes to every part, so that most of a cell is one component at once
    own = placed.where("id = hub").select("hub", "id", F.col("part").alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    spread = placed.select("hub", "id", "part").unionByName(own.where("part <> _own").select("hub", "id", "part"))
    sets = kept.select("id", "size", "tokens")
    sent = spread.join(sets, "id").select("hub", "part", "id", "size", "tokens", F.lit(False).alias("stray"), F.col("id").alias("known"))
    found = cut(sent.groupBy("hub", "part").applyInArrow(_join, "a long, b long"))

    wide = cut(placed.where("last > 0").select("hub", "id", "size", "cap", "part"))
    if wide.isEmpty():
        return found
    label = graph.components(found)
    known = cut(wide.join(label, "id", "left").select("hub", "id", "size", "cap", "part", F.coalesce("component", "id").alias("known")))
    each = known.groupBy("hub", "known").agg(F.count(F.lit(1)).alias("n"))
    main = each.groupBy("hub").agg(F.max(F.struct("n", "known")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("hub", F.col("most.known").alias("main"))
    open_cells = known.join(main, "hub")
    strays = cut(_dealt(open_cells.where("known <> main").select("hub", "id", "size", "cap", "known"), cell, "stray_part"))
    live = cut(live_pairs(open_cells, strays))
    columns = ("hub", "part", "stray_part", "id", "known")
    both = open_cells.join(live, ["hub", "part"]).select(*columns, F.lit(False).alias("stray"))
    both = both.unionByName(strays.join(live, ["hub", "stray_part"]).select(*columns, F.lit(True).alias("stray")))
    joined = both.join(sets, "id").select("hub", "part", "stray_part", "id", "size", "tokens", "stray", "known")
    more = cut(joined.groupBy("hub", "part", "stray_part").applyInArrow(_join_strays, "a long, b long"))
    return found.unionByName(more)


def _join_strays(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    """As ``_join``; a part to which no stray was dealt has nothing to join."""
    if not any(members.column("stray").to_pylist()):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    return _join(key, members)


def classes(docs: DataFrame, cell: int = CELL, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; with ``digest`` text_sha256 (32 bytes) too.

    Words are runs of bytes without ASCII white space, A-Z lower-cased; a text of
    fewer than five words is one shingle of all its words. Null texts and texts
    without words have no shingle, link with nothing and are their own class. A
    null id counts as larger than all others and comes back as null. Repeated
    rows and rows that share an id are each judged by their own text. Other
    columns are ignored whatever their names; an empty table gives an empty
    result.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(32, total // BLOCK_BYTES)
    buckets = max(16, total // 6 // BUCKET_SHINGLES)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    text_digest = F.unhex(F.sha2("text", 256)) if digest else F.lit(None).cast("binary")
    counted = cut(shingle_counts(keyed.withColumn("_digest", text_digest)))
    leads = counted.where("n_shingles > 0").groupBy("n_shingles", "one", "two").agg(F.min("_key").alias("lead"))
    leads = cut(leads.withColumn("node", F.monotonically_increasing_id()))

    def block(column: str):
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    def little(column: str):
        """A long as its eight bytes, least first, as numpy writes it."""
        return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(column), 16, "0"), 15 - 2 * k, 2) for k in range(8))))

    notes = leads.select(block("lead").alias("block"), F.lit(0).alias("kind"), F.col("lead").alias("key"), F.concat(little("one"), little("two"), little("node")).alias("data"))
    dealt = keyed.withColumn("_block", block("_key"))

    def with_notes(more: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("_block").cogroup(more.groupBy("block")).applyInArrow(_text.tidy(run), schema)

    sent = with_notes(notes, _send(buckets), "bucket long, block long, data binary, many binary")
    answers = sent.groupBy("bucket").applyInArrow(_text.tidy(_answer), "block long, kind int, key long, data binary")
    kept = cut(with_notes(notes.unionByName(answers), _keep(buckets), "id long, size long, prefix array<long>, tokens binary"))
    label = graph.components(links(kept, cell))
    named = cut(leads.join(label, leads["node"] == label["id"], "left").select("n_shingles", "one", "two", "lead", "component"))
    linked = named.where("component is not null")
    linked = linked.join(linked.groupBy("component").agg(F.min("lead").alias("class")), "component").select("n_shingles", "one", "two", "class")
    lead_class = linked.unionByName(named.where("component is null").select("n_shingles", "one", "two", F.col("lead").alias("class")))
    out = counted.join(lead_class, ["n_shingles", "one", "two"], "left")
    return out.select(
        F.nullif("_key", F.lit(_LAST)).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("class", "_key"), F.lit(_LAST)).alias("component_id"),
        *([F.col("_digest").alias("text_sha256")] if digest else []),
    )


def representatives(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each class of linked documents, and every row without links; all columns stay as they are.

    Of a class the row with the least id stays, of several with that id the one
    whose text has the least SHA-256; of rows that repeat it in id and text one
    stays. Rows that share an id are judged each by its own text. Rows with a
    null id are in nobody's way and always stay, as do texts without words. An
    empty table gives an empty result.
    """
    kept = ["_id", "_text"]
    # null texts count as empty, and have no shingle
    linked = classes(docs, cell, digest=True).where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_sha256")).alias("first")
    rows = cut(linked.groupBy("component_id", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")))
    # a class is many distinct rows, or one that repeats
    wide = rows.groupBy("component_id").agg(first, F.sum("n").alias("many")).where("many > 1").select("component_id", "first")
    placed = rows.join(wide, "component_id").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), "n", (F.struct("doc_id", "text_sha256") == F.col("first")).alias("leads"))
    placed = cut(placed)
    gone = placed.where("not leads").select(kept)
    again = placed.where("leads and n > 1").select(kept)
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))

    def same() -> Column:
        return (docs["doc_id"] == F.col("_id")) & (digest == F.col("_text"))

    out = docs.join(gone, same(), "left_anti")
    if again.isEmpty():
        return out
    once = docs.join(again, same(), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, same(), "left_anti").unionByName(once)
