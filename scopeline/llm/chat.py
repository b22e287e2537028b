"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share them: each distinct prefix is
a node, its turn is written once, and a tree is emitted depth first. Every node
has its interval in the tree's text, the position at which its characters stand
in any conversation through it (position ids count along the path, not along the
text), and the intervals of its ancestors, which with its own are all that its
characters may attend to.

The template marks turns by control strings. Inside texts a backslash goes after
the first character of every control string, and backslashes are doubled, so no
control string of the output comes from a text and the texts can be read back.

Conversations are dealt to bounded groups by their first turn. A beginning that
more conversations share than a group holds is *wide*: its conversations are
dealt by the turn after the longest wide beginning, so everything below it is
still written once, and only the wide turns themselves are written again, once in
each group that they lead to. Identical conversations that fill more than a group
have no turn left to differ in; they alone are dealt by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SAYS]", "[/ROLE]")
#: Characters of conversations in a group, about.
GROUP_CHARS = 4_000_000
#: Wide beginnings up to which their table is broadcast.
BROADCAST_ROWS = 200_000

_ESCAPE = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROLS)]))
_UNESCAPE = re.compile("|".join([r"\\\\", *(re.escape(c[0] + "\\" + c[1:]) for c in CONTROLS)]))
#: Strings before and after a text by role; any other role is written out.
_ROLES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE\] (?P<role>.*?) \[SAYS\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[0] == "\\\\" else m[0][0] + m[0][2:], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its loss starts and ends (assistant texts only)."""
    before, after = _ROLES.get(role) or (f"[ROLE] {escape(role)} [SAYS] ", " [/ROLE]")
    inner = escape(text)
    start = len(before)
    return before + inner + after, start, start + len(inner) * (role == "assistant")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        if kind == "other":
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append((kind, unescape(m[kind])))
        at = m.end()
    return out


@dataclass
class _Node:
    turn: tuple[str, str]
    parent: int
    children: dict
    ends: list


def tree(conversations: list[tuple[object, list[tuple[str, str]]]]) -> dict:
    """One tree's text and nodes, depth first: children in order of first appearance.

    Lists by node: parent, start, end (characters of the text), position (of the
    node's first character on its path), loss_start, loss_end, and attends: the
    intervals of the node and its ancestors, outermost first, those that touch as
    one (start, end, start, end ...). ``leaf`` has each conversation's last node,
    -1 for one without turns.
    """
    nodes: list[_Node] = []
    roots: dict = {}
    leaves = []
    for _, turns in conversations:
        at, level = -1, roots
        for turn in turns:
            if turn not in level:
                level[turn] = len(nodes)
                nodes.append(_Node(turn, at, {}, []))
            at = level[turn]
            level = nodes[at].children
        leaves.append(at)
    place, order = {}, []
    stack = list(reversed(roots.values()))
    while stack:
        i = stack.pop()
        place[i] = len(order)
        order.append(i)
        stack += reversed(nodes[i].children.values())
    text, here = [], 0
    out: dict = {k: [] for k in ("parent", "start", "end", "position", "loss_start", "loss_end", "attends")}
    for i in order:
        turn, a, b = write_turn(*nodes[i].turn)
        parent = place[nodes[i].parent] if nodes[i].parent >= 0 else -1
        seen = out["attends"][parent] if parent >= 0 else []
        seen = [*seen[:-1], here + len(turn)] if seen and seen[-1] == here else [*seen, here, here + len(turn)]
        position = out["position"][parent] + out["end"][parent] - out["start"][parent] if parent >= 0 else 0
        for k, v in (("parent", parent), ("start", here), ("end", here + len(turn)), ("position", position), ("loss_start", here + a), ("loss_end", here + b), ("attends", seen)):
            out[k].append(v)
        text.append(turn)
        here += len(turn)
    return out | {"text": "".join(text), "conv_id": [c for c, _ in conversations], "leaf": [place[i] if i >= 0 else -1 for i in leaves]}


def ancestors(parent: list[int], node: int) -> list[int]:
    """The nodes from the root down to ``node``."""
    path = []
    while node >= 0:
        path.append(node)
        node = parent[node]
    return path[::-1]


_LISTS = ("parent", "start", "end", "position", "loss_start", "loss_end", "leaf")
SCHEMA = "tree long, text string, conv_id array<long>, " + ", ".join(f"`{n}` array<int>" for n in _LISTS) + ", attends array<array<int>>"


def _step(at: Column, role: Column, said: Column) -> Column:
    """Hash of a turn at its place; those of a beginning, xored, are its key."""
    return F.xxhash64(at.cast("long"), role, said)


def _deep(turns: DataFrame, group_chars: int) -> DataFrame | None:
    """conv_id, key of the longest wide beginning and salt of each conversation that has one; None if none has.

    ``turns`` has conv_id, turn, role, a hash of the text (said) and chars; ties
    are ordered by the hash. No text is shuffled here. A null id has no row: its
    one conversation goes by its first turn.
    """

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    brief = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "said")).alias("_first"), F.sum("chars").alias("whole"))
    brief = brief.select("conv_id", _step(F.lit(1), F.col("_first.role"), F.col("_first.said")).alias("root"), "whole")
    roots = cut(brief.groupBy("root").agg(F.sum("whole").alias("n")).where(F.col("n") > group_chars).select("root"))
    if roots.isEmpty():
        return None
    hot = brief.join(sent(roots), "root", "left_semi").select("conv_id", "whole")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    step = turns.join(hot, "conv_id").withColumn("k", F.row_number().over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    step = step.withColumn("key", F.bit_xor(_step(F.col("k"), F.col("role"), F.col("said"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # after its last turn a conversation has one more beginning: itself, ended
    here = F.struct(F.col("k").alias("k"), F.col("key").alias("key"))
    ended = F.struct((F.col("k") + 1).alias("k"), F.xxhash64("key", F.lit("end")).alias("key"))
    each = cut(step.select("conv_id", "whole", F.explode(F.when(F.col("last"), F.array(here, ended)).otherwise(F.array(here))).alias("at")).select("conv_id", "whole", "at.k", "at.key"))
    wide = cut(each.groupBy("key").agg(F.sum("whole").alias("n")).where(F.col("n") > group_chars).select("key", F.lit(True).alias("is_wide")))
    at = F.struct("k", "key")
    found = each.join(sent(wide), "key", "left").groupBy("conv_id", "whole").agg(F.max(F.when(F.col("is_wide"), at)).alias("deepest"), F.min(F.when(F.col("is_wide").isNull(), at)).alias("after"))
    found = cut(found.where("deepest is not null").select("conv_id", "whole", F.col("deepest.key").alias("wide"), F.col("after.key").alias("after")))
    parts = cut(found.groupBy("wide").agg(F.ceil(F.sum("whole") / group_chars).cast("long").alias("parts")))
    by = F.when(F.col("after").isNull(), F.xxhash64("conv_id")).otherwise(F.xxhash64("after"))
    return found.join(sent(parts), "wide").select("conv_id", "wide", F.pmod(by, "parts").alias("salt"))


def format_trees(conversations: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row for each group's forest: text, conv_id, leaf and the nodes' lists (see ``tree``).

    Turns are ordered by ``turn`` (nulls first), ties by role and text; null texts
    and null roles count as empty; rows with a null conv_id are one conversation
    with the id null; repeated rows are repeated turns. Other columns are ignored
    whatever their names; an empty table gives an empty result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.col("conv_id").cast("long").alias("conv_id")
    keyed = conversations.groupBy(own).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.array_min(F.transform("turns", lambda t: F.struct(t["turn"], t["role"].alias("role"), F.xxhash64(t["text"]).alias("said"))))
    keyed = keyed.withColumn("_first", first).select("conv_id", "turns", _step(F.lit(1), F.col("_first.role"), F.col("_first.said")).alias("root"))
    total = conversations.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(32, total // group_chars)
    deep = _deep(conversations.select(own, "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("said"), (F.length(F.coalesce("text", F.lit(""))) + 32).alias("chars")), group_chars)
    placed = keyed.withColumn("salt", F.lit(0).cast("long"))
    if deep is not None:
        placed = keyed.join(deep, "conv_id", "left").select("conv_id", "turns", F.coalesce("wide", "root").alias("root"), F.coalesce("salt", F.lit(0).cast("long")).alias("salt"))
    placed = placed.select(F.pmod(F.xxhash64("root", "salt"), F.lit(groups)).alias("group"), "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held = [(c, [(t["role"], t["text"]) for t in turns]) for c, turns in zip(rows.column("conv_id").to_pylist(), rows.column("turns").to_pylist(), strict=True)]
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        made = tree(held)
        columns = {"tree": pa.array([key[0].as_py()], pa.int64()), "text": pa.array([made["text"]], pa.string()), "conv_id": pa.array([made["conv_id"]], pa.list_(pa.int64()))}
        columns |= {n: pa.array([made[n]], pa.list_(pa.int32())) for n in _LISTS}
        return pa.table(columns | {"attends": pa.array([made["attends"]], pa.list_(pa.list_(pa.int32())))})

    return placed.groupBy("group").applyInArrow(run, SCHEMA)


def read_back(trees: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text and formatted_chars of every conversation, from the output alone."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, turns, loss, chars = [], [], [], []
                for conv, leaf in zip(row["conv_id"], row["leaf"], strict=True):
                    path, seen = ancestors(row["parent"], leaf), row["attends"][leaf] if leaf >= 0 else []
                    whole = "".join(row["text"][a:b] for a, b in zip(seen[::2], seen[1::2], strict=True))
                    ids.append(conv)
                    turns.append([{"role": r, "text": t} for r, t in read_turns(whole)])
                    loss.append("".join(unescape(row["text"][row["loss_start"][i] : row["loss_end"][i]]) for i in path))
                    chars.append(len(whole))
                    if sum(chars[-1000:]) > 4_000_000 or len(ids) >= 1000:
                        yield _back(ids, turns, loss, chars, kind)
                        ids, turns, loss, chars = [], [], [], []
                yield _back(ids, turns, loss, chars, kind)

    return trees.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


def _back(ids: list, turns: list, loss: list, chars: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turns", "loss_text", "formatted_chars"])
