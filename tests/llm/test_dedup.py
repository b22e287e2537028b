import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scopeline.llm import _sort, _tree, graph, jaccard, suffix

from . import cases


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = re.findall("[^\x20\x09-\x0d]+", low)
    if len(word) < 5:
        return frozenset([tuple(word)] if word else [])
    return frozenset(tuple(word[i : i + 5]) for i in range(len(word) - 4))


def brute_classes(rows):
    sets, key, parent = [shingles(t) for _, t in rows], [cases.near(i) for i, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 63), key[i])
    return sorted((key[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("cell", [400, 3])
def test_classes_equal_brute_force(spark, cell):
    rows = cases.documents()
    got = sorted((cases.near(r.doc_id), r.n_shingles, cases.near(r.component_id)) for r in jaccard.classes(cases.table(spark, rows), cell).collect())
    assert got == brute_classes(rows)


@pytest.mark.parametrize("cell", [400, 2])
def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, cell):
    draw = random.Random(11)
    # each of 20 texts has three near copies; ids are shared by rows of other texts, null, or below zero
    texts = [[f"w{draw.randrange(10_000)}" for _ in range(60)] for _ in range(20)]
    firsts = [-1, 7, 7, 7, None, None, None, 8, 8, -5, -1, 9, None, 10, 11, 12, 13, 13, 14, 15]
    rows = [(i, " ".join(t)) for i, t in zip(firsts, texts, strict=True)]
    rows += [(100 + 3 * k + j, " ".join([*t[: 57 - j], "new", str(k), str(j)])) for k, t in enumerate(texts) for j in range(3)]
    got = sorted((cases.near(r.doc_id), r.n_shingles, cases.near(r.component_id)) for r in jaccard.classes(cases.table(spark, rows), cell).collect())
    assert got == brute_classes(rows) and len({c for _, _, c in got}) < len(texts)


def kept_sets(sets, spark):
    """What the operator keeps of some sets of tokens: those shared, if three quarters are, and the rarest of them."""
    count = {}
    for tokens in sets:
        for x in tokens:
            count[x] = count.get(x, 0) + 1
    rows = []
    for i, tokens in enumerate(sets):
        shared = sorted((x for x in tokens if count[x] > 1), key=lambda x: (count[x], x))
        need = -(-75 * len(tokens) // 100)
        if len(shared) >= need:
            rows.append((i, len(tokens), shared[: len(shared) - need + 1], np.array(sorted(shared), np.uint64).tobytes()))
    return spark.createDataFrame(rows, "id long, size long, prefix array<long>, tokens binary")


def brute_components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_a_template_of_many_unlinked_texts_makes_no_pairs(spark):
    # 400 texts of 80 shared tokens and 20 to 25 of their own: all meet, none link
    template = set(range(80))
    sets = [template | set(range(1000 * (i + 1), 1000 * (i + 1) + 20 + i % 6)) for i in range(400)]
    assert jaccard.members(kept_sets(sets, spark)).count() == 0
    # with a pair that does link among them only that pair's sets are left to compare with the rest
    sets += [template | {1, 2, 3}, template | {5_000_000}]
    kept = kept_sets(sets, spark)
    assert jaccard.members(kept).where("size > 81").count() <= 400
    got = {r.id: r.component for r in graph.components(jaccard.links(kept, 10)).collect()}
    truth = brute_components(sets)
    assert {i: c for i, c in enumerate(truth) if truth.count(c) > 1} == got


@pytest.mark.parametrize("cell", [400, 7, 2])
def test_links_of_wide_cells_span_the_classes(spark, cell):
    draw = random.Random(31)
    core = list(range(60))
    sets = []
    for _ in range(120):
        part = set(draw.sample(core, draw.randint(34, 60)))
        sets.append(part | set(draw.sample(range(100, 130), draw.randint(0, 12))))
    truth = brute_components(sets)
    got = {r.id: r.component for r in graph.components(jaccard.links(kept_sets(sets, spark), cell)).collect()}
    assert {i: c for i, c in enumerate(truth) if truth.count(c) > 1} == got and len(set(got.values())) < len(got)


def test_parts_that_cannot_link_are_never_paired(spark):
    every = spark.createDataFrame([(1, k, 10 + 10 * (k // 50), 13 + 10 * (k // 50)) for k in range(500)], "hub long, id long, size long, cap long")
    dealt = jaccard._dealt(every, 10, "part")
    assert dealt.groupBy("part").count().where("count > 40").isEmpty() and dealt.count() == 500
    strays = dealt.withColumnRenamed("part", "stray_part")
    live = jaccard.live_pairs(dealt, strays).count()
    parts = dealt.select("part").distinct().count()
    # a size meets its own parts and the edges of its neighbours, not all
    assert live < parts * 12 < parts * parts / 3


def test_the_least_id_of_a_cell_may_be_minus_one():
    tokens = np.arange(20, dtype=np.uint64).tobytes()
    members = pa.table({"id": [-1, 3], "size": [20, 20], "tokens": [tokens, tokens], "stray": [False, False], "known": [-1, 3]})
    assert {frozenset(r.values()) for r in jaccard._join((), members).to_pylist()} == {frozenset([-1, 3])}


def test_classes_of_an_empty_table(spark):
    assert jaccard.classes(cases.empty(spark)).count() == 0


def test_tree_links_span_the_brute_force_classes():
    draw = random.Random(5)
    for _ in range(20):
        sets = []
        for _ in range(draw.randint(1, 12)):
            base = draw.sample(range(10_000), draw.randint(1, 200))
            for _ in range(draw.randint(1, 8)):
                sets.append(np.unique(np.array([x if draw.random() > 0.06 else draw.randrange(10_000) for x in base], dtype=np.uint64)))
        size = np.array([len(s) for s in sets])
        others = draw.choice([0, 1, 3]) if len(sets) > 3 else 0
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and (not others or j < others):
                    parent[find(i)] = find(j)
        found = _tree.links(sets, size, np.arange(len(sets)), others)
        mine = list(range(len(sets)))
        for a, b in found:
            mine[find(a, mine)] = find(b, mine)
        for i in range(len(sets)):
            for j in range(i):
                assert (find(i) == find(j)) == (find(i, mine) == find(j, mine))


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deep_shallow_order_equals_sorted():
    draw = np.random.default_rng(0)
    for width, alphabet, same in ((24, 2, 17), (80, 3, 40), (16, 2, 0), (56, 256, 48)):
        grid = draw.integers(0, alphabet, (1500, width)).astype(np.uint8)
        grid[:, :same] = grid[0, :same]
        rows = [bytes(r) for r in grid]
        order, group = _sort.order(grid)
        assert [rows[i] for i in order] == sorted(rows) and group[-1] + 1 == len(set(rows))
    order, group = _sort.order(np.zeros((0, 16), np.uint8))
    assert len(order) == len(group) == 0


def brute_cut(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(first.get(raw[s : s + 50], 1 << 64), cases.near(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < cases.near(i):
                gone[s : s + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((cases.near(i), len(raw), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cuts_equal_brute_force(spark):
    rows = cases.documents(4) + [(2000 + k, "a" * (45 + k)) for k in range(12)]
    got = suffix.dedup(cases.table(spark, rows), carry=("lang",)).collect()
    assert sorted((cases.near(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_cut(rows)
    assert {r.lang for r in got} == {"en"}


def test_cuts_over_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffix, "SORT_WINDOWS", 40)
    rows = cases.documents(9)
    got = suffix.dedup(cases.table(spark, rows)).collect()
    assert sorted((cases.near(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_cut(rows)


def test_cuts_of_an_empty_table(spark):
    assert suffix.dedup(cases.empty(spark)).count() == 0
