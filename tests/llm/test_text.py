import hashlib
import json
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopeline.llm import _native, _text, bpe, chat, decontaminate, lm, rules
from scopeline.llm.queries import tokenizer_path

from . import cases
from .test_dedup import shingles


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_word_and_shingle_hashes_tell_texts_apart():
    rows = [t for _, t in cases.documents()]
    raw = [(t or "").encode() for t in rows]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    word, row = _text.word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)
    value, edge = _text.distinct_rows(*_text.shingles(word, row, len(rows)), len(rows))
    sets = [frozenset(value[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    names = {}
    for t, s in zip(rows, sets, strict=True):
        assert len(s) == len(shingles(t)) and names.setdefault(shingles(t), s) == s
    assert len(set(sets)) == len(names)


# byte-pair encoding

SPECIAL = ["a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "it's 'still' x's !'s 12,3 \n\n  é中文  x \u0085y \x1c\x1d z", "😀😀 ok <|endoftext|", "  "]


@pytest.mark.parametrize("table_words", [bpe.TABLE_WORDS, 40, 0])
def test_bpe_equals_the_library(spark, table_words):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = cases.documents() + [(5000 + i, t) for i, t in enumerate(SPECIAL)]
    docs = cases.table(spark, rows)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((cases.near(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(cases.near(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path, table_words).collect()]
    assert sorted(got) == sorted(expected)
    back = bpe.decode(bpe.encode(docs, path, table_words), path).collect()
    assert sorted((cases.near(r.doc_id), r.text) for r in back) == sorted((cases.near(i), t or "") for i, t in rows)
    assert bpe.round_trip(cases.empty(spark), path).count() == 0


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    path = tokenizer_path()
    docs = cases.table(spark, cases.documents())
    table = bpe.word_table(docs, path)
    words = [w for r in bpe._words(docs, path, []).collect() for w in r._words if len(w.encode()) <= bpe.WORD_BYTES]
    twice = {w for w, n in Counter(words).items() if n > 1}
    assert sorted(table.words.to_pylist()) == sorted(twice) and len(table.off) == len(twice) + 1
    few = bpe.word_table(docs, path, 40)
    assert 0 < len(few.words) <= 40 and min(Counter(words)[w] for w in few.words.to_pylist()) >= max(n for w, n in Counter(words).items() if w not in set(few.words.to_pylist())) / 2
    seen = []
    whole = bpe.word_ids
    monkeypatch.setattr(bpe, "word_ids", lambda tokenizer, words: seen.extend(words) or whole(tokenizer, words))
    column = pa.array([r._words for r in bpe._words(docs, path, []).collect()], pa.list_(pa.string()))
    list(bpe.encode_words(bpe.load(path), column, table))
    assert not set(seen) & twice and len(seen) == len(set(seen))


def test_bpe_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        bpe.added(tokenizer_path("word_bpe_49k.json"))


# language model


def lm_tokens(t):
    return [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


@pytest.mark.parametrize("state_count", [1, 4, lm.STATE_COUNT])
def test_lm_equals_brute_force(spark, state_count):
    rows = cases.documents()
    learn = F.col("doc_id") % 7 != 2
    train = [lm_tokens(t) for i, t in rows if i is None or i % 7 != 2]
    one, starts = Counter(w for t in train for w in t), len(train)
    two = Counter(p for t in train for p in zip([0, *t[:-1]], t, strict=True))
    three = Counter(p for t in train for p in zip([0, *t[:-2]], t[:-1], t[1:], strict=False))
    n, v, b = sum(one.values()), len(one), lm.STRENGTH
    expected = []
    for i, t in rows:
        token, base, score = lm_tokens(t), 0.0, 0.0
        for at, w in enumerate(token):
            h = token[at - 1] if at else 0
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            held = starts if h == 0 else one[h]
            p = (two[h, w] + b * p) / (held + b)
            hh = None if at == 0 else 0 if at == 1 else token[at - 2]
            if at and two[hh, h] >= state_count:
                p = (three[hh, h, w] + b * p) / (two[hh, h] + b)
            score += math.log10(p)
        expected.append((cases.near(i), len(token), sum(one[w] > 0 for w in token), n, round(base, 6), round(score, 6)))
    got = lm.score(cases.table(spark, rows), learn, state_count).collect()
    assert sorted((cases.near(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(expected)
    assert lm.score(cases.empty(spark), F.lit(True)).count() == 0


def small_automaton(texts, state_count):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    own = lm._Block(pa.table({"text": texts, "_learn": [True] * len(texts)}))
    words, pairs = own.distinct(own.text.word)[1], own.distinct(own.text.pair)[1]
    triples = own.triples(pairs, state_count)[1]
    assert len(off) == len(own.text.edge)
    return own.text, words, lm.automaton(own.text, words, pairs, triples, int(words.count.sum()), len(words.count), len(texts), state_count)


def test_lm_states_sum_to_one_and_lanes_carry_the_state():
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcdefg") for _ in range(draw.choice([0, 1, 2, 3, 70, 200]))) for _ in range(40)]
    text, words, model = small_automaton(texts, 3)
    assert len(model.fail) > model.start + 20
    # every state's words, and one that was never learned, whose arc is the root's last
    model.root = np.append(model.root, np.log10(1 / (words.count.sum() + len(words.count) + 1)))
    model.root_to = np.append(model.root_to, 0)
    every = np.arange(len(model.root))
    end = words.place[text.edge[1] - 1]
    for state in (i for i in range(len(model.fail)) if i != end + 1):
        _, weight = model.step(np.full(len(every), state), every)
        assert (10**weight).sum() == pytest.approx(1)
    # one lane a text, token by token, from the start
    out, state = model.walk(words.place, text.first), 0
    for t, (w, first) in enumerate(zip(words.place, text.first, strict=True)):
        to, weight = model.step(np.array([model.start if first else state]), np.array([w]))
        state = to[0]
        assert out[t] == pytest.approx(weight[0])


def test_lm_messages_keep_whole_keys():
    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 300_000):
        key = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm._unpack(pa.py_buffer(lm._pack(key))) == key).all()
    assert len(lm._pack(key)) < 6.5 * len(key)
    many = draw.integers(0, 600, 1000)
    assert (lm._large(pa.py_buffer(lm._small(many)), 1000) == many).all()


# quality rules


def brute_counts(text):
    text = text or ""
    word = words(text)
    runs = Counter(tuple(word[i : i + 5]) for i in range(len(word) - 4))
    under = {i + k for i in range(len(word) - 4) if runs[tuple(word[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(word), sum(map(len, word)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


def test_rules_equal_brute_force(spark):
    rows = cases.documents() + [(7000, "l one\nl one\n\nl two\nl one"), (7001, "a b c d e f a b c d e g " * 5), (7002, "x y z\r\nx y z\x0bx y z\x0cq")]
    got = rules.judge(cases.table(spark, rows)).collect()
    mine = sorted((cases.near(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert mine == sorted((cases.near(i), *brute_counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) and (r.failed_rule is None) == r.kept
    verdict = {(cases.near(r.doc_id), r.kept) for r in got}
    assert {(cases.near(r.doc_id), r.kept) for r in rules.judge(cases.table(spark, rows), counts=False).collect()} == verdict
    assert rules.judge(cases.empty(spark)).count() == 0


def test_cascade_order_follows_rejection_and_changes_no_verdict(spark):
    docs = spark.range(1000)
    some = [rules.Rule("never", F.col("id") < 0), rules.Rule("most", F.col("id") > 100), rules.Rule("null", F.lit(None).cast("boolean"))]
    order = rules.ordered(docs, some)
    assert order[0] == "most" and sorted(order) == ["most", "never", "null"]
    for given in (order, order[::-1]):
        assert sorted(r.id for r in rules.cascade(docs, some, given).where("kept").collect()) == list(range(101))
    assert rules.cascade(docs, [], []).where("kept").count() == 1000


def test_a_late_rule_is_not_evaluated_for_an_early_rejection(spark):
    docs = cases.table(spark, [(1, "few words"), (2, "é"), (3, None)])

    def some(of):
        return [rules.Rule("late", F.when(of("n_upper") >= 0, F.raise_error(F.lit("reached"))).cast("boolean")), rules.Rule("few_words", of("n_words") < 10)]

    for counts in (True, False):
        early = rules.judge(docs, some, counts, order=["few_words", "late"]).collect()
        assert {(r.kept, r.failed_rule) for r in early} == {(False, "few_words")}
        with pytest.raises(Exception, match="reached"):
            rules.judge(docs, some, counts, order=["late", "few_words"]).collect()


def test_the_order_is_measured_on_a_random_sample_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = rules.random_rows(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000_000)), 400)
    ids = [r.doc_id for r in few.select("doc_id").collect()]
    assert 300 < len(ids) < 500 and 0.3 < np.mean([i > 10_000_000 for i in ids]) < 0.7
    assert rules.random_rows(docs, 10**9).count() == docs.count()
    costly = rules.repeated_words(F.col("_words"))
    sample = rules.measured(docs, ["doc_id"]).persist()
    # two rules that reject the same, one of them dear, and one that rejects less
    some = [rules.Rule("dear", (costly >= 0) & (F.length("_text") > 200)), rules.Rule("cheap", F.length("_text") > 200), rules.Rule("idle", F.lit(False))]
    assert [rules.ordered(sample, some) for _ in range(2)] == [["cheap", "dear", "idle"]] * 2
    sample.unpersist()


# decontamination


def test_search_equals_brute_force(spark):
    rows = cases.documents()
    draw = random.Random(3)
    items = [(k, t) for k, (_, t) in enumerate(draw.sample(rows, 20))] + [(100, None), (101, "a b"), (102, ""), (103, rows[0][1]), (None, rows[1][1])]
    items += [(200 + k, " ".join(words(t)[4:30])) for k, (_, t) in enumerate(rows[:30]) if len(words(t)) > 40]
    expected = set()
    for i, t in rows:
        for k, s in items:
            a, b = shingles((t or "").lower()), shingles((s or "").lower())
            if b and 100 * len(a & b) >= 75 * len(b):
                expected.add((i, k))
    docs, bench = cases.table(spark, rows), spark.createDataFrame([(k, s, 1) for k, s in items], "item_id long, text string, hash int")
    got = decontaminate.search(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(docs, bench, broadcast_rows=0).collect()} == expected
    def holds(t):
        a = shingles((t or "").lower())
        return any(b and 100 * len(a & b) >= 75 * len(b) for b in (shingles((s or "").lower()) for _, s in joined_items(items)))

    left = decontaminate.remove(docs, bench)
    clean = [(cases.near(i), t or "") for i, t in rows if not holds(t)]
    assert left.columns == docs.columns and sorted((cases.near(r.doc_id), r.text or "") for r in left.collect()) == sorted(clean)
    assert left.collect() and decontaminate.remove(docs, bench, broadcast_rows=0).count() == len(clean) == decontaminate.remove(docs, bench.unionByName(bench)).count()
    assert decontaminate.remove(docs, bench.where("false")).count() == len(rows) and decontaminate.remove(cases.empty(spark), bench).count() == 0
    assert decontaminate.search(cases.empty(spark), bench).count() == 0 and decontaminate.search(docs, bench.where("false")).count() == 0


def joined_items(items):
    """Rows with the same id are one item; here every id is its own."""
    assert len({k for k, _ in items}) == len(items)
    return items


def test_removal_judges_each_row_by_its_own_text(spark):
    item, clean = " ".join(f"i{k}" for k in range(30)), " ".join(f"c{k}" for k in range(30))
    docs = cases.table(spark, [(None, item), (None, clean), (4, clean), (4, "so " + item), (5, item), (5, item), (6, None), (7, "")])
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = sorted((cases.near(r.doc_id), r.text or "") for r in decontaminate.remove(docs, bench).collect())
    assert kept == [(4, clean), (6, ""), (7, ""), (cases.near(None), clean)]
    found = decontaminate.search(docs, bench).collect()
    assert sorted((cases.near(r.doc_id), r.n_shared, r.n_item) for r in found) == [(4, 26, 26), (5, 26, 26), (cases.near(None), 26, 26)]


def test_item_shingles_have_the_hashes_of_document_shingles(spark):
    docs = cases.table(spark, cases.documents()).where("text is not null")
    word = decontaminate._worded(docs, "text")
    both = word.select(_native.shingle_hashes(F.col("_words")).alias("h"), F.transform(_native.shingles(F.col("_words")), lambda s: _native.shingle_hash(s)).alias("s"))
    assert both.where("h <> s").count() == 0 and both.where("size(h) = 1").count() > 0


def test_signatures_miss_no_pair_and_leave_most_hashes_out(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    table = decontaminate.item_table(items).persist()
    parts = decontaminate.bounds(table)
    assert 0 < len(parts) < 31
    met = {(r.doc_id, r.item_id) for r in decontaminate.candidates(docs, table, parts, F.broadcast).collect()}
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items).collect()} <= met
    table.unpersist()


def test_documents_are_hashed_in_one_pass_and_never_shuffled_whole(spark, tmp_path):
    cases.table(spark, cases.documents()).write.parquet(str(tmp_path / "d"))
    docs, items = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    table = decontaminate.item_table(items)
    for plan in (decontaminate.candidates(docs, table, [(2, 0)], F.broadcast), decontaminate.verified(docs, items)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1, text
        for line in text.splitlines():
            assert not ("Exchange hashpartitioning" in line and "text#" in line)


# chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[SAYS]"]), st.text(alphabet=st.sampled_from(list("\\</>sINST[]ROLEAY x\n")), max_size=30)), max_size=5))
def test_turns_read_back(turns):
    assert chat.read_turns("".join(chat.write_turn(r, t)[0] for r, t in turns)) == turns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "a", "<", "["]), max_size=12).map("".join))
def test_escaping_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def conversations(seed=1):
    draw = random.Random(seed)
    openings = ["hello", "</s>[INST] ok [/INST]", "a\\b <s>"]
    rows = []
    for c in range(40):
        for t in range(draw.randint(1, 6)):
            said = draw.choice(openings) if t == 0 else draw.choice([f"{c} {t}", "same", None, ""])
            rows.append((c, t, ["user", "assistant"][t % 2] if draw.random() < 0.9 else None, said))
    return rows + [(90, None, "user", "x"), (90, 0, "system", "y"), (None, 0, "user", "n"), (91, 0, "assistant", "tie"), (91, 0, "assistant", "tie")]


@pytest.mark.parametrize("group_chars", [4_000_000, 300])
def test_trees_read_back_and_share_prefixes(spark, group_chars):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    trees = chat.format_trees(df, group_chars)
    held = {}
    for c, t, r, s in rows:
        held.setdefault(c, []).append(((t is not None, t or 0), r or "", s or ""))
    expected = {c: [(r, s) for _, r, s in sorted(x)] for c, x in held.items()}
    back = chat.read_back(trees).collect()
    assert len(back) == len(expected)
    for r in back:
        assert [tuple(t) for t in r.turns] == expected[r.conv_id]
        assert r.loss_text == "".join(s for role, s in expected[r.conv_id] if role == "assistant")
        assert r.formatted_chars == sum(len(chat.write_turn(*t)[0]) for t in expected[r.conv_id])
    total = 0
    for tree in trees.collect():
        total += len(tree.text)
        paths = set()
        for node in range(len(tree.start)):
            path = chat.ancestors(tree.parent, node)
            assert tree.position[node] == sum(tree.end[i] - tree.start[i] for i in path[:-1])
            seen = {x for a, b in zip(tree.attends[node][::2], tree.attends[node][1::2], strict=True) for x in range(a, b)}
            assert seen == {x for i in path for x in range(tree.start[i], tree.end[i])}
            paths.add(tuple(tree.text[tree.start[i] : tree.end[i]] for i in path))
            assert tree.parent[node] < node and (tree.parent[node] == node - 1 or tree.parent[node] == tree.parent[node - 1] or tree.parent[node] in chat.ancestors(tree.parent, node - 1) or tree.parent[node] == -1)
        assert len(paths) == len(tree.start)
    if group_chars > 1000:
        prefixes = {tuple(t[: k + 1]) for t in expected.values() for k in range(len(t))}
        assert total == sum(len(chat.write_turn(*p[-1])[0]) for p in prefixes)
    assert chat.format_trees(df.where("false"), group_chars).count() == 0


def test_a_wide_beginning_is_dealt_by_the_turns_after_it(spark):
    # one system prompt and greeting for all, then eight questions with answers of their own, and 30 whole copies of one conversation
    rows = []
    for c in range(120):
        said = ["prompt " * 3, "greeting", f"question {c % 8}", f"answer {c}"] if c < 90 else ["prompt " * 3, "greeting", "copied", "end"]
        rows += [(c, t, ["system", "assistant", "user", "assistant"][t], x) for t, x in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit, copies in ((9000, 1), (3000, None)):
        written = {}
        trees = chat.format_trees(df, limit)
        for tree in trees.collect():
            for node in range(len(tree.start)):
                path = tuple(tree.text[tree.start[i] : tree.end[i]] for i in chat.ancestors(tree.parent, node))
                written[path] = written.get(path, 0) + 1
        copied = max(n for p, n in written.items() if len(p) > 2 and "copied" in p[2])
        assert copied == copies if copies else copied > 1
        assert {n for p, n in written.items() if len(p) > 2 and "copied" not in p[2]} == {1}
        assert 1 < max(n for p, n in written.items() if len(p) == 1) <= sum(len(r[3]) + 32 for r in rows) // limit + 3
        held = {}
        for c, _, r, x in rows:
            held.setdefault(c, []).append((r, x))
        assert {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(trees).collect()} == held


def test_json_free_of_state():
    assert json.loads(json.dumps(chat.tree([(1, [("user", "a")]), (2, [("user", "a"), ("assistant", "b")])])))["leaf"] == [0, 1]
