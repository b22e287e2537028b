"""Texts far longer than a chunk, through every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scopeline.llm import _fit, bpe, chat, decontaminate, jaccard, language, lm, quality, rules, suffix, toxicity
from scopeline.llm.queries import tokenizer_path

from . import cases
from .test_dedup import brute_classes, brute_cut
from .test_text import brute_counts


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(17)
    word = [f"{draw.choice('abcdé')}{draw.randrange(4000)}" for _ in range(220_000)]
    long = " ".join(word)
    assert len(long.encode()) > 1_100_000
    passage = " ".join(word[1000:1040])
    return [(4, long), (9, long.replace(word[5] + " ", "other ", 1)), (2, passage), (7, "x" * 1_200_000), (8, "short one"), (11, passage + " and so on " + " ".join(word[150_000:150_030]))]


def test_duplicates(spark, rows):
    docs = cases.table(spark, rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()) == brute_classes(rows)
    got = suffix.dedup(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_cut(rows)


def test_words_and_tokens(spark, rows):
    docs = cases.table(spark, rows)
    judged = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(docs).collect()}
    assert judged == {i: brute_counts(t) for i, t in rows}
    found = {(r.doc_id, r.n_shared) for r in decontaminate.search(docs, docs.where("doc_id = 2").withColumnRenamed("doc_id", "item_id")).collect()}
    assert found == {(i, 36) for i in (2, 4, 9, 11)}
    path = tokenizer_path()
    back = bpe.decode(bpe.encode(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    library = bpe.load(path).model
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, path).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_models(spark, rows):
    docs = cases.table(spark, rows)
    scored = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") != 9, 5).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {i: len(t.split()) + 1 for i, t in rows}
    assert scored[4].n_known == scored[4].n_tokens and scored[4].score > scored[4].base_score
    toxic = toxicity.fit([("you idiot there", 1), ("a fine day here", 0)] * 20)
    ends = docs.withColumn("text", F.concat("text", F.lit(" you idiot there")))
    tagged = {r.doc_id: r for r in toxicity.tag(ends, toxic).collect()}
    for i, t in rows:
        whole = t + " you idiot there"
        assert "idiot" in whole[tagged[i].toxic_spans[-1].start : tagged[i].toxic_spans[-1].end]
    for out in (quality.score(docs, quality.fit([("a b", 1), ("c d", 0)])), language.identify(docs, language.fit([("a b", "en"), ("c d", "fr")]))):
        assert out.count() == len(rows)
    assert len(_fit.joined([t for _, t in rows])[0]) > 3_500_000


def test_conversations(spark, rows):
    turns = spark.createDataFrame([(1, 0, "user", rows[0][1]), (1, 1, "assistant", rows[3][1]), (2, 0, "user", rows[0][1]), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_trees(turns)).collect()}
    assert back[1].loss_text == rows[3][1] and back[2].turns[0].text == rows[0][1]
