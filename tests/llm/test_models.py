import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeline.llm import _crf, _fit, _text, language, quality, queries, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


def labels(spark, column, held):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").where(held).collect() if r[column] is not None}


@pytest.mark.parametrize("query,column,held,least", [("op1_quality_classifier", "quality", (3, 1), 0.95), ("op8_toxic_spans", "toxic", (4, 2), 0.9)])
def test_held_out_accuracy(spark, query, column, held, least):
    out = queries.QUERIES[query](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 for r in out)
    truth = labels(spark, column, F.crc32(F.col("doc_id").cast("string")) % held[0] == held[1])
    got = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(got) > 50 and np.mean([a == b for a, b in got]) >= least


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.QUERIES["op9_language_chain"](spark, SF).collect() if r.held_out and docs[r.doc_id]]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in out]) >= 0.95


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(6)
    buf, off = _fit.joined(["one two three. four five", "", "six seven eight nine"])
    words = _crf.chain(buf, off, (("prefix", 2),))
    model = _crf.Crf([0, 1, 2], [draw.normal(size=(1 << _crf.BITS, 3)) for _ in range(2)], draw.normal(size=(3, 3)), draw.normal(size=3))
    got, at = _crf.marginals(model, words), 0
    for first, n in zip(words.first, words.length, strict=True):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            score = model.begin[path[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(path))
            score += sum(t[f[first + i], path[i]] for t, f in zip(model.table, words.feature, strict=True) for i in range(n))
            for i, tag in enumerate(path):
                total[i, tag] += np.exp(score)
        assert got[at : at + n] == pytest.approx(total / total.sum(axis=1, keepdims=True))
        at += n
    assert list(words.length) == [3, 2, 4]


def train_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("text", "toxic", "quality").collect()
    return [(r.text, r.toxic) for r in rows], [(r.text, r.quality) for r in rows]


def test_toxic_spans_cover_the_words(spark):
    toxic, _ = train_pairs(spark)
    model = toxicity.fit(toxic)
    docs = cases.table(spark, [(1, "Thé ändere idiot, the moron. fine"), (2, "the fine thing"), (3, None), (4, "")])
    out = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    text = "Thé ändere idiot, the moron. fine"
    assert [text[s.start : s.end] for s in out[1].toxic_spans] == ["idiot", "moron"] and out[1].n_toxic_words == 2
    assert out[2].toxic_spans == [] == out[3].toxic_spans and out[1].score > 0.3 > out[2].score
    assert sorted(r.doc_id for r in toxicity.below(docs, model, 0.3).collect()) == [2, 3, 4]


def test_edge_rows_are_scored(spark):
    rows = cases.documents()
    docs = cases.table(spark, rows)
    toxic, good = train_pairs(spark)
    for out in (quality.score(docs, quality.fit(good[:200])), toxicity.tag(docs, toxicity.fit(toxic[:200]))):
        got = out.collect()
        assert sorted(cases.near(r.doc_id) for r in got) == sorted(cases.near(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(cases.empty(spark), quality.fit([])).count() == 0


def test_models_without_training_rows(spark):
    docs = cases.table(spark, [(1, "some words"), (2, None)])
    assert {r.score for r in quality.score(docs, quality.fit([])).collect()} == {0.5}
    assert {r.score for r in toxicity.tag(docs, toxicity.fit([])).collect()} == {0.0}
    assert {r.score for r in toxicity.tag(docs, toxicity.fit([("a b c", 0)])).collect()} == {0.0}
    assert {r.lang_pred for r in language.identify(docs, language.fit([])).collect()} == {"und"}


def test_language_of_mixed_and_letterless_text(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()]
    model = language.fit([(r.text, r.lang) for r in rows[:300]])
    french = next(r.text for r in rows if r.lang == "fr" and len(r.text) > 400)[:300]
    english = next(r.text for r in rows if r.lang == "en" and len(r.text) > 400)[:200]
    docs = cases.table(spark, [(1, french + " " + english), (2, "12 34 !!"), (3, None), (4, ""), (5, "é")])
    out = {r.doc_id: r for r in language.identify(docs, model, word_shares=True).collect()}
    assert out[1].lang_pred == "fr" and min(out[1].shares[model.tags.index("fr")], out[1].shares[model.tags.index("en")]) > 0.2
    assert [out[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and out[2].score == 0 and out[5].lang_pred != "und"


def test_training_rows_are_bounded_and_repeatable(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = _fit.labelled(docs, marks, "toxic", _fit.remainder(4) != 2, 30)
    assert len(one) == 30 and one == _fit.labelled(docs.repartition(7), marks.repartition(3), "toxic", _fit.remainder(4) != 2, 30)
    assert len(_fit.labelled_by(docs.unionByName(docs), "lang", F.lit(True), 5)) == 5 * docs.where("lang is not null").select("lang").distinct().count()


def test_long_texts_teach_and_all_together_are_bounded(spark, monkeypatch):
    rows = [(i, "word " * (10 if i % 2 else 60_000), "short" if i % 2 else "long") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(y for _, y in _fit.labelled_by(docs, "lang", F.lit(True), 9)) == ["long"] * 5 + ["short"] * 5
    monkeypatch.setattr(_fit, "MAX_TRAIN_CHARS", 700_000)
    assert sorted(y for _, y in _fit.labelled_by(docs, "lang", F.lit(True), 9)) == ["long"] * 2 + ["short"] * 5
    monkeypatch.setattr(_fit, "MAX_TRAIN_CHARS", 0)
    assert sorted(y for _, y in _fit.labelled_by(docs, "lang", F.lit(True), 9)) == ["long", "short"]


def test_quality_features_and_scores_equal_a_naive_loop():
    draw = np.random.default_rng(2)
    rows = ["", "a", "the cat the the cat", "é ü ü #$", " ".join(draw.choice(["one", "two", "three", "é"], 40))]
    buf, off = _fit.joined(rows)
    model = quality.QualityModel(draw.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    got = quality.scores(model, buf, off)
    for text, score in zip(rows, got, strict=True):
        raw, parts = text.encode(), []
        word = text.split()
        for i, w in enumerate(word):
            b, o = _fit.joined([w])
            parts.append(int(_text.between(_text.prefix_hash(b), o[:1], o[1:])[0]) >> (64 - quality.WORD_BITS))
            parts.append(quality.SHAPE + (i > 0 and word[i - 1] == w))
        for width, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for i in range(len(raw) - width + 1):
                gram = int.from_bytes(raw[i : i + width], "big") * salt % (1 << 32)
                parts.append((gram >> (32 - quality.GRAM_BITS)) + (1 << quality.WORD_BITS) + (width - 3) * (1 << quality.GRAM_BITS))
        logit = 0.3 + sum(float(model.weight[p]) for p in parts) / (len(parts) + quality.PRIOR_FEATURES)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-5)


def test_crf_gradient_equals_a_numeric_one():
    draw = np.random.default_rng(9)
    buf, off = _fit.joined(["one two three four", "two five one"])
    words = _crf.chain(buf, off, ())
    tag = np.array([0, 1, 1, 0, 1, 0, 0])
    table, move, begin = draw.normal(size=(1 << _crf.BITS, 2)), draw.normal(size=(2, 2)), draw.normal(size=2)

    def loss(t):
        total = 0.0
        for first, n in zip(words.first, words.length, strict=True):
            f = words.feature[0][first : first + n]

            def value(path, f=f):
                return begin[path[0]] + sum(move[a, b] for a, b in itertools.pairwise(path)) + sum(t[x, y] for x, y in zip(f, path, strict=True))

            total += value(tuple(tag[first : first + n])) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(2), repeat=int(n))))
        return total

    model = _crf.Crf([0, 1], [table], move, begin)
    slope = np.eye(2)[tag] - _crf.marginals(model, words)
    for bucket in np.unique(words.feature[0]):
        mine = slope[words.feature[0] == bucket].sum(axis=0)
        for k in range(2):
            up, down = table.copy(), table.copy()
            up[bucket, k] += 1e-5
            down[bucket, k] -= 1e-5
            assert mine[k] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_toxic_and_language_tables_may_be_empty(spark):
    empty = cases.empty(spark)
    assert toxicity.tag(empty, toxicity.fit([])).count() == 0 == toxicity.below(empty, toxicity.fit([]), 0.3).count()
    assert language.identify(empty, language.fit([("a b", "en")])).count() == 0
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")).extra["logistic"] is None


def test_document_scores_are_digests_of_the_marginals():
    draw = np.random.default_rng(12)
    row = np.sort(draw.integers(0, 5, 30))
    marginal = draw.random(30)
    got = toxicity._digest(marginal, row, 6)
    for i in range(6):
        mine = marginal[row == i]
        top = min(max(mine.max(initial=0), 1e-4), 1 - 1e-4)
        assert got[i] == pytest.approx([np.log(top / (1 - top)), np.log1p(sum(m for m in mine if m >= 0.1))])


def test_every_label_is_learned(spark, monkeypatch):
    rows = [(i, f"text {i} of words", f"l{i % 90:02d}") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = sorted({y for _, _, y in rows})
    assert language.train(docs).tags == names
    for bound, each in ((_fit.MAX_ROWS, 5), (270, 3), (10, 1)):
        monkeypatch.setattr(_fit, "MAX_ROWS", bound)
        got = [y for _, y in _fit.labelled_by(docs, "lang", F.lit(True), 200)]
        assert sorted(got) == sorted(names * each)


def test_all_of_a_text_without_spaces_counts():
    draw = np.random.default_rng(3)
    signs = {"one": "山水火木金土日月", "two": "あいうえおかきく"}

    def text(lang):
        # both languages begin and end alike
        return "甲乙丙" + "".join(draw.choice(list(signs[lang]), 40)) + "丁戊己"

    model = language.fit([(text(lang), lang) for lang in signs for _ in range(40)])
    truth = [lang for lang in signs for _ in range(20)]
    share, _, _ = language.shares(model, *_fit.joined([text(lang) for lang in truth]))
    assert [model.tags[i] for i in share.argmax(axis=1)] == truth


def test_pieces_cover_words_between_characters():
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("aé山😀-"), n)) for n in [*range(1, 40), 500]]
    buf, off = _fit.joined(words)
    a, b, word = _crf.pieces(buf, off[:-1], off[1:], 10)
    cut = [buf[x:y].tobytes() for x, y in zip(a, b, strict=True)]
    assert ["".join(c.decode() for c, w in zip(cut, word, strict=True) if w == i) for i in range(len(words))] == words
    assert all(0 < len(c) <= 10 for c in cut) and all((word == i).sum() == 1 for i, w in enumerate(words) if len(w.encode()) <= 10)
