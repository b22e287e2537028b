import pytest

import corpus_pipeline
from scopeline.llm import _fit, bpe, oracles, queries, toxicity

from ..oracle import compare
from . import cases
from .test_dedup import brute_classes, brute_cut, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], oracles.ORACLES[name], SF)


def test_the_ten_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_filter_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS and dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.collect()
        assert 0.5 * before <= len(rows) <= before
        docs = spark.createDataFrame(rows, docs.schema)


def test_near_copies_leave_one_of_each_class(spark):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "q r s t u v w"), (None, "a b c d e f g h"), (4, ""), (6, None)]
    docs = cases.table(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(cases.near(r.doc_id) for r in kept.collect()) == [3, 4, 6, 9, cases.near(None)]


def test_near_copies_are_judged_by_their_own_text(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, b), (5, a), (5, b + " more"), (7, a + " more"), (8, "w x"), (8, "w x"), (9, None), (9, None), (10, b), (2, "lone words that have no copy at all"), (12, a + " z"), (12, a + " z")]
    kept = corpus_pipeline.drop_near_copies(spark, cases.table(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(3, b), (5, a), (8, "w x"), (9, ""), (9, ""), (2, rows[9][1])])


def test_one_row_of_each_brute_force_class_stays(spark):
    rows = cases.documents(23)
    classes, least = {}, {}
    kept = corpus_pipeline.drop_near_copies(spark, cases.table(spark, rows), SF).collect()
    for key, n, c in brute_classes(rows):
        classes.setdefault(c if n else None, []).append(key)
    for c, keys in classes.items():
        least[c] = min(keys)
    left = sorted(cases.near(r.doc_id) for r in kept if shingles(r.text) and r.doc_id is not None)
    # each class of rows with an id leaves its least id, once
    expected = sorted(x for c, x in least.items() if c is not None and x != cases.near(None))
    assert left == expected
    assert sum(not shingles(r.text) for r in kept) == sum(not shingles(t) for _, t in rows)


@pytest.mark.parametrize("at", range(5))
def test_stages_over_awkward_and_empty_tables(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, cases.empty(spark), SF).count() == 0, name
    rows = cases.documents(3)
    kept = stage(spark, cases.table(spark, rows), SF)
    if at < 4:
        assert kept.columns == corpus_pipeline.COLUMNS
    out = kept.collect()
    assert {cases.near(r.doc_id) for r in out} <= {cases.near(i) for i, _ in rows} and 0 < len(out) <= len(rows)
    if name in ("repeated_passages", "tokens"):
        assert len(out) == len(rows)


def test_toxic_stage_equals_the_scores(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, marks, keep=_fit.remainder(4) != 2)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = [i for i, t in texts.items() if toxicity.scores(model, *_fit.joined([t]))[0][0] < 0.3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == sorted(clean) and len(clean) < len(texts)


def test_contaminated_stage_equals_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    wanted = [shingles(r.text.lower()) for r in items if shingles((r.text or "").lower())]
    clean = []
    for r in docs:
        mine = shingles((r.text or "").lower())
        if not any(100 * len(mine & w) >= 75 * len(w) for w in wanted):
            clean.append(r.doc_id)
    out = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean) and len(clean) < len(docs)


def test_tokens_stage_decodes_to_the_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = {r.doc_id: r.text for r in bpe.decode(corpus_pipeline.encode(spark, docs, SF), queries.tokenizer_path()).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def test_repeats_are_cut_as_by_brute_force(spark):
    rows = cases.documents(11)
    out = corpus_pipeline.cut_repeats(spark, cases.table(spark, rows), SF).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    left = sum(n - gone for _, n, gone, _, _ in brute_cut(rows))
    assert sum(len(r.text.encode()) for r in out) <= left <= sum(len(r.text.encode()) for r in out) + 6 * len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and {"doc_id", "n_tokens", "ids"} == set(out.columns)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out.collect())
