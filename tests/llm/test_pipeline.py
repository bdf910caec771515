"""The pipeline's stages, each against a plain version on its own input."""

import pytest

import corpus_pipeline
from callweave.llm import language
from tests.conftest import DATA
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over the small tables, with some awkward documents added."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "12 34", "en", "s", 5), (10**6 + 3, "ab", None, None, None), (None, "no id here", "en", "s", 10), (None, "no id here", "en", "s", 10)], docs.schema)
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_language_rejects_texts_without_letters(stages):
    before, after = stages[0]
    want = sorted(str((r.doc_id, r.text)) for r in before.collect() if language.has_letter(r.text))
    assert sorted(str((r.doc_id, r.text)) for r in after.collect()) == want
    assert after.where("lang is null").count() == 0


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    texts = {r.doc_id: r.text for r in before.collect() if r.doc_id is not None}
    components, _ = brute.jaccard_components(texts, 5, 80, 100)
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted(set(components.values()))
    assert after.where("doc_id is null").count() == before.where("doc_id is null").count()


def test_leaked_documents_go(spark, stages):
    before, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in before.collect() if r.doc_id is not None}
    leaked = {i for i, t in texts.items() if any(brute.weighted_windows(t, x, 0.8) for x in items)}
    assert {r.doc_id for r in after.collect()} - {None} == set(texts) - leaked


def test_base_kinds_are_redacted(stages):
    before, after = stages[3]
    clean = {r.doc_id: r for r in after.collect()}
    assert after.count() == before.count()
    for r in before.collect():
        spans = brute.personal_spans(r.text)
        got = clean[r.doc_id]
        assert got.n_chars == len(got.text)
        assert bool(spans) <= (got.text != r.text)
        assert not [s for s in brute.personal_spans(got.text) if s[0] == "email"]


def test_all_that_is_left_is_packed(stages):
    before, pieces = stages[4]
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())


def test_empty_and_unlabelled_tables_and_other_columns(spark):
    """A table without rows, one without labels, and columns with the names that the operators use themselves."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).collect() == []
    rows = [(k, f"some words of text number {k} that stand alone", None, "s", 9, 777.0, "p", "t", 5, "m") for k in range(3)] + [(9, "12 34", None, "s", 5, 1.0, "p", "t", 5, "m")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, text_hash string, component_id int, spans string")
    labelled = more.union(more.limit(1).selectExpr("doc_id + 100", "text || ' x'", "'en'", *more.columns[3:]))
    for given, ids in ((more, {0, 1, 2}), (labelled, {0, 1, 2, 100})):
        kept = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, DATA)
            assert kept.columns == given.columns
        got = {r.doc_id: r for r in kept.collect()}
        assert set(got) == ids - ({100} if len(got) == 3 else set()) and all((r.score, r.lang_pred, r.text_hash, r.component_id, r.spans) == (777.0, "p", "t", 5, "m") for r in got.values())
        assert {r.lang for r in got.values()} == ({None} if given is more else {"en"})
