import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_ngram_join, test_suffix_dedup
from tidemark.session import materialize

SF = "/root/testdata/sf0.001"


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what every stage makes of them."""
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF), "test-stage"))
    return found


def test_classifier_keeps_what_is_labelled_good(spark, stages):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(stages[1])
    before = texts(stages[0])
    assert all(before[i] == t for i, t in kept.items())
    good = [i for i, q in quality.items() if q == 1 and i in before]
    bad = [i for i, q in quality.items() if q == 0 and i in before]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    groups = test_ngram_join.brute_force([*texts(stages[1]).items()], 5, 80)
    assert set(texts(stages[2])) == {int(i) for i, _, first in groups if int(i) == first}
    assert stages[2].columns == stages[3].columns == stages[4].columns == corpus_pipeline.COLUMNS


def test_later_copies_are_cut(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = test_suffix_dedup.brute_force([*before.items()])
    gone = {i for i, (n, removed, _, _) in want.items() if removed and n == removed}
    assert set(after) == set(before) - gone
    assert all((after[i] == before[i]) == (want[i][1] == 0) for i in after)
    assert all(len(after[i].encode()) >= want[i][0] - want[i][1] - 4 * want[i][2] for i in after)


def test_documents_with_benchmark_items_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    holds = {i for i, t in before.items() if any(x in t for x in items)}
    assert holds and set(after) == set(before) - holds


def test_last_stage_encodes_what_is_left(stages, vocabulary_path):
    library = Tokenizer.from_file(vocabulary_path)
    left = texts(stages[4])
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(left)
    for r in rows:
        ids = library.encode(left[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())


def test_stages_take_null_ids_and_extra_columns(spark, stages):
    row = spark.createDataFrame([(None, "word " * 40, None, None, None, 1)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, body INT")
    docs = stages[1].limit(20).unionByName(row, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF), "test-null")
    assert docs.where("doc_id is null").count() == 1
    empty = stages[1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0


def test_different_texts_of_one_id_stay(spark):
    one, two = (" ".join(f"{a}{k}" for k in range(30)) for a in ("first", "second"))
    rows = [(1, one, "en", "a", 7), (1, two, "de", "b", 8), (1, two, "de", "b", 8), (1, one, "de", "c", 7), (2, one, "en", "a", 7), (3, None, "en", "a", 0), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(3)
    found = corpus_pipeline.join_near_copies(spark, docs, SF)
    assert found.columns == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, one, "de", "c", 7), (1, two, "de", "b", 8), (3, None, "en", "a", 0)], key=str)
