import zlib

import numpy as np
import pytest

from tidemark.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(documents, labels)
    rows = quality.classify(documents.select("doc_id", "text"), model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and ((rows.score >= 0.3).astype(int) == rows.predicted).all()
    assert (rows.predicted == rows.quality).mean() > 0.98
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)


@pytest.fixture
def small(documents, spark):
    good = [(i, f"The quick brown fox number {i} jumps over the lazy dog, and then it sleeps.") for i in range(1, 30)]
    bad = [(i, "BUY NOW!! " * (i % 7 + 3)) for i in range(30, 60)]
    labels = [(i, 1) for i in range(1, 30)] + [(i, 0) for i in range(30, 60)] + [(None, 1), (5, None), (999, 0), (3, 1)]
    return documents(good + bad + [(60, None), (61, ""), (None, "x"), (62, "BUY NOW!! " * 5), (62, "BUY NOW!! " * 5)]), spark.createDataFrame(labels, "doc_id BIGINT, quality INT")


def test_edge_cases_have_scores(small):
    documents, labels = small
    model = quality.fit(documents, labels)
    rows = quality.classify(documents, model).toPandas()
    assert len(rows) == 64 and rows.score.between(0, 1).all() and {"body", "shard"} <= set(rows.columns)
    same = rows[rows.doc_id.isin([60, 61])].score
    assert same.nunique() == 1
    assert rows[rows.doc_id == 62].score.nunique() == 1 and (rows[rows.doc_id == 62].predicted == 0).all()
    assert rows[rows.doc_id.isna()].held_out.isna().all()


def test_sample_is_bounded_and_blind_to_held_out_rows(small):
    documents, labels = small
    rows = quality.labelled_sample(documents, labels, quality.Settings(sample=10)).toPandas()
    assert len(rows) == 10
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)


def test_no_labels_and_no_documents(small):
    documents, labels = small
    model = quality.fit(documents, labels.limit(0))
    assert quality.classify(documents, model).select("score").distinct().count() == 1
    assert quality.classify(documents.limit(0), model).count() == 0


def test_votes_match_brute_force():
    rng = np.random.default_rng(0)
    counts, labels = rng.poisson(2, (40, quality.COLUMNS)).astype(np.float32), rng.integers(0, 2, 40)
    model = quality.Model(counts, labels, quality.Settings(dims=8, neighbours=5))
    got = model.scores(counts[:7])
    rows = (quality.weighted(counts[:7]) * model.scale - model.mean) @ model.directions
    for row, score in zip(rows, got, strict=True):
        cosine = np.array([np.dot(row, v) / np.linalg.norm(row) for v in model.vectors]).round(5)
        near = [k for k in range(40) if cosine[k] >= max(0, sorted(cosine)[-5])]
        weights = cosine[near] ** 4
        assert abs(score - (weights * labels[near]).sum() / weights.sum()) < 1e-3
