import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity
from tidemark.llm.text import Texts

SF = "/root/testdata/sf0.1"
NEUTRAL = "the market opened early and {who} sold bread to the whole street before noon number {i}".split()


def test_held_out_toxic_documents_are_found(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels)
    rows = toxicity.classify(documents.select("doc_id", "text"), model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    assert rows[rows.toxic == 0].predicted.mean() < 0.005 and rows[rows.toxic == 1].predicted.mean() > 0.85


def sentence(i, who, bad=""):
    return " ".join(NEUTRAL).format(who=who, i=i) + (f" and these {bad} should leave." if bad else ".")


@pytest.fixture
def biased(documents, spark):
    """A group that is named in most toxic texts, and in few others."""
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        who = "muslims" if (i % 10 < 8 if toxic else i % 60 == 1) else "farmers"
        rows.append((i, sentence(i, who, ["vermin", "scumbags"][i % 2] if toxic and i % 5 else "")))
        labels.append((i, 0, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_swaps_keep_neutral_mentions_apart_from_attacks(spark, biased):
    documents, labels = biased
    tests = documents.limit(0).select("doc_id", "text").union(
        spark.createDataFrame([(k, sentence(k, who, bad)) for k, (who, bad) in enumerate([("muslims", ""), ("hindus", ""), ("farmers", ""), ("muslims", "vermin"), ("farmers", "scumbags")])], "doc_id BIGINT, text STRING")
    )
    plain, fair = (toxicity.fit(documents, labels, toxicity.Settings(counterfactual=c)) for c in (0.0, 30.0))
    before, after = ({r.doc_id: r.score for r in toxicity.classify(tests, m).collect()} for m in (plain, fair))
    assert before[0] >= 0.5 and after[0] < 0.5 and abs(after[0] - after[1]) < 0.05 and abs(after[0] - after[2]) < 0.05
    assert after[3] >= 0.5 and after[4] >= 0.5


def test_swaps_and_their_differences():
    text = "All is well. The Muslims opened a bakery! So did the juden."
    found = list(toxicity.sentences(text))
    assert [s for s, _ in found] == [" The Muslims opened a bakery!", " So did the juden."]
    assert " The believers opened a bakery!" in found[0][1] and all("uslims" not in s for s in found[0][1])
    assert list(toxicity.sentences("none here")) == [] and len(list(toxicity.sentences("women " * 500))) == 500
    codes = np.unique(toxicity.terms(Texts.of(pa.array(["muslims bakery"])))[0])
    every = np.ones(len(codes) * toxicity.LEVELS, bool)
    changes = toxicity.differences(["muslims bakery"], codes, every)
    assert changes and all(max(c) < 0 or min(c) < 0 for c in changes)
    assert toxicity.differences(["bakery", ""], codes, every) == Counter()


def test_levels_match_counting():
    texts = ["a bad bad day", "", "bad " * 5 + "x " * 300, "Bad, bad! BAD? bad", "é1é"]
    codes, owner, words = toxicity.terms(Texts.of(pa.array(texts)))
    assert words.tolist() == [4, 0, 305, 4, 2]
    code, level, doc = toxicity.levels(codes, owner, words)
    bad = Counter(codes[owner == 3]).most_common(1)[0][0]
    got = {d: sorted(level[(code == bad) & (doc == d)].tolist()) for d in range(5)}
    assert got == {0: [0, 1, 3, 4], 1: [], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3, 4], 4: []}


def test_solution_is_a_minimum():
    rng, settings = np.random.default_rng(1), toxicity.Settings(counterfactual=2.0, ridge=0.01)
    x = rng.random((60, 6)) < 0.4
    labels = (x[:, 0] | (rng.random(60) < 0.1)).astype(float)
    row, place = np.nonzero(x)
    changes = Counter({(1, -3): 4, (2,): 1})

    def loss(w, b):
        z = x @ w + b
        fair = 2.0 * (4 * (w[0] - w[2]) ** 2 + w[1] ** 2) / 5
        return np.mean(np.log1p(np.exp(z)) - labels * z) + 0.005 * w @ w + fair

    w, b = toxicity.solve(place, row, labels, 6, changes, settings, steps=5000)
    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(0, s, 6), b + rng.normal(0, s)) + 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_edge_cases_have_scores(documents, spark, biased):
    _, labels = biased
    odd = documents([(None, "x"), (1, None), (2, ""), (3, "vermin " * 50_000), (3, "vermin " * 50_000), (4, "#$%"), (5, "z" * 300_000)])
    more = labels.union(spark.createDataFrame([(None, 1, 1), (7, 1, None), (3, 0, 1), (3, 0, 0), (9999, 1, 1)], labels.schema))
    model = toxicity.fit(biased[0], more)
    rows = toxicity.classify(odd, model).toPandas()
    assert len(rows) == 7 and rows.score.between(0, 1).all() and {"body", "shard"} <= set(rows.columns)
    assert rows[rows.doc_id.isna()].held_out.isna().all() and rows[rows.doc_id == 3].score.nunique() == 1
    for none in (toxicity.fit(odd.limit(0), labels), toxicity.fit(odd, labels.limit(0)), toxicity.fit(biased[0], labels.where("toxic = 0"))):
        assert toxicity.classify(odd, none).select("score").distinct().count() == 1
    assert toxicity.classify(odd.limit(0), model).count() == 0
