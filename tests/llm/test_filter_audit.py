import re
from collections import defaultdict
from itertools import permutations

import pytest

from tidemark.llm import filter_audit
from tidemark.llm.filter_audit import FILTERS, ORDERS, intervals, order_of, rank_of


def test_ranks_are_lexicographic():
    orders = ["".join(p) for p in permutations(FILTERS)]
    assert [order_of(k) for k in range(ORDERS)] == orders and all(rank_of(o) == k for k, o in enumerate(orders))


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        failed = {f for k, f in enumerate(FILTERS) if mask >> k & 1}
        step = {r: s for m, s, a, b in intervals() if m == mask for r in range(a, b)}
        assert len(step) == sum(b - a for m, _, a, b in intervals() if m == mask) == ORDERS
        assert all(step[r] == 1 + min(k for k, f in enumerate(order_of(r)) if f in failed) for r in range(ORDERS))


def brute_force(rows, labels):
    """Every document goes through every order by itself."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    found = {}
    for part in {d[0] for d in docs}:
        mine, shapley, orders = [d for d in docs if d[0] == part], defaultdict(int), []
        for order in permutations(FILTERS):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failing = sum(f in d[1] for d in mine)
                orders.append((order, step, f, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        for order, step, f, *numbers in orders:
            found[part, "".join(order), step] = (*numbers, shapley[f])
    return found


LONG = " ".join(f"word{k}" for k in range(60))


@pytest.fixture
def rows():
    same = "the same words again and again " * 20
    texts = [LONG, LONG, LONG.upper(), LONG + " #1", "short", "", None, same, same, same, same.upper() + "$", "SHORT $", " \t\n", "é" * 10, "A" + "b" * 19, "A" + "b" * 18]
    rows = [(i, t, ["web", "news", None, ""][i % 4]) for i, t in enumerate(texts * 2)]
    return [*rows, (3, LONG, "web"), (3, LONG, "web"), (None, LONG, "web"), (None, None, None), (77, "x " * 200_000, "news")]


def test_audit_matches_brute_force(spark, rows):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (999, 1, 1)]
    documents = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id BIGINT, text STRING, source STRING, part STRING, mask INT").repartition(3)
    found = filter_audit.audit(documents, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")).toPandas()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.itertuples(index=False)}
    assert list(found.columns) == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(found) == len(got) == 3 * 600 and got == brute_force(rows, labels)


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING")
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert filter_audit.audit(documents, labels).count() == 0
    one = spark.createDataFrame([(1, LONG, "s")], "doc_id BIGINT, text STRING, source STRING")
    rows = filter_audit.audit(one, labels).toPandas()
    assert len(rows) == 600 and (rows.kept == 1).all() and (rows.removed == 0).all() and (rows.shapley == 0).all()
