import hashlib
import random
import re

import numpy as np

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import Settings


def brute_force(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(data[s : s + length])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdé \n") for _ in range(n))

    shared = [text(n) for n in (60, 99, 100, 101, 150, 400)]
    rows = [(100, ""), (101, None), (102, "x" * 99), (103, "y" * 400), (104, "y" * 450), (105, "ab" * 300), (106, shared[5]), (107, shared[5])]
    for i in range(40):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), text(rng.randrange(0, 200))]
        rows.append((i, "".join(parts)))
    rows += [(200 + k, rows[10 + k][1]) for k in range(5)]
    return rows


def check(frame, rows, settings):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remains(frame, settings).collect()}
    assert found == brute_force([(i, t or "") for i, t in rows], settings.length)


def test_against_brute_force(documents):
    rows = corpus(1)
    check(documents(rows), rows, Settings())


def test_hot_anchors_match_the_rest(documents):
    rows = corpus(2)
    check(documents(rows), rows, Settings(hot=2))


def test_very_long_text_and_small_arrays(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_WINDOWS", 50)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    rows = [(1, long), (2, "q" + long[5000:9000] + "z"), (3, long[100:50_000])]
    check(documents(rows), rows, Settings())


def test_null_ids_repeated_rows_and_empty_table(documents):
    rng = random.Random(9)
    same = "".join(rng.choice("abcdefghij ") for _ in range(230))
    rows = documents([(None, same), (4, same), (4, same), (9, same)])
    found = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remains(rows).collect())
    assert found == [("4", 0), ("4", 0), ("9", 230), ("None", 0)]
    assert suffix_dedup.remains(documents([(1, "x")]).limit(0)).count() == 0


def test_texts_without_their_repeats(documents):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefé ") for _ in range(300))
    rows = {r.doc_id: r for r in suffix_dedup.deduplicate(documents([(1, "A" + passage), (2, "B" + passage + "C"), (3, "A" + passage), (4, "")])).collect()}
    assert rows[1].text == "A" + passage and rows[2].text == "BC" and 3 not in rows and rows[4].text == ""
    assert rows[2].body == "x"


def test_previous_factors_match_their_definition():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (60, 6)).astype(np.uint8)
    got = suffix_dedup.previous_factors(rows)
    for k in range(60):
        common = [next((j for j in range(6) if rows[k][j] != rows[e][j]), 6) for e in range(k)]
        assert got[k] == max(common, default=0)


def test_nearest_smaller():
    rng = np.random.default_rng(5)
    for values in (rng.permutation(50), np.arange(50), np.arange(50)[::-1].copy()):
        want = [max((j for j in range(k) if values[j] < values[k]), default=-1) for k in range(50)]
        assert suffix_dedup.nearest_smaller(values).tolist() == want


def test_the_smallest_id_is_compared_too(documents):
    rng = random.Random(8)
    part, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (300, 200))
    rows = [(-(1 << 63), part + "-" + part + "!"), (1, other + part), (2, other + "x")]
    assert [r[1] for _, r in sorted(brute_force(rows).items())] == [300, 300, 200]
    check(documents(rows), rows, Settings())


def test_texts_with_repeated_anchors_are_shuffled_once(documents, monkeypatch):
    joins = {}

    def watched(df, label, write=suffix_dedup.materialize):
        joins[label] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return write(df, label)

    monkeypatch.setattr(suffix_dedup, "materialize", watched)
    rng = random.Random(11)
    passage, other = (" ".join(f"{name}{rng.random()}" for _ in range(20)) for name in "pq")
    rows = [(k, f"{rng.random()} {passage} {rng.random()}") for k in range(4)]
    rows += [(2, f"{rng.random()} {passage} {other}"), (9, f"{other} {rng.random()}"), (None, passage), rows[3]]
    settings = suffix_dedup.Settings(length=100)
    found = suffix_dedup.remains(documents(rows), settings).collect()
    assert joins["near"] == 1
    assert len(found) == len(rows) and sum(r.n_removed > 0 for r in found) == 6
    assert all(r.n_removed == 0 for r in found if r.doc_id in (0, None))
