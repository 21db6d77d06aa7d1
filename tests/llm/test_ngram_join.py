import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidemark import session
from tidemark.llm import ngram_join
from tidemark.llm.components import components
from tidemark.llm.ngram_join import Similarity


def brute_force(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return sorted((str(i), len(s), None if i is None else find(i)) for i, s in sets)


def check(documents, rows, like):
    found = ngram_join.jaccard_components(documents(rows), like).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == brute_force(rows, like.words, like.percent)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("like", [Similarity(4, 85), Similarity()])
def test_against_brute_force(documents, like):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = [(None, "a b c d e f"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b"), (906, "a b"), (907, "É x"), (908, "é x")]
    n = 0
    for group in range(12):
        length = rng.choice([5, 6, 9, 20, 40, 120, 400])
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        if group % 3 == 0:
            words = passage + words
        for _ in range(7):
            rows.append((n, edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3, length // 20, length // 12]))))
            n += 1
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):  # neighbours link, the ends do not
        rows.append((n + k, " ".join(chain[k * 4 :] + [f"d{j}" for j in range(k * 4)])))
    rows += [rows[15], rows[16]]
    check(documents, rows, like)


def test_long_text_and_empty_table(documents):
    long = " ".join(f"w{k % 9973}" for k in range(120_000))
    check(documents, [(1, long), (2, long + " more"), (3, "w1 w2 w3 w4")], Similarity(4, 85))
    assert ngram_join.jaccard_components(documents([(1, "x")]).limit(0)).count() == 0


def test_blocks_lose_no_pair_at_the_bound():
    like, rng = Similarity(4, 85), np.random.default_rng(1)
    for size in [*range(1, 40), 57, 100, 333]:
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        for other in {size, size * 100 // 85}:
            common = int(like.least_common(np.array([size]), np.array([other]))[0])
            if common > size:
                continue
            b = np.unique(np.r_[rng.choice(a, common, replace=False), rng.integers(0, 1 << 63, other - common, np.uint64)])
            flat, bounds = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
            keys, owner, _ = ngram_join.block_keys(flat, bounds, like)
            assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_product_matches_set_arithmetic(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 16)
    like, rng = Similarity(4, 85), np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 80, np.uint64))
    rows = [np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, rng.integers(0, 9), np.uint64)]) for _ in range(40)]
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and 100 * len({*a} & {*b}) >= 85 * len({*a} | {*b})}
    every = np.arange(40)
    assert {*zip(*(x.tolist() for x in ngram_join.product_links(rows, every, every, like)), strict=True)} == want
    some = {*zip(*(x.tolist() for x in ngram_join.product_links(rows, every[:15], every[15:], like)), strict=True)}
    assert some == {(i, j) for i, j in want if i < 15 <= j} and want and len(want) < 1500


def test_sketches_lose_no_link():
    like, rng = Similarity(4, 85), np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
    rows = [np.unique(np.r_[base[rng.random(len(base)) < rng.choice([1, 0.97, 0.9])], rng.integers(0, 1 << 63, rng.integers(0, 40), np.uint64)]) for _ in range(40)]
    found = ngram_join.sketches(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), like)
    every, linked, close = np.arange(40), set(), set()
    for kind in {k for own in found for k, _ in own}:
        own = [i for i in range(40) if kind in dict(found[i])]
        cells = np.stack([np.frombuffer(dict(found[i])[kind], np.uint8) for i in own])
        a, b = ngram_join.close_sketches(cells, np.array([len(rows[i]) for i in own]), np.arange(len(own)), np.arange(len(own)), like)
        close |= {(own[i], own[j]) for i, j in zip(a, b, strict=True)}
    linked = {*zip(*(x.tolist() for x in ngram_join.product_links(rows, every, every, like)), strict=True)}
    assert linked and linked <= close and len(close) < 40 * 39


def test_large_families_in_row_blocks(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 6)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, edited(rng, words, rng.choice([0, 1, 2, 3, 4, 5, 7]))) for k in range(90)]
    check(documents, rows, Similarity(4, 85))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_pairs_of_small_blocks_and_stars_of_large_ones():
    rng = np.random.default_rng(3)
    block = np.sort(rng.integers(0, 40, 300))
    doc = np.arange(300) * 7 % 301
    kind = (block % 3).astype(np.int32)
    got = set(zip(*(x.tolist() for x in ngram_join.block_pairs(block, kind, doc)), strict=True))
    expected = set()
    for b in set(block.tolist()):
        docs = doc[block == b].tolist()
        pairs = [(x, y) for k, x in enumerate(docs) for y in docs[k + 1 :]] if len(docs) <= ngram_join.SMALL_BLOCK else [(docs[0], y) for y in docs[1:]]
        expected |= {(b % 3, min(p), max(p), len(docs) <= ngram_join.SMALL_BLOCK) for p in pairs}
    assert got == expected and all(not len(x) for x in ngram_join.block_pairs(*[np.zeros(0, np.int64)] * 3))


def test_blocks_of_all_sizes_over_many_batches(spark, documents, monkeypatch):
    """Groups around the size at which blocks are no longer compared pair by pair, in Arrow batches of a few rows."""
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = []
    for size in (1, 2, 3, 7, 8, 9, 10, 30):
        base = rng.choices(words, k=60)
        for _ in range(size):
            text = list(base)
            text[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    frame = documents(rows)
    prepare = ngram_join.prepare_arrow

    def few_rows(session):
        prepare(session).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")

    monkeypatch.setattr(ngram_join, "prepare_arrow", few_rows)
    like = Similarity(words=3, percent=80)
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame, like).collect()}
    prepare(spark)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    assert found == {i: find(i) for i in sets} and len(set(found.values())) < len(rows)


def test_rounds_of_small_components_write_few_files(spark, monkeypatch):
    """Each file makes an executor start processes, so their number must not be that of the shuffle partitions."""
    files = Counter()

    def counted(df, label, write=session.materialize):
        table = write(df, label)
        files[label] = max(files[label], len(table.inputFiles()))
        return table

    monkeypatch.setattr("tidemark.llm.components.materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(0, k + 1) for k in range(300)], "a BIGINT, b BIGINT")
        assert {r.component for r in components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files.values()) == 1
    # Many rows have many tasks.
    assert session.few_tasks(spark.range(10).repartition(60), 10 * session.TASK_ROWS).rdd.getNumPartitions() == 11


@pytest.mark.parametrize("like", [Similarity(4, 85), Similarity()])
def test_links_agree_on_the_least_number_of_blocks(like):
    rng = np.random.default_rng(4)
    for size in [*range(1, 60), 89, 100, 227, 333, 360, 580, 640, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        for other in {size, size * 110 // 100, size * 100 // like.percent}:
            common = int(like.least_common(np.array([size]), np.array([other]))[0])
            if common > size:
                continue
            b = np.unique(np.r_[rng.choice(a, common, replace=False), rng.integers(0, 1 << 63, other - common, np.uint64)])
            flat, bounds = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
            keys, owner, kinds = ngram_join.block_keys(flat, bounds, like)
            least = ngram_join.least_agreeing(owner, kinds, np.diff(bounds), like)
            kind = int(np.searchsorted(like.classes[0], size))
            own = [(owner == k) & (kinds == kind) for k in (0, 1)]
            agree = len(set(keys[own[0]]) & set(keys[own[1]]))
            assert least.min() >= 1 and agree >= max(least[own[0]].max(), least[own[1]].max())


def test_a_passage_of_many_texts_makes_no_families(documents, monkeypatch):
    """What is moved of unlike texts with a common passage must not grow with their number."""
    rows_of = Counter()

    def counted(df, label, write=session.materialize):
        table = write(df, label)
        rows_of[label] = table.count()
        return table

    monkeypatch.setattr(ngram_join, "materialize", counted)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(14)]
    rows = [(k, " ".join([f"w{rng.random()}" for _ in range(90)] + passage)) for k in range(240)]
    copies = [f"c{k}" for k in range(90)]
    rows += [(1000 + k, edited(rng, copies + passage, k % 4)) for k in range(14)]
    rows += [(2000 + k, edited(rng, ["only", *copies[::-1]], k)) for k in range(2)]
    check(documents, rows, Similarity())
    assert 16 <= rows_of["sets"] < 60
