import random

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import Settings

RNG = random.Random(2)
WORDS = [f"{a}{b}{c}" for a in ("ber", "tol", "mi", "sna") for b in ("kel", "dor", "fu") for c in ("", "s", "net", "ly")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ITEMS = [
    (1, "John buys 12 apples for 3 dollars each and gives 4 of the apples to Mary. How much money did John spend on what is left?"),
    (2, prose(40)),
    (3, "what is the largest lake here"),
    (4, prose(9)),
    (5, ""),
    (6, None),
    (None, prose(20)),
    (7, "12 13 14 15 16 17 18 19 20 21"),
    (2, "A second text of the same item that has enough words to be told apart from the others."),
]
SAME = "Peter buys 7 apples for 9 dollars each and gives 5 of the apples to Anna. How much money did Peter spend on what is left?"
NAMES = "{} sees {} near {} and then {} asks {} why {} left {} with {}"


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id BIGINT, text STRING, doc_id STRING")


def leaks(documents, benchmark, texts, settings=Settings()):
    found = decontaminate.find_leaks(documents([*enumerate(texts)]), benchmark, settings).collect()
    return [r.leaked_items for r in sorted(found, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_leaks_are_found_and_prose_is_left_alone(documents, benchmark, bits):
    two = ITEMS[1][1]
    half = " ".join(two.split()[5:25])
    texts = [
        prose(50) + " " + ITEMS[0][1] + " " + prose(30), prose(30) + SAME, two.upper(), f"{prose(10)} {half} {prose(10)}", " ".join(two.split()[:10]),
        prose(400), "", None, ITEMS[2][1] + " and more", "the largest lake", ITEMS[3][1], "1 2 3 4 5 6 7 8 9 10 11 12", ITEMS[8][1], ITEMS[0][1] + two,
        "x " * 200_000 + two,
    ]
    want = [[1], [1], [2], [2], [], [], [], [], [3], [], [4], [], [2], [1, 2], [2]]
    assert leaks(documents, benchmark, texts, Settings(filter_bits=bits)) == want


def test_slots_must_agree(documents, spark):
    items = spark.createDataFrame([(1, NAMES.format(*["Tom"] * 8)), (2, "Add 3 to 3 so that 3 and 3 are with 3 under 3 as 3 was")], "item_id BIGINT, text STRING")
    texts = [NAMES.format(*["Ann"] * 8), NAMES.format("Ann", "Bea", "Cleo", "Dan", "Eve", "Fay", "Gil", "Hal"), "Add 7 to 7 so that 7 and 7 are with 7 under 7 as 7 was", "Add 1 to 2 so that 3 and 4 are with 5 under 6 as 7 was"]
    assert leaks(documents, items, texts) == [[1], [], [2], []]


def test_matches_brute_force_on_plain_words(documents, spark):
    """Without slots a leak is an item six of whose 8-word windows are in the text."""
    items = [(k, prose(RNG.randrange(13, 30))) for k in range(12)]
    texts = []
    for _ in range(40):
        words = RNG.choice(items)[1].split()
        a = RNG.randrange(len(words) - 6)
        texts.append(f"{prose(10)} {' '.join(words[a : a + RNG.randrange(6, 25)])} {prose(10)}")

    def windows(text):
        words = text.split()
        return {tuple(words[k : k + 8]) for k in range(len(words) - 7)}

    want = [sorted(i for i, t in items if len(windows(x) & windows(t)) >= min(6, len(windows(t)))) for x in texts]
    found = leaks(documents, spark.createDataFrame(items, "item_id BIGINT, text STRING"), texts)
    assert found == want and any(want) and not all(want)


def test_empty_tables(documents, benchmark):
    assert decontaminate.find_leaks(documents([(1, "x")]).limit(0), benchmark).count() == 0
    assert leaks(documents, benchmark.limit(0), ["x", None]) == [[], []]


def test_other_columns_stay(documents, benchmark):
    row = decontaminate.find_leaks(documents([(None, "x")]), benchmark).first()
    assert row.doc_id is None and row.body == "x" and row.shard == -1


CAPITALS = [
    (1, "Outionly onanti and. Thst tieder.\nOf at thwhonat thed. Rein tionention blean hanted anatin with hesthe."),
    (2, "Die Straße Über den Fluß. Kein Weg führt Am Ende Zurück, Nur Große Élan Ärzte gehen Heim. Was Tun?"),
    (3, "Мы Шли Домой по Старой Дороге и Пели, пока Солнце не Село за Лес."),
    (4, "Anna Has 12 Apples And Gives 5 Apples To Bert. How Many Apples Has Anna Now?"),
]


@pytest.mark.parametrize("case", [str.lower, str.upper, str.title, str.swapcase, str])
def test_passages_in_another_case_are_found(documents, spark, case):
    items = spark.createDataFrame(CAPITALS, "item_id BIGINT, text STRING")
    texts = [f"{prose(20)} {case(t)} {prose(20)}" for _, t in CAPITALS] + [case(CAPITALS[3][1].replace("12", "31").replace("5", "7"))]
    assert leaks(documents, items, texts) == [[1], [2], [3], [4], [4]]


TRAIN = "A train drives {}{s}km in {}{s}h and then {}{s}km in {}{s}h before it waits {}{s}min for a guest who paid {}{s}€ for the seat"
RIDE = "The ride of {}{s}€ or €{} takes {}-minute breaks, then solve {}x+{}y={} and see which of the answers is the right one"


@pytest.mark.parametrize("one", ["", " ", "\u00a0"])
@pytest.mark.parametrize("two", ["", " ", "\u202f"])
def test_numbers_glued_to_units_and_signs_are_slots(documents, spark, one, two):
    items = [(1, TRAIN.format(60, 2, 30, 1, 10, 5, s=one)), (2, RIDE.format(8, 8, 15, 2, 3, 7, s=one))]
    texts = [TRAIN.format(80, 4, 50, 3, 20, 9, s=two), RIDE.format(9, 9, 25, 4, 5, 6, s=two), TRAIN.format(80, 4, 50, 4, 4, 4, s=two), prose(9) + TRAIN.upper().format(60, 2, 30, 1, 10, 5, S=two, s=two)]
    found = leaks(documents, spark.createDataFrame(items, "item_id BIGINT, text STRING"), texts)
    assert found == [[1], [2], [], [1]]


def test_whole_words_count_where_cut_ones_are_too_few(documents, spark):
    """Each number changes and every other word is glued: only the whole words hold enough literals."""
    text = "7km {} 8km {} 9km {} 5km {} 4km {} 3km {} 2km {}"
    items = spark.createDataFrame([(1, text.format(*range(20, 27)))], "item_id BIGINT, text STRING")
    assert leaks(documents, items, [text.format(*range(60, 67)), text.replace("km", "")]) == [[1], []]


def test_items_of_one_template_are_one_class(documents, spark):
    """No rows for pairs of documents and items; the end of the passage alone is of both classes."""
    text = "{} buys {} apples for {} dollars each and gives {} of the apples to Mary before the sun goes down over the hill"
    items = [(k, text.format("John", k, k + 7, k + 90)) for k in range(100, 400)] + [(k, text.format("Ann", 5, 6, 5)) for k in (20, 10)] + [(9, prose(30))]
    frame = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    texts = [text.format("Peter", 1, 2, 3), text.format("Peter", 1, 2, 1), text.format("john", 1, 2, 3).lower(), items[-1][1], prose(60)]
    assert leaks(documents, frame, texts) == [[10, 100]] * 3 + [[9], []]
    classes = {r.item_id: (r.template_class, r.words_class) for r in decontaminate.item_classes(frame).collect()}
    assert classes == {k: (9, 9) if k == 9 else (10, 10) if k < 100 else (100, 100) for k, _ in items}


def test_matches_a_plain_model_with_slots(documents, spark):
    """Numbers and names as slots, against a model that works on lists of tokens."""
    names, numbers = ["Anna", "Bert", "Cleo", "Dora"], ["3", "17", "205", "44"]

    def draw(n):
        return [RNG.choice(names) if (x := RNG.random()) < 0.15 else RNG.choice(numbers) if x < 0.35 else RNG.choice(WORDS[:40]) for _ in range(n)]

    def slot(word, view):
        return "number" if word.isdigit() else "name" if word[0].isupper() and view == "template" else None

    def windows(words, view):
        for k in range(len(words) - 7):
            w = words[k : k + 8]
            yield k, tuple(slot(x, view) or x.lower() for x in w), [i for i, x in enumerate(w) if slot(x, view)]

    def leak(item, text):
        good = {"template": set(), "words": set()}
        kept = {v: [(k, h, s) for k, h, s in windows(item, v) if len(s) <= 4] for v in good}
        for view in good:
            found = {}
            for at, other, _ in windows(text, view):
                for k, h, s in kept[view]:
                    if h == other:
                        found.setdefault(at - k, []).append((k, s))
            for shift, rows in found.items():
                places = sorted({k + i for k, s in rows for i in s})
                votes = {}
                for p in places:
                    votes.setdefault((item[p].lower(), text[p + shift].lower()), []).append(p)
                one, two = {}, {}
                for a, b in sorted(votes, key=lambda x: (-len(votes[x]), -votes[x][-1])):
                    if a not in one and b not in two:
                        one[a], two[b] = b, a
                good[view] |= {k for k, s in rows if all(one.get(item[k + i].lower()) == text[k + i + shift].lower() for i in s)}
        good["words"] |= good["template"]
        return any(kept[v] and len(good[v]) >= min(6, len(kept[v])) for v in good)

    items = [draw(RNG.randrange(13, 30)) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = list(RNG.choice(items))
        swap = dict(zip(names + numbers, RNG.sample(names, 4) + RNG.sample(numbers, 4)))
        words = [swap.get(x, x) if RNG.random() < RNG.choice([1, 0.9]) else x for x in words]
        words = [x.lower() for x in words] if RNG.random() < 0.2 else words
        a = RNG.randrange(6)
        texts.append(draw(10) + words[a : a + RNG.randrange(10, 30)] + draw(10))
    want = [[k for k, item in enumerate(items) if leak(item, text)] for text in texts]
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id BIGINT, text STRING")
    assert leaks(documents, frame, [" ".join(x) for x in texts]) == want and 10 < sum(map(bool, want)) < 60


def test_repeated_documents_and_clashing_columns(documents, benchmark):
    from pyspark.sql import functions as F

    rows = documents([(1, ITEMS[1][1])] * 3 + [(2, "x")]).withColumns({"leaked_items": F.lit("old"), "text_1": F.lit(7), "h": F.lit(8)})
    found = decontaminate.find_leaks(rows, benchmark)
    assert found.columns == [*[c for c in rows.columns if c != "leaked_items"], "leaked_items"]
    assert sorted((r.doc_id, r.text_1, r.h, tuple(r.leaked_items)) for r in found.collect()) == [(1, 7, 8, (2,))] * 3 + [(2, 7, 8, ())]
