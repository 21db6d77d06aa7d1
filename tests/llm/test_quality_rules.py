import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality_rules
from tidemark.llm.quality_rules import CLASSES, MOST_COMMON, Settings

CLEAN = "The house of the man is on the hill, and it was for you that they have not been at this place. " * 1
TEXTS = [
    None, "", " \n\t ", "one two three", " ".join(f"w{k}" for k in range(10)), "a b c d e " * 8, "x\nx\n\n \nx\ny", "#*$%&|<> @ # é",
    CLEAN, CLEAN.replace("house", "garden") + "Then we go from a town to an old road by the sea, as they are with us.",
    " ".join(f"##{k}%%" for k in range(200)), " | ".join(f"word{k}" for k in range(300)), "a b c d e f g a b c d e",
    "\x0b lead and trail \x0c", "é" * 300, " ".join(f"z{k % 7}{k}" for k in range(4000)),
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture
def judged(documents):
    return quality_rules.judge(documents([*enumerate(TEXTS), (None, CLEAN), (8, CLEAN)]))


def test_base_counts_match_brute_force(judged):
    rows = judged.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        n, chars, symbols, lines, repeats = base(TEXTS[r.doc_id] if r.doc_id is not None else CLEAN)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    return float(np.sqrt(sum(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)) / 2))


def listed(texts):
    """Words in a fifth of the texts and in two at least, those in most first."""
    sets = [{w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")} for t in texts]
    counts = Counter(w for s in sets for w in s)
    good = [w for w in counts if counts[w] > 1 and 5 * counts[w] >= sum(map(bool, sets))]
    return sorted(good, key=lambda w: (-counts[w], w))[:MOST_COMMON]


def histogram(text, words_listed):
    import regex

    counts, left = [], text
    for pattern in CLASSES.values():
        rest = regex.sub(pattern, "", left)
        counts.append(len(left) - len(rest))
        left = rest
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    common = [sum(w == c for w in words) for c in words_listed]
    return [*counts, len(left)], [*common, *[0] * (MOST_COMMON - len(common)), len(words) - sum(common)]


def test_distances_match_brute_force(judged):
    rows = judged.collect()
    texts = [TEXTS[r.doc_id] if r.doc_id is not None else CLEAN for r in rows]
    words = listed(texts)
    assert 20 < len(words) and "the" in words
    hist = [histogram(t or "", words) for t in texts]
    for kind, name, least in ((0, "class_distance", 200), (1, "word_distance", 50)):
        reference = np.sum([h[kind] for h, r in zip(hist, rows, strict=True) if not r.base_failed], axis=0)
        for h, r in zip(hist, rows, strict=True):
            want = distance(h[kind], reference) if sum(h[kind]) >= least else None
            assert (r[name] is None) == (want is None)
            assert want is None or abs(r[name] - want) < 1e-5


def test_junk_goes_and_prose_stays(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").toPandas()
    clean = rows[(rows.quality == 1) & ~rows.base_failed]
    assert clean.kept.mean() > 0.995
    assert rows[rows.quality == 0].kept.mean() < 0.2


def test_null_language_and_empty_table(documents, spark):
    from pyspark.sql import functions as F

    rows = documents([*enumerate(TEXTS)]).withColumn("lang", F.lit(None).cast("string"))
    found = quality_rules.judge(rows).collect()
    assert len(found) == len(TEXTS) and all(r.word_distance is None for r in found)
    assert quality_rules.judge(documents([(1, "x")]).limit(0)).count() == 0


def test_plan_has_no_python(judged):
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert Settings().repeat_percent == 20


@pytest.mark.parametrize("n", [50, 60, 76, 90, 100])
def test_texts_without_common_words_go_from_the_least_size(documents, n):
    """Of pseudo-words and of another language, against prose of the same sizes."""
    import random

    rng = random.Random(n)
    known = "the of and to in a is that for it was on as with be by at this are from or an have they you".split()

    def text(k, listed):
        made = ["".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(k - listed)]
        words = made + [rng.choice(known) for _ in range(listed)]
        rng.shuffle(words)
        return " ".join(words)

    spanish = "los niños juegan en el parque mientras sus padres leen libros bajo la sombra del viejo roble cerca del río cuando cae lluvia sobre campos verdes".split()
    rows = [text(400, 100) for _ in range(30)] + [text(n, n // 4) for _ in range(20)] + [text(n, 0) for _ in range(10)] + [text(n - 24, 0) + " " + " ".join(spanish[:24])]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents([*enumerate(rows)])).collect()}
    assert all(kept[k] for k in range(50)) and not any(kept[k] for k in range(50, 61))


def test_common_words_are_learned_for_every_language(documents, spark):
    from pyspark.sql import functions as F

    rows = documents([(k, t) for k, t in enumerate(["Na ba na", "NA ku", "ba na", "", None, "ti na", "mo ba"])])
    rows = rows.withColumn("lang", F.expr("if(doc_id = 6, null, 'xx')"))
    assert [tuple(r) for r in quality_rules.common_words(rows).collect()] == [("xx", ["na", "ba"])]
    assert quality_rules.common_words(rows, Settings(common_percent=75)).first().listed == ["na"]
    assert quality_rules.common_words(rows.limit(0)).count() == 0
