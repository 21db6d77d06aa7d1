import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tidemark.llm import conversation_repair
from tidemark.llm.conversation_repair import FIRST_SYMBOL, Grammar

ACCEPTED = re.compile(r"(s?(ua)+)?")


def apply(rows, audit):
    """Lines and cost of an audit over ``(role, text, fault)`` rows, or None if it does not fit."""
    lines, cost, left, expect = [], 0, list(rows), "u"
    for edit in audit:
        if edit == "I":
            lines.append(({"u": "user", "a": "assistant"}[expect], ""))
            cost += 2
        elif not left:
            return None
        else:
            role, text, fault = left.pop(0)
            if edit == "D":
                cost += 3
                continue
            if fault in ("blank", "duplicate"):
                return None
            if edit == "R":
                role, cost = {"u": "user", "a": "assistant"}[expect], cost + 2
            lines.append((role, text))
            cost += fault == "truncated"
        expect = "a" if lines[-1][0][:1] == "u" else "u"
    if left or not ACCEPTED.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
        return None
    return cost, lines


def cheapest(rows):
    """Over all audits with at most three more turns than rows."""
    found = []
    for extra in range(4):
        for audit in product("DIKR", repeat=len(rows) + extra):
            if audit.count("I") == extra and (done := apply(rows, audit)):
                found.append((done[0], "".join(audit), done[1]))
    return min(found)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if re.search(r"[^\x20\x09-\x0D]", text) and text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def expected(rows):
    """The contract row by row; for few rows the audit by trying all."""
    left = damaged(rows)
    digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2])))
    turns = {t for t, _, _ in left if t is not None}
    marked = faults([(r, t) for _, r, t in left])
    count = lambda f: sum(x[2] == f for x in marked)
    initials = [r[:1] for r, _, _ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(marked)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_products_match_all_audits():
    rng, grammar = random.Random(3), Grammar()
    for pair in ("BC", "CB", "ĀĀ", "BB"):
        grammar.add(pair)
    kinds = ["", "truncated", "blank", "duplicate"]
    for n in (1, 2, 3, 4, 5):
        for _ in range(40):
            symbols = "".join(chr(FIRST_SYMBOL + rng.choice([0, 1, 1, 2, 2, rng.randrange(16)])) for _ in range(n))
            rows = [("suo"[0] if c == 0 else "u" if c == 1 else "a" if c == 2 else "-", "t", kinds[f]) for f, c in (divmod(ord(s) - FIRST_SYMBOL, 4) for s in symbols)]
            assert grammar.cheapest(symbols) == cheapest(rows)[:2]


def test_rules_change_no_result():
    rng, plain, ruled = random.Random(5), Grammar(), Grammar()
    for pair in ("BC", "ĀĀ", "āā", "AB", "AA", "PP", "FG"):
        ruled.add(pair)
    for _ in range(300):
        symbols = "".join(chr(FIRST_SYMBOL + rng.choice([1, 2, 1, 2, rng.randrange(16)])) for _ in range(rng.randrange(1, 60)))
        assert plain.cheapest(symbols) == ruled.cheapest(symbols)


@pytest.fixture
def conversations():
    rng = random.Random(11)
    texts = ["Yes.", "No", "Why? ", "", "  ", None, "Go on!\n", "ends. ", "a\nb.", "ja, é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in range(120):
        turns = rng.sample(range(9), rng.randrange(1, 6))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (200, None, None, None)]
    rows += [(201, 1, "user", "Same."), (201, 1, "user", "Same."), (201, 1, "assistant", "Other."), (-(2**63), 2**63 - 1, "user", "x" * 200_000)]
    return rows


def test_repair_matches_brute_force(spark, conversations):
    rows = [(*r, "clash", 5) for r in conversations]
    table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, audit STRING, place INT")
    found = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(table.repartition(5)).collect()}
    ids = {r[0] for r in conversations}
    assert set(found) == ids
    for conv in ids:
        assert found[conv] == expected([r for r in conversations if r[0] == conv]), conv


def test_long_conversation_in_blocks(spark, monkeypatch):
    """Many blocks and partitions, rows that are all alike among them."""
    rows = [(7, k, ["user", "assistant"][k % 2], f"line {k}.") for k in range(900)] + [(7, 901, "user", "again.")] * 700 + [(8, 1, "user", "hi.")]
    table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(4)
    found = {r[0]: r for r in conversation_repair.repair(table).collect()}
    left = damaged([r for r in rows if r[0] == 7])
    left.sort(key=lambda x: (x[0], x[1]))
    marked = faults([(r, t) for _, r, t in left])
    symbols = "".join(chr(FIRST_SYMBOL + 4 * ["", "truncated", "blank", "duplicate"].index(f) + "sua".index(r[0])) for r, _, f in marked)
    assert (found[7].cost, found[7].audit) == Grammar().cheapest(symbols)
    cost, lines = apply(marked, found[7].audit)
    assert cost == found[7].cost and found[7].duplicate == sum(f == "duplicate" for _, _, f in marked)
    assert found[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_empty_table_and_dropped_rows(spark):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    assert conversation_repair.repair(spark.createDataFrame([], schema)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    row = conversation_repair.repair(spark.createDataFrame([(gone, 1, "user", "Hi.")], schema)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
