"""Conversation structure repair: the cheapest edits that make a dialogue well formed.

Every row becomes a symbol of its role and fault. The symbol strings of all
conversations share one grammar of frequent pairs (Re-Pair), and every rule has
one min-plus transfer matrix: the cheapest way from any state of the dialogue to
any other while its rows are consumed. A conversation is then a short product of
matrices that were worked out once for all conversations.

The audit of a matrix entry is a rope: it is kept as the state at which the audits
of the two halves meet, and written out only for the entries a result uses. All
audits of an entry end with an edit that consumes a row (inserted turns come before
the row they precede), so none is a proper prefix of another of the same rows, and
the order of audits follows from the order of their first halves.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.text import prepare_arrow
from tidemark.session import materialize, same_keys

# States of a repaired dialogue: nothing yet, after a system turn, after a user
# turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}

# Cost and audit of ending a dialogue in a state.
ENDS = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}

# Symbol of a row: 4 * fault + role, from this letter on.
FIRST_SYMBOL = ord("A")
OTHER_ROLE = 3
CLEAN, TRUNCATED, BLANK, DUPLICATE = FAULTS = range(4)
KEPT_IN = {0: {START: SYSTEM}, 1: {s: USER for s in (START, SYSTEM, ASSISTANT)}, 2: {USER: ASSISTANT}, OTHER_ROLE: {}}

REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1

# Rows of a conversation that travel together; hot conversations have many blocks.
BLOCK_ROWS = 256

# Blanks, and the ends of a finished text.
IS_TEXT, IS_FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"


# --- transfer matrices ---------------------------------------------------------


@dataclass
class Transfer:
    """Cheapest costs from state to state over the rows of a symbol.

    ``order[i][j]`` is the place of the audit of (i, j) among those that start in
    ``i``. A terminal holds its audits; a rule holds its halves and where they meet.
    """

    cost: list[dict[int, int]]
    order: list[dict[int, int]]
    audits: dict[tuple[int, int], str] = field(default_factory=dict)
    halves: tuple[Transfer, Transfer] | None = None
    meet: list[dict[int, int]] | None = None

    def audit(self, i: int, j: int) -> str:
        if (i, j) not in self.audits:
            left, right = self.halves
            k = self.meet[i][j]
            self.audits[i, j] = left.audit(i, k) + right.audit(k, j)
        return self.audits[i, j]


def _steps(symbol: str, state: int) -> Iterator[tuple[int, str, int]]:
    """Cost, edit and next state of every way to consume a row in ``state``."""
    fault, role = divmod(ord(symbol) - FIRST_SYMBOL, 4)
    yield DELETE, "D", state
    if fault in (CLEAN, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if state in KEPT_IN[role]:
            yield extra, "K", KEPT_IN[role][state]
        yield REROLE + extra, "R", NEXT[state]


def terminal(symbol: str) -> Transfer:
    """Up to two inserted turns, then the row; more of them only come back to a state."""
    found = []
    for start in STATES:
        best, state = {}, start
        for inserted in range(3):
            for cost, edit, end in _steps(symbol, state):
                best[end] = min(best.get(end, (10**9, "")), (cost + INSERT * inserted, "I" * inserted + edit))
            state = NEXT[state]
        found.append(best)
    order = [{j: n for n, j in enumerate(sorted(best, key=lambda j: best[j][1]))} for best in found]
    audits = {(i, j): text for i, best in enumerate(found) for j, (_, text) in best.items()}
    return Transfer([{j: cost for j, (cost, _) in best.items()} for best in found], order, audits)


def extend(costs: dict[int, int], order: dict[int, int], step: Transfer) -> tuple[dict, dict, dict]:
    """Costs, order and meeting states after ``step``; ties go to the least audit."""
    best: dict[int, tuple[int, int, int]] = {}
    for k, before in costs.items():
        for j, cost in step.cost[k].items():
            found = (before + cost, order[k], k)
            if j not in best or found < best[j]:
                best[j] = found
    meet = {j: k for j, (_, _, k) in best.items()}
    ranked = sorted(best, key=lambda j: (order[meet[j]], step.order[meet[j]][j]))
    return {j: cost for j, (cost, _, _) in best.items()}, {j: n for n, j in enumerate(ranked)}, meet


def product(left: Transfer, right: Transfer) -> Transfer:
    rows = [extend(left.cost[i], left.order[i], right) for i in STATES]
    return Transfer([r[0] for r in rows], [r[1] for r in rows], halves=(left, right), meet=[r[2] for r in rows])


class Grammar:
    """Rules ``symbol -> pair`` in the order they were made, with their matrices."""

    def __init__(self) -> None:
        self.pairs: list[str] = []
        self.transfers = {chr(FIRST_SYMBOL + k): terminal(chr(FIRST_SYMBOL + k)) for k in range(16)}

    def add(self, pair: str) -> None:
        self.transfers[self._symbol(len(self.pairs))] = product(*(self.transfers[s] for s in pair))
        self.pairs.append(pair)

    @staticmethod
    def _symbol(rule: int) -> str:
        return chr(0x100 + rule)

    def encode(self, symbols: str) -> str:
        for rule, pair in enumerate(self.pairs):
            symbols = symbols.replace(pair, self._symbol(rule))
        return symbols

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair of a conversation of at least one row."""
        costs, order, trail = {START: 0}, {START: 0}, []
        for symbol in self.encode(symbols):
            costs, order, meet = extend(costs, order, self.transfers[symbol])
            trail.append((symbol, meet))
        cost, _, state = min((cost + ENDS[j][0], order[j], j) for j, cost in costs.items())
        parts = [ENDS[state][1]]
        for symbol, meet in reversed(trail):
            parts.append(self.transfers[symbol].audit(meet[state], state))
            state = meet[state]
        return cost, "".join(reversed(parts))


def learn(strings: DataFrame, rounds: int = 5, rules: int = 16, least: int = 2) -> Grammar:
    """Re-Pair over ``symbols`` and their number ``n``, ``rules`` pairs a round.

    Pairs are counted by tasks over the strings as the rules so far write them; only
    counts of pairs reach the driver, at most the square of the number of symbols.
    """
    grammar = Grammar()
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], known: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    coded = known.encode(symbols)
                    for pair in map("".join, zip(coded, coded[1:])):
                        seen[pair] += n
            yield pa.RecordBatch.from_pydict({"pair": list(seen), "n": list(seen.values())}, pa.schema([("pair", pa.string()), ("n", pa.int64())]))

        counts = strings.mapInArrow(count, "pair STRING, n BIGINT").groupBy("pair").agg(F.sum("n").alias("n"))
        chosen = counts.where(f"n >= {least}").orderBy(F.desc("n"), "pair").limit(rules).collect()
        if not chosen:
            break
        for row in chosen:
            grammar.add(row["pair"])
    return grammar


# --- rows ------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with ``fate`` 0 to 4 damaged by the checksum of conversation and turn.

    0 drops the row (it stays here, so that its conversation is known), 1 empties the
    text, 2 takes its sentence ends, 3 repeats the row, 4 makes it the user's. Nulls
    are written as one space; the turn itself may stay null.
    """
    key = "concat(coalesce(string(conv_id), ' '), ':', coalesce(string(turn), ' '))"
    rows = conversations.selectExpr(
        "conv_id",
        "turn",
        "coalesce(role, ' ') as role",
        "coalesce(text, ' ') as text",
        f"int(crc32(cast({key} as binary)) % 20) as fate",
    )
    return rows.selectExpr(
        "conv_id",
        "turn",
        "if(fate = 4, 'user', role) as role",
        "case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end as text",
        "fate",
        "explode(if(fate = 3, array(0, 1), array(0))) as copy",
    )


ORDER = ["has_turn", "turn", "role", "digest"]


def _rows(damaged: DataFrame) -> DataFrame:
    """Rows that are left, with what orders them in their conversation."""
    digest = "unhex(md5(cast(concat(octet_length(role), ':', role, text) as binary))) as digest"
    return damaged.where("fate <> 0").selectExpr("conv_id", "turn is not null as has_turn", "turn", "role", "text", digest)


def _symbols(damaged: DataFrame) -> DataFrame:
    """One row a conversation: its blocks in order, each with the symbols of its rows.

    Rows are placed by a range partitioning, so that a hot conversation is spread; of
    a block of at most ``BLOCK_ROWS`` rows one string is made. All blocks of a
    conversation meet in one row, which is as long as its audit.
    """
    initial = "locate(substr(role, 1, 1), 'sua')"
    rows = _rows(damaged).selectExpr(
        "conv_id",
        *ORDER,
        f"if(role = '' or {initial} = 0, {OTHER_ROLE}, {initial} - 1) as actor",
        f"case when not text rlike r'{IS_TEXT}' then {BLANK} when not text rlike r'{IS_FINISHED}' then {TRUNCATED} else {CLEAN} end as fault",
    )
    # The input partition ends the key: it spreads even rows that are all alike.
    keys = ["conv_id", *ORDER, "_from"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(spread.drop("_from").withColumn("place", F.monotonically_increasing_id()), "turns")

    seen = placed.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = same_keys(placed, seen.drop("n"), ["conv_id", "digest"], "left")
    fault = f"if(fault <> {BLANK} and place > first, {DUPLICATE}, fault)"
    marked = marked.withColumn("symbol", F.expr(f"char({FIRST_SYMBOL} + 4 * coalesce({fault}, fault) + actor)"))
    blocks = marked.groupBy("conv_id", F.expr(f"place div {BLOCK_ROWS}").alias("block")).agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(place, symbol))), x -> x.symbol), '') as symbols"),
        F.expr(f"min(struct(place, {', '.join(ORDER)})) as at"),
    )
    return blocks.groupBy("conv_id").agg(F.expr("sort_array(collect_list(struct(at.*, symbols))) as blocks"))


_LINE = "kind INT, has_turn BOOLEAN, turn BIGINT, role STRING, digest BINARY, place BIGINT, value STRING, counts ARRAY<BIGINT>"
GAPS, COUNTS, EDITS, TURN = range(4)
_PIECE = re.compile("I*[KRD]")


def _edits(convs: DataFrame, grammar: Grammar, id_field: StructField) -> DataFrame:
    """Counts and cost of every conversation, and the edits of each of its blocks."""
    schema = StructType([id_field, *StructType.fromDDL(_LINE).fields])
    arrow = pa.schema([("kind", pa.int32()), ("has_turn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("place", pa.int64()), ("value", pa.string()), ("counts", pa.list_(pa.int64()))])

    def of(blocks: list[dict]) -> list[dict]:
        symbols = "".join(b["symbols"] for b in blocks)
        codes = [ord(s) - FIRST_SYMBOL for s in symbols]
        faults, actors = Counter(c // 4 for c in codes), ["suao"[c % 4] for c in codes]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(actors, actors[1:]))
        cost, audit = grammar.cheapest(symbols)
        numbers = [faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost]
        lines, pieces, at = [{"kind": COUNTS, "counts": numbers}], _PIECE.finditer(audit), 0
        for n, block in enumerate(blocks):
            start = at
            for _ in block["symbols"]:
                at = next(pieces).end()
            at = len(audit) if n == len(blocks) - 1 else at
            lines.append({"kind": EDITS, "value": audit[start:at]} | {c: block[c] for c in (*ORDER, "place")})
        return lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lines, owner = [], []
                for k, blocks in enumerate(part.column("blocks").to_pylist()):
                    found = of(blocks)
                    lines += found
                    owner += [k] * len(found)
                rest = pa.RecordBatch.from_pylist(lines, arrow)
                ids = part.column("conv_id").take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *rest.columns], ["conv_id", *arrow.names])

    return convs.mapInArrow(run, schema)


class _Repair:
    """Edits of one conversation applied to its rows as they come by."""

    def __init__(self) -> None:
        self.gaps, self.counts, self.state = 0, [0] * 5, START
        self.edits: deque[str] = deque()
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.line(NAME[self.state], "")

    def turn(self, role: str, text: str) -> None:
        *inserts, edit = self.edits.popleft()
        for _ in inserts:
            self.insert()
        if edit == "R":
            self.state = NEXT[self.state]
            self.line(NAME[self.state], text)
        elif edit == "K":
            self.state = SYSTEM if role.startswith("s") else NEXT[self.state]
            self.line(role, text)

    def take(self, row: dict) -> None:
        kind = row["kind"]
        if kind == GAPS:
            self.gaps = row["counts"][0]
        elif kind == COUNTS:
            self.counts = row["counts"]
        elif kind == EDITS:
            self.audit.append(row["value"])
            self.edits.extend(m.group() for m in _PIECE.finditer(row["value"]))
        else:
            self.turn(row["role"], row["value"])

    def result(self) -> dict:
        audit = "".join(self.audit)
        for _ in range(len(audit) - len(audit.rstrip("I"))):
            self.insert()
        names = ("blank", "duplicate", "truncated", "illegal", "cost")
        return {"gaps": self.gaps} | dict(zip(names, self.counts, strict=True)) | {"audit": audit, "repaired_sha256": self.hash.hexdigest()}


def repair(conversations: DataFrame, rounds: int = 5) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit and digest of the repaired text.

    Rows are damaged first (``damage``), then taken by turn, nulls first; rows of equal
    turn by role, then by the MD5 of role and text. A row that repeats an earlier one
    counts as a duplicate, the first of rows that are all alike does not. The repaired
    dialogue has the role initials ``(s?(ua)+)?``; of the cheapest audits the least
    one counts. Roles count by their first letter; a role of another letter or none
    can be changed or deleted, but not kept. A null conversation id is one more
    conversation. Extra columns are left out. ``rounds`` bounds the rules of the
    grammar, which changes no result.

    Texts are shuffled once. The rows of a conversation come past a digest one by one,
    which takes no memory, but SHA-256 of one conversation cannot be split.
    """
    spark = prepare_arrow(conversations.sparkSession)
    id_field = conversations.schema["conv_id"]
    damaged = damage(conversations)
    convs = materialize(_symbols(damaged), "symbols")
    whole = "array_join(transform(blocks, b -> b.symbols), '') as symbols"
    strings = materialize(convs.selectExpr(whole).groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    grammar = learn(strings, rounds)

    left = damaged.selectExpr("conv_id", "if(fate <> 0, turn, null) as turn").groupBy("conv_id")
    gaps = "array(bigint(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0))) as counts"
    heads = left.agg(F.expr(gaps)).withColumn("kind", F.lit(GAPS))
    turns = _rows(damaged).withColumnRenamed("text", "value").withColumn("kind", F.lit(TURN))
    parts = [heads, _edits(convs, grammar, id_field), turns]
    stream = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [f.name for f in StructType.fromDDL(_LINE).fields]
    stream = stream.select("conv_id", *names).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "kind", "place")

    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = StructType([id_field, *StructType.fromDDL(", ".join(f"{n} BIGINT" for n in numbers) + ", audit STRING, repaired_sha256 STRING").fields])
    arrow = pa.schema([(n, pa.int64()) for n in numbers] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_id, kind = None, None, None

        def flush(done: list[tuple[object, dict]]) -> pa.RecordBatch:
            rest = pa.RecordBatch.from_pylist([r for _, r in done], arrow)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind), *rest.columns], ["conv_id", *arrow.names])

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for row in batch.select(["conv_id", "kind", "role", "value", "counts"]).to_pylist():
                if current is None or row["conv_id"] != open_id:
                    if current:
                        done.append((open_id, current.result()))
                    current, open_id = _Repair(), row["conv_id"]
                current.take(row)
            if done:
                yield flush(done)
        if current:
            yield flush([(open_id, current.result())])

    return stream.mapInArrow(run, schema)
