"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question keeps its
template when its parameters change. Windows of template tokens are hash-joined with
the benchmark's windows; windows of one document and item count if their slots are
filled consistently: a value of the item always stands for the same value in the
document, and the other way round. Which values an item has does not matter, only
which of its slots are equal, so items that differ in values alone are one class.

Documents take part with the few windows that pass a Bloom filter of the benchmark's
windows, of bounded size whatever the benchmark's. Equal texts take part once.

Names are told by their capital. So that a passage in another case is found too,
windows are also looked up without placeholders for names, with case folded. A
name that is changed and written in another case at once is not found.

Both are done on whole words and on words cut where numbers begin and end, so that
"60km" is a number and a unit as "60 km" is. Words that are no longer literal when
cut may leave too few literals in a window; the whole words are kept for those.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import IS_WORD, LOWER, Hasher, Texts, map_texts, prepare_arrow, shingles
from tidemark.session import BROADCAST_ROWS, materialize, materialize_observed, release

# Words for units, and what placeholders hash to.
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes lb lbs pound pounds ounce ounces ml cl l "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees celsius fahrenheit kmh mph watt watts volt volts joule joules "
    "stunde stunden minuten tage tag jahr jahre meter kilometer gramm heure heures jour jours an ans mètre mètres gramme grammes "
    "hora horas minutos día días año años metro metros kilo kilos"
).split()
# Words that are units right after a number only.
AFTER_NUMBER = "h hr hrs min mins s sec secs ms".split()
NUMBER, NAME, UNIT = (np.uint64(k) for k in (11, 12, 13))
# With placeholders for numbers, units and names, and with names as words.
VIEWS = ("template", "words")

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/-+")] = True


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of currency signs (U+00A2 to U+00A5, U+20A0 to U+20CF) and of no-break spaces."""
    currency, blank = np.zeros(len(data), bool), np.zeros(len(data), bool)
    one = np.flatnonzero(data[:-1] == 0xC2)
    two = np.flatnonzero(data[:-2] == 0xE2)
    for table, at, width in (
        (currency, one[(data[one + 1] >= 0xA2) & (data[one + 1] <= 0xA5)], 2),
        (currency, two[((data[two + 1] == 0x82) & (data[two + 2] >= 0xA0)) | ((data[two + 1] == 0x83) & (data[two + 2] <= 0x8F))], 3),
        (blank, one[data[one + 1] == 0xA0], 2),
        (blank, two[(data[two + 1] == 0x80) & (data[two + 2] == 0xAF)], 3),
    ):
        for k in range(width):
            table[at + k] = True
    return currency, blank


@dataclass(frozen=True)
class Settings:
    """``window`` template tokens, of which ``literal`` are no placeholders.

    An item leaks if ``matches`` of its windows in a view, or all if it has fewer,
    match consistently: 6 windows of 8 are a passage of 13 tokens. Shorter items count
    as one window if they have ``short`` literal tokens. The broadcast filter has
    ``window_bits`` bits for every window of the benchmark and ``filter_bits`` at most
    (32 MB); a fuller filter lets more windows through to the join, with equal results.
    """

    window: int = 8
    literal: int = 4
    matches: int = 6
    short: int = 5
    window_bits: int = 512
    filter_bits: int = 1 << 28


def fold(texts: Texts) -> Texts:
    """``texts`` without case, in all scripts."""
    if not len(texts.data) or texts.data.max() < 128:
        return Texts(LOWER[texts.data], texts.bounds)
    raw, bounds = texts.data.tobytes(), texts.bounds.tolist()
    parts = [raw[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return Texts(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))


class Marks:
    """What both ways of cutting a text share: words, edges of punctuation, numbers, hashes of spans."""

    def __init__(self, texts: Texts):
        self.texts, self.data = texts, texts.data

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.texts.words()

    @cached_property
    def signs(self) -> tuple[np.ndarray, np.ndarray]:
        return _signs(self.data)

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return _edges(~_PUNCTUATION[self.data])

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.r_[0, np.cumsum(table[self.data], dtype=np.int32)] for table in (_NUMERIC, _DIGIT))

    @cached_property
    def hasher(self) -> Hasher:
        return Hasher(self.data)

    def cuts(self) -> np.ndarray:
        """Where numbers, currency signs and no-break spaces begin or end inside words."""
        data, kind = self.data, np.zeros(len(self.data), np.uint8)
        numeric = np.flatnonzero(_NUMERIC[data])
        if len(numeric):
            first = np.flatnonzero(np.r_[True, np.diff(numeric) > 1])
            digits = np.logical_or.reduceat(_DIGIT[data[numeric]], first)
            kind[numeric[np.repeat(digits, np.diff(np.r_[first, len(numeric)]))]] = 1
        currency, blank = self.signs
        kind += np.uint8(2) * currency + np.uint8(3) * blank
        found = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        return found[IS_WORD[data[found]] & IS_WORD[data[found - 1]]]


def _edges(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next and the last solid byte, seen from every byte."""
    place = np.arange(len(solid), dtype=np.int32 if len(solid) < 1 << 31 else np.int64)
    right = np.minimum.accumulate(np.where(solid, place, len(solid))[::-1])[::-1]
    return right, np.maximum.accumulate(np.where(solid, place, -1))


def _merged(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    both = np.zeros(size + 1, bool)
    both[one] = both[two] = True
    return np.flatnonzero(both)


def spans(marks: Marks, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every token, in order: words without the punctuation around them.

    If ``cut``, words end where numbers and currency signs begin or end, and at no-break spaces.
    """
    starts, ends, owner = marks.words
    right, left = marks.edges
    if cut and len(starts):
        cuts, blank = marks.cuts(), marks.signs[1]
        starts, ends = (_merged(x, cuts, len(marks.data)) for x in (starts, ends))
        owner = np.searchsorted(marks.texts.bounds, starts, "right") - 1
        if blank.any():
            right, left = _edges(~_PUNCTUATION[marks.data] & ~blank)
    if len(starts):
        starts, ends = right[starts].astype(np.int64), left[ends - 1].astype(np.int64) + 1
    keep = starts < ends
    return starts[keep], ends[keep], owner[keep]


class Tokens:
    """Tokens of documents: value without case, document, and hash and slot for each of ``VIEWS``."""

    def __init__(self, marks: Marks, folded: Marks, cut: bool):
        data = marks.data
        after = np.r_[False, data[:-1] == 0xC3] if len(data) else np.zeros(0, bool)
        big = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        starts, ends, self.owner = spans(marks, cut)
        # Folding keeps the tokens, but not always the bytes of their characters.
        aligned = len(data) == len(folded.data) and np.array_equal(data & 0xC0 == 0x80, folded.data & 0xC0 == 0x80)
        self.value = folded.hasher.spans(*((starts, ends) if aligned else spans(folded, cut)[:2]))
        self.hash = {view: self.value.copy() for view in VIEWS}
        self.slot = {view: np.zeros(len(starts), bool) for view in VIEWS}
        if not len(starts):
            return
        numeric, digits = marks.sums
        number = (numeric[ends] - numeric[starts] == ends - starts) & (digits[ends] > digits[starts])
        first = data[starts]
        wide = (first == 0xC3) & (ends - starts > 2)
        second = data[np.minimum(starts + 1 + wide, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90) & (ends - starts > 1)) | (wide & big[np.minimum(starts + 1, len(data) - 1)])
        name = capital & (((second >= 97) & (second <= 122)) | ((second >= 0xC3) & ~big[np.minimum(starts + 2 + wide, len(data) - 1)]))
        unit = _is_one_of(self.value, _hashes(UNITS))
        if cut:
            after = np.r_[False, number[:-1] & (self.owner[1:] == self.owner[:-1])]
            unit |= (after & _is_one_of(self.value, _hashes(AFTER_NUMBER))) | marks.signs[0][starts]
        for view in VIEWS:
            for kind, code in ((name, NAME), (unit, UNIT), (number, NUMBER)):
                if code != NAME or view == "template":
                    self.hash[view][kind] = code
                    self.slot[view] |= kind

    def windows(self, view: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of the windows inside one document."""
        n = max(0, len(self.value) - size + 1)
        first = np.flatnonzero(self.owner[:n] == self.owner[size - 1 :]) if n else np.zeros(0, np.int64)
        h, _ = shingles(self.hash[view], self.owner, size)
        return h, first


def _is_one_of(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """``np.isin`` for values of which hardly one is among ``few``."""
    table, low = np.zeros(1 << 16, bool), np.uint64((1 << 16) - 1)
    table[few & low] = True
    found = table[values & low]
    near = np.flatnonzero(found)
    found[near] = np.isin(values[near], few)
    return found


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = Texts(data, np.array([0, len(data)])).words()
    return Hasher(data).spans(starts, ends)


# Bits of one row of the filter, as ``bitmap_construct_agg`` makes them.
BITMAP = 32_768
WINDOW = ["cut", "view", "size", "h"]
TEXT = ["text_1", "text_2"]


def _digest(*parts: np.ndarray) -> int:
    joined = hashlib.blake2b(b"|".join(x.tobytes() for x in parts), digest_size=8)
    return int.from_bytes(joined.digest(), "little", signed=True)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _rows(values: np.ndarray, first: np.ndarray, size: int) -> pa.Array:
    """``values`` of the ``size`` tokens from each of ``first``, as bytes."""
    picked = values[first[:, None] + np.arange(size)] if len(first) else np.zeros((0, size), values.dtype)
    return pa.array([row.tobytes() for row in picked], pa.binary())


def item_windows(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The windows of every item, with its ``template`` and ``words`` class.

    ``slots`` has four bytes for every token of the window: -1 for a literal, else a
    number that equal values of the item share. Items of a class have equal windows
    with equal slots, in the template view alone or in both views.
    """

    def emit(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        ids = batch.column("item_id").to_numpy()
        for start, part in texts.runs():
            marks, folded = Marks(part), Marks(fold(part))
            both = [Tokens(marks, folded, cut) for cut in (False, True)]
            for k in range(len(part)):
                spans = [slice(*np.searchsorted(t.owner, [k, k + 1])) for t in both]
                numbers = [{v: _numbered(t, v, s) for v in VIEWS} for t, s in zip(both, spans, strict=True)]
                parts = {v: [x for t, s, n in zip(both, spans, numbers, strict=True) for x in (t.hash[v][s], n[v])] for v in VIEWS}
                template = _digest(*parts["template"])
                words = _digest(*parts["template"], *parts["words"])
                for cut, (tokens, span) in enumerate(zip(both, spans, strict=True)):
                    size = min(settings.window, span.stop - span.start)
                    for v, view in enumerate(VIEWS if size else ()):
                        h, first = shingles(tokens.hash[view][span], tokens.owner[span], size)[0], np.arange(span.stop - span.start - size + 1)
                        enough = settings.literal if size == settings.window else settings.short
                        keep = (numbers[cut][view][first[:, None] + np.arange(size)] < 0).sum(1) >= enough
                        h, first, n = h[keep], first[keep], int(keep.sum())
                        same = [np.full(n, x) for x in (ids[start + k], template, words)] + [np.full(n, x, np.int32) for x in (cut, v, size)]
                        yield _batch("item_id template words cut view size place h slots", *same, first, h.view(np.int64), _rows(numbers[cut][view], first, size))

    schema = "item_id BIGINT, template BIGINT, words BIGINT, cut INT, view INT, size INT, place BIGINT, h BIGINT, slots BINARY"
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    return map_texts(items, emit, schema)


def _numbered(tokens: Tokens, view: str, span: slice) -> np.ndarray:
    """-1 for literals, else which of the item's values fills the slot, in the order of their first places."""
    slot = tokens.slot[view][span]
    _, first, code = np.unique(tokens.value[span][slot], return_index=True, return_inverse=True)
    out = np.full(len(slot), -1, np.int32)
    out[slot] = np.argsort(np.argsort(first))[code]
    return out


def item_classes(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, template_class, words_class``: the smallest ids of the classes of each item.

    A leak of a class is a leak of all its items. Items without any window are left out.
    """
    return _classes(materialize(item_windows(benchmark, settings), "items"))


def _classes(items: DataFrame) -> DataFrame:
    members = items.select("item_id", "template", "words").distinct()
    for kind in ("template", "words"):
        members = members.join(members.groupBy(kind).agg(F.min("item_id").alias(f"{kind}_class")), kind)
    return members.select("item_id", "template_class", "words_class")


def _filter_bits(items: DataFrame, windows: int, settings: Settings) -> np.ndarray:
    """A Bloom filter of the windows, made in rows of ``BITMAP`` bits and of bounded size."""
    bits = BITMAP
    while bits < min(windows * settings.window_bits, settings.filter_bits):
        bits *= 2
    places = items.select(F.explode(F.array("h", F.expr("shiftrightunsigned(h, 32)"))).alias("p")).select(F.expr(f"p & {bits - 1}L").alias("p"))
    rows = places.groupBy(F.expr(f"p div {BITMAP}").alias("row")).agg(F.expr(f"bitmap_construct_agg(p % {BITMAP})").alias("bits"))
    table = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for row in rows.toLocalIterator():
        table[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    mask, found = np.uint64(len(table) * 8 - 1), np.arange(len(h))
    for shift in (np.uint64(0), np.uint64(32)):
        place = (h[found] >> shift) & mask
        found = found[(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return found


def candidate_windows(documents: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """The windows of the texts that pass the filter, once for every text: ``at``, ``h`` and the ``values`` of their tokens."""
    known = documents.sparkSession.sparkContext.broadcast(table)

    def emit(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        keys = [batch.column(c).to_numpy() for c in TEXT]
        for start, part in texts.runs():
            marks, folded = Marks(part), Marks(fold(part))
            for cut in (False, True):
                tokens = Tokens(marks, folded, cut)
                for v, view in enumerate(VIEWS):
                    for size in sizes:
                        h, first = tokens.windows(view, size)
                        near = _passes(known.value, h)
                        h, first = h[near], first[near]
                        doc = tokens.owner[first] if len(first) else first
                        at = first - np.searchsorted(tokens.owner, doc)
                        same = [np.full(len(h), x, np.int32) for x in (cut, v, size)]
                        yield _batch("text_1 text_2 cut view size at h values", *[k[start + doc] for k in keys], *same, at, h.view(np.int64), _rows(tokens.value, first, size))

    schema = "text_1 BIGINT, text_2 BIGINT, cut INT, view INT, size INT, at BIGINT, h BIGINT, values BINARY"
    return map_texts(documents.select(*TEXT, "text"), emit, schema).distinct()


def agreeing(places: list[int], slots: list[np.ndarray], values: list[np.ndarray]) -> list[int]:
    """The places of the windows of one alignment that agree on what fills the slots.

    Pairs of an item's value and a document's are taken by their number of tokens,
    those with the later last token first, if neither value has a partner.
    """
    pairs = {p + int(k): (int(s[k]), int(x[k])) for p, s, x in zip(places, slots, values, strict=True) for k in np.flatnonzero(s >= 0)}
    here, there = {}, {}
    for (a, b), _ in Counter(pairs[p] for p in sorted(pairs, reverse=True)).most_common():
        if a not in here and b not in there:
            here[a], there[b] = b, a
    bad = {p for p, (a, b) in pairs.items() if here.get(a) != b}
    return [p for p, s in zip(places, slots, strict=True) if bad.isdisjoint(range(p, p + len(s)))]


def _good(matches: DataFrame, kind: str) -> DataFrame:
    """``text_1, text_2, cut, template, kind, place`` of the matched windows that count.

    Windows without slots always do. The others of one alignment of a text and a class
    are at most as many as the windows of an item.
    """
    key = [*TEXT, "cut", *dict.fromkeys(["template", kind])]

    def agree(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        rows = [[np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("slots", np.int32), ("values", np.uint64))]
        good = agreeing(table.column("place").to_pylist(), *rows)
        return table.slice(0, len(good)).select(key).append_column("place", pa.array(good, pa.int64()))

    literal = F.col("slots") == F.expr("unhex(repeat('FFFFFFFF', size))")
    schema = ", ".join(f"{c} {'INT' if c == 'cut' else 'BIGINT'}" for c in [*key, "place"])
    aligned = matches.where(~literal).withColumn("shift", F.expr("at - place")).groupBy(*key, "shift")
    return matches.where(literal).select(*key, "place").union(aligned.applyInArrow(agree, schema)).distinct()


def _class_windows(items: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """The windows of the classes of a view, and by class and cut the number that must match."""
    key = list(dict.fromkeys(["template", view]))
    windows = items.where(F.col("view") == VIEWS.index(view)).groupBy(*key, *WINDOW, "place").agg(F.min("slots").alias("slots"))
    return windows, key


def _needed(windows: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    return windows.groupBy(*key, "cut").agg(F.least(F.count(F.lit(1)), F.lit(settings.matches)).alias("needed"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def text_leaks(candidates: DataFrame, items: DataFrame, windows: int, settings: Settings) -> DataFrame:
    """``text_1, text_2, leaked_items`` of the texts into which classes of items leak.

    Template classes come first. Classes of both views are matched only for those that
    did not leak by their template, and where enough of the places of their items match
    any of them.
    """
    templates, key = _class_windows(items, "template")
    joined = candidates.join(_small(templates, windows), WINDOW)
    good = materialize(_good(joined, "template"), "templates")
    counts = good.groupBy(*TEXT, "cut", "template").agg(F.count(F.lit(1)).alias("n"))
    leaked = counts.join(_needed(templates, key, settings), ["cut", "template"]).where("n >= needed")
    leaked = materialize(leaked.select(*TEXT, "template").distinct(), "leaked")

    wordly, key = _class_windows(items, "words")
    needed = _needed(wordly, key, settings)
    shared = wordly.select("template", *WINDOW, "place").distinct()
    near = candidates.join(_small(shared, windows), WINDOW).join(leaked, [*TEXT, "template"], "left_anti")
    group = [*TEXT, "cut", "template"]
    touched = near.select(*group, "place").union(good.select(*group, "place")).distinct()
    least = needed.groupBy("template", "cut").agg(F.min("needed").alias("least"))
    hopeful = touched.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(least, ["template", "cut"]).where("n >= least").select(*group)
    near = near.drop("place").distinct().join(hopeful, group, "left_semi")
    matches = near.join(_small(wordly, windows), ["template", *WINDOW])
    found = materialize(_good(matches, "words"), "words")
    more = good.join(found.select(*group, "words").distinct(), group).select(*found.columns)
    counts = found.union(more).distinct().groupBy(*group, "words").agg(F.count(F.lit(1)).alias("n"))
    also = counts.join(needed, ["template", "words", "cut"]).where("n >= needed").select(*TEXT, "words")

    parts = []
    for kind, rows in (("template", leaked), ("words", also)):
        first = items.groupBy(kind).agg(F.min("item_id").alias("item_id"))
        parts.append(rows.join(first, kind).select(*TEXT, "item_id"))
    return parts[0].union(parts[1]).groupBy(*TEXT).agg(F.array_sort(F.collect_set("item_id")).alias("leaked_items"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``documents`` with ``leaked_items``, the sorted ids of the classes of items that leak into each.

    A class is named by its smallest id; ``item_classes`` has the members. Items with a
    null id or text, and items too short to tell, match nothing; items of equal texts
    are of one class. A null text has no leaks. A ``leaked_items`` column that is there is
    replaced, others stay.
    """
    spark = prepare_arrow(documents.sparkSession)
    items = item_windows(benchmark, settings)
    items, seen = materialize_observed(items, "items", F.count(F.lit(1)).alias("windows"), F.collect_set("size").alias("sizes"))
    documents = documents.drop("leaked_items")
    if not seen["windows"]:
        return documents.withColumn("leaked_items", F.array().cast("array<bigint>"))
    texts = documents.select(*text_keys(), "text")
    candidates = candidate_windows(texts, _filter_bits(items, seen["windows"], settings), sorted(seen["sizes"]))
    candidates = materialize(candidates, "candidates")
    leaks = text_leaks(candidates, items, seen["windows"], settings)
    leaks, found = materialize_observed(leaks, "leaks", F.coalesce(F.sum(F.size("leaked_items") + 2), F.lit(0)).alias("values"))
    release(candidates, items)
    columns = documents.columns
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *text_keys())
    joined = keyed.join(_small(leaks, found["values"]), TEXT, "left")
    empty = F.array().cast("array<bigint>")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in columns], F.coalesce("leaked_items", empty).alias("leaked_items"))


def text_keys() -> list:
    """Two hashes of 64 bits that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias(TEXT[0]), F.xxhash64(F.lit(1), text).alias(TEXT[1])]
