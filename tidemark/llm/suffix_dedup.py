"""Suffix-array dedup: removes later copies of long byte strings.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Every such string holds an anchor, the window's k-gram of smallest hash, so equal
strings have equal anchors. Anchors seen once are dropped; around the others the
bytes of their windows are brought together by anchor. There a suffix array
orders the windows, previous and next smaller positions in it give the longest
previous factor, and windows whose factor has the full length are later copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Hasher, Texts, map_texts, prepare_arrow
from tidemark.session import materialize, release

# Windows whose suffix array is built at a time; anchors stay whole.
ARRAY_WINDOWS = 60_000


@dataclass(frozen=True)
class Settings:
    """``hot``: anchors in more places are matched by their whole windows."""

    length: int = 100
    gram: int = 32
    hot: int = 4000


def anchors(texts: Texts, settings: Settings) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, first window and number of windows, by run of windows."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    size = len(texts.data)
    if size < settings.length:
        return empty
    grams = Hasher(texts.data).windows(settings.gram)
    span = settings.length - settings.gram + 1
    count = size - settings.length + 1
    best = _smallest((grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64), span)
    place = (best[:count] & np.uint64((1 << 24) - 1)).astype(np.int64)
    owner = np.searchsorted(texts.bounds, np.arange(count), "right") - 1
    whole = np.arange(count) + settings.length <= texts.bounds[owner + 1]
    new = np.ones(count, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, count])
    keep = whole[first]
    first, runs = first[keep], runs[keep]
    own = owner[first]
    return grams[place[first]].view(np.int64), own, first - texts.bounds[own], runs


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values, from running minima of blocks."""
    n = len(values)
    rows = -(-n // span)
    block = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = values
    block = block.reshape(rows, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each; -1 if none.

    Everything between an index and its candidate is larger, which stays true if
    the candidate moves on to its own candidate, so all indices jump together.
    """
    near = np.arange(-1, len(values) - 1)
    active = np.flatnonzero(near >= 0)
    while len(active):
        active = active[values[near[active]] > values[active]]
        near[active] = near[near[active]]
        active = active[near[active] >= 0]
    return near


def previous_factors(windows: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with an earlier one, up to its length.

    Rows are suffixes in text order, cut to equal length. Their suffix array is
    sorted once; the neighbours with the longest match among earlier rows are
    the nearest smaller positions on either side.
    """
    n, length = windows.shape
    if n < 2:
        return np.zeros(n, np.int64)
    array = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    before = nearest_smaller(array)
    after = n - 1 - nearest_smaller(array[::-1])[::-1]
    best = np.zeros(n, np.int64)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < n))
        differ = windows[array[has]] != windows[array[near[has]]]
        common = np.where(differ.any(1), differ.argmax(1), length)
        best[array[has]] = np.maximum(best[array[has]], common)
    return best


def repeated_anchors(documents: DataFrame, settings: Settings) -> DataFrame:
    """``anchor, doc_id, first, runs`` of the anchors that occur more than once.

    Anchors that repeat within a batch are known to count; one row stands for
    them in the shuffle, so a frequent passage is a row for each batch.
    """
    schema = "anchor BIGINT, doc_id BIGINT, first INT, runs INT"
    names = ["anchor", "doc_id", "first", "runs"]

    def emit(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy()
        found = [[], [], [], []]
        for start, part in texts.runs():
            for to, values in zip(found, _long_safe(part, settings), strict=True):
                to.append(values)
            found[1][-1] = ids[start + found[1][-1]]
        anchor, doc, first, runs = (np.concatenate(x) for x in found)
        order = np.argsort(anchor, kind="stable")
        anchor, doc, first, runs = anchor[order], doc[order], first[order], runs[order]
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        known = np.bincount(group, minlength=1)[group] > 1 if len(anchor) else new
        probe = anchor[new & known]
        columns = [
            pa.array(np.r_[anchor, probe]), pa.array(np.r_[doc, probe]),
            pa.array(np.r_[first, np.full(len(probe), -1)].astype(np.int32)),
            pa.array(np.r_[runs, np.zeros(len(probe))].astype(np.int32)), pa.array(np.r_[known, np.zeros(len(probe), bool)]),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*names, "known"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the last row, or its anchor once it is known to repeat
        for batch in batches:
            known = batch.column("known")
            yield batch.filter(pc.and_(known, pc.greater_equal(batch.column("first"), 0))).select(names)
            rest = batch.filter(pc.invert(known))
            if not rest.num_rows:
                continue
            rest = pa.Table.from_batches([*held, rest]).combine_chunks().to_batches()[0]
            anchor = rest.column("anchor").to_numpy()
            same = np.zeros(len(anchor) + 1, bool)
            same[0] = last is not None and anchor[0] == last
            same[1:-1] = anchor[1:] == anchor[:-1]
            keep = (same[:-1] | same[1:]) & (rest.column("first").to_numpy() >= 0)
            held, last = ([], anchor[-1]) if same[-2] else ([rest.slice(len(anchor) - 1)], None)
            yield rest.filter(pa.array(keep)).select(names)

    rows = map_texts(documents.where("doc_id is not null"), emit, schema + ", known BOOLEAN")
    route = F.when(F.col("known"), F.xxhash64("doc_id", "first")).otherwise(F.col("anchor"))
    rows = rows.repartition(route).sortWithinPartitions("known", "anchor")
    return rows.mapInArrow(repeated, schema)


def _long_safe(part: Texts, settings: Settings, limit: int = 8 << 20) -> tuple[np.ndarray, ...]:
    """``anchors``, with very long documents cut into overlapping pieces."""
    if len(part.data) <= limit:
        return anchors(part, settings)
    found = []
    for lo in range(0, len(part.data), limit):
        piece = part.data[lo : lo + limit + settings.length - 1]
        anchor, own, first, runs = anchors(Texts(piece, np.array([0, len(piece)])), settings)
        found.append((anchor, own, first + lo, runs))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows_of(documents: DataFrame, settings: Settings) -> DataFrame:
    """The bytes of the windows of every listed anchor.

    ``documents`` has ``places``, a list of (first, runs, anchor, hot). Anchors
    of very many places are keyed by whole windows instead. Equal bytes under
    one key are later copies of the first in their batch and travel without bytes.
    """

    def emit(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        places = batch.column("places")
        flat = places.flatten()
        first, runs, key, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        first, runs = first.astype(np.int64), runs.astype(np.int64)
        fits = first + runs + settings.length - 1 <= texts.lengths[row]
        first, runs, key, hot, row = first[fits], runs[fits], key[fits], hot[fits], row[fits]
        if hot.any():
            much = np.flatnonzero(hot)
            copies = runs[much]
            step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            one_first, one_row = np.repeat(first[much], copies) + step, np.repeat(row[much], copies)
            start = texts.bounds[one_row] + one_first
            one_key = _window_keys(texts.data, start, settings.length)
            first, row = np.r_[first[~hot], one_first], np.r_[row[~hot], one_row]
            runs, key = np.r_[runs[~hot], np.ones(len(one_first), np.int64)], np.r_[key[~hot], one_key]
        ids, twins = batch.column("doc_id").to_numpy(), batch.column("twin").to_numpy()
        order = np.lexsort((first, twins[row], ids[row]))
        first, runs, key, row = first[order], runs[order], key[order], row[order]
        seen, bodies, at = {}, [], texts.bounds[row] + first
        for k, (a, n) in enumerate(zip(at.tolist(), (runs + settings.length - 1).tolist(), strict=True)):
            body = texts.data[a : a + n].tobytes()
            earlier = seen.setdefault((key[k], body), k)
            same = first[earlier] == first[k] and ids[row[earlier]] == ids[row[k]] and twins[row[earlier]] == twins[row[k]]
            bodies.append(body if same else None)
        columns = [key, ids[row], twins[row], first.astype(np.int32), runs.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary())], ["key", "doc_id", "twin", "first", "runs", "body"])

    schema = "key BIGINT, doc_id BIGINT, twin BIGINT, first INT, runs INT, body BINARY"
    return map_texts(documents, emit, schema)


def _window_keys(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    bodies = (data[a : a + length].tobytes() for a in starts.tolist())
    keys = b"".join(hashlib.blake2b(body, digest_size=8).digest() for body in bodies)
    return np.frombuffer(keys, np.int64)


def later_copies(windows: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, twin, first, runs``: runs of windows that also start earlier."""
    names = ["doc_id", "twin", "first", "runs"]

    def factor(rows: pa.Table) -> pa.RecordBatch:
        doc, twin, first, runs = (rows.column(c).to_numpy().astype(np.int64) for c in names)
        order = np.lexsort((first, twin, doc))
        doc, twin, first, runs = doc[order], twin[order], first[order], runs[order]
        once = np.ones(len(doc), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (first[1:] != first[:-1])
        order, doc, twin, first, runs = order[once], doc[once], twin[once], first[once], runs[once]
        bodies = Texts.of(rows.column("body").take(pa.array(order)))
        row = np.repeat(np.arange(len(runs)), runs)
        step = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        parts = np.lib.stride_tricks.sliding_window_view(bodies.data, settings.length)[bodies.bounds[row] + step]
        later = previous_factors(parts) >= settings.length
        start = first[row] + step
        edge = later.copy()
        edge[1:] = later[1:] & ~(later[:-1] & (row[1:] == row[:-1]))
        begin = np.flatnonzero(edge)
        length = np.diff(np.r_[np.cumsum(later)[begin] - 1, later.sum()])
        columns = [doc[row[begin]], twin[row[begin]], start[begin].astype(np.int32), length.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            bare = batch.column("body").is_null()
            yield batch.filter(bare).select(names)
            batch = batch.filter(pc.invert(bare))
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += pc.sum(batch.column("runs")).as_py()
            if waiting >= ARRAY_WINDOWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
                total = np.r_[0, np.cumsum(table.column("runs").to_numpy())][cuts]
                k = 0
                while k < len(cuts) - 1:  # the last key may go on in the next batch
                    full = int(np.searchsorted(total, total[k] + ARRAY_WINDOWS, "right")) - 1
                    to = min(max(full, k + 1), len(cuts) - 1)
                    yield factor(table.slice(cuts[k], cuts[to] - cuts[k]))
                    k = to
                rest = table.slice(cuts[-1])
                held, waiting = rest.to_batches(), pc.sum(rest.column("runs")).as_py()
        if held:
            yield factor(pa.Table.from_batches(held).combine_chunks())

    route = F.when(F.col("body").isNull(), F.xxhash64("doc_id", "first")).otherwise(F.col("key"))
    rows = windows.repartition(route).sortWithinPartitions("key")
    return rows.mapInArrow(run, "doc_id BIGINT, twin BIGINT, first INT, runs INT")


def _with_twin(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("twin", F.xxhash64("text"))


def _cut(near: DataFrame, settings: Settings) -> DataFrame:
    """The remaining bytes of documents with ``later`` windows."""

    def run(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        later = batch.column("later")
        bounds, (first, runs) = later.offsets.to_numpy(), (later.flatten().field(k).to_numpy() for k in (0, 1))
        columns = [[], [], [], []]
        for k in range(len(texts)):
            data = texts.data[texts.bounds[k] : texts.bounds[k + 1]]
            change = np.zeros(len(data) + 1, np.int32)
            own = slice(bounds[k] - bounds[0], bounds[k + 1] - bounds[0])
            np.add.at(change, first[own], 1)
            np.add.at(change, first[own] + runs[own] + settings.length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = data[~gone].tobytes()
            spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
            for to, value in zip(columns, (int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                to.append(value)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), *columns], ["doc_id", "twin", *CUT])

    return map_texts(near, run, "doc_id BIGINT, twin BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept STRING")


CUT = ["n_removed", "n_spans", "kept_sha256", "kept"]


def _repeats(documents: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Every row without its text, and the remains of the documents that lose a part."""
    prepare_arrow(documents.sparkSession)
    texts = _with_twin(documents.select("doc_id", "text"))
    rows = texts.selectExpr("doc_id", "twin", "bigint(octet_length(text)) as n_bytes", "sha2(text, 256) as sha256")
    plain = rows = materialize(rows, "texts")
    first = rows.where("doc_id is not null").groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    copy = F.coalesce(F.expr(f"doc_id > first_id and n_bytes >= {settings.length}"), F.lit(False))
    rows = materialize(rows.join(first, "sha256", "left").withColumn("copy", copy).drop("first_id"), "rows")
    release(plain)

    single = rows.where("not copy and doc_id is not null").select("doc_id", "twin").distinct()
    all_anchors = materialize(repeated_anchors(texts, settings), "anchors")
    found = all_anchors.join(single.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    found = found.join(counts, "anchor").withColumn("hot", F.expr(f"n > {settings.hot}"))
    places = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "runs", "anchor", "hot")).alias("places"))
    # With the texts of an id told apart here, the texts themselves are shuffled once.
    all_places = materialize(places.join(single, "doc_id"), "places")
    release(all_anchors, counts)
    # True for every id; a comparison lets the join filter the texts by a Bloom filter.
    places = all_places.where(F.col("doc_id") >= F.lit(-(1 << 63)))
    near = texts.join(places, ["doc_id", "twin"])
    near = materialize(near, "near")
    release(all_places)
    later = later_copies(windows_of(near, settings), settings)
    later = later.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("first", "runs")).alias("later"))
    later = materialize(later, "later")
    kept = _cut(near.drop("places").join(later, ["doc_id", "twin"]), settings)
    kept = materialize(kept, "kept")
    release(near, later)
    return rows, kept.dropDuplicates(["doc_id", "twin"])


def remains(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What each row of ``documents`` keeps: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null is empty; a string that starts in a document of
    smaller id, or earlier in the same one, stays and its later copies go. Of
    equal ids the text with the smaller hash counts as earlier, and rows with
    equal id and text are one document. A row with a null id keeps its text and
    is not compared. Texts shorter than ``length`` keep theirs. Other columns are
    not looked at.
    """
    rows, kept = _repeats(documents, settings)
    rows = rows.join(kept.drop("kept"), ["doc_id", "twin"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return rows.selectExpr(
        "doc_id", "n_bytes", "if(copy, n_bytes, coalesce(n_removed, 0)) as n_removed", "bigint(if(copy, 1, coalesce(n_spans, 0))) as n_spans",
        f"if(copy, '{none}', coalesce(kept_sha256, sha256)) as kept_sha256",
    )


def deduplicate(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``documents`` with the remains as their text, without rows that lose all of it.

    A character that is cut in two goes; all columns stay as they are.
    """
    rows, kept = _repeats(documents, settings)
    changed = kept.select("doc_id", "twin", F.col("kept").alias("_kept"))
    copies = rows.where("copy").select("doc_id", "twin").distinct().withColumn("_kept", F.lit(""))
    changed = changed.union(copies).toDF("_id", "_twin", "_kept")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_twin"))
    out = documents.join(changed, same, "left").where("_kept is null or _kept <> ''")
    return out.withColumn("text", F.coalesce("_kept", "text")).drop("_id", "_twin", "_kept")
