"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The rows of the incidence matrix are documents, its columns hashed word n-grams.
Columns are cut into blocks by their hash. Two rows that reach the similarity
differ in at most ``d`` columns, a bound from their sizes, so with more than
``d`` blocks they agree on a whole block. Rows that agree on blocks, directly or
over others, form families; rows that agree by chance do not, as pairs of small
blocks are first held against each other's sketch, a byte for every few columns:
sketches that differ in more bytes than the rows may in columns belong to no pair.
Sketches also part the families. The matrix is the product of the rows of each family that is
left, cut into blocks of rows. It is accumulated over blocks of columns; pairs
go as soon as their overlap and what is left of both rows cannot reach the bound
of their sizes, and rows without pairs go with them. A passage that many
documents share makes no family by itself, as the columns around it differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import LOWER, Hasher, Texts, map_texts, mix, prepare_arrow, shingles
from tidemark.session import BROADCAST_ROWS, few_tasks, materialize, materialize_observed, release

# Rows and columns of a block of the product.
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 2048

# In blocks of at most so many documents each pair is looked at by itself: two texts
# that agree on a block by chance then tie no families together.
SMALL_BLOCK = 8

# Blocks of fewer columns count only where they must: two texts often agree on
# one or two frequent shingles alone.
LEAST_COLUMNS = 3


@dataclass(frozen=True)
class Similarity:
    """Shingle length and the bound: ``100 * common >= percent * union``."""

    words: int = 5
    percent: int = 80
    class_ratio: float = 1.6

    def most_different(self, size: int) -> int:
        """Columns in which a row and a partner that is not smaller may differ."""
        total = size + size * 100 // self.percent
        return total * (100 - self.percent) // (100 + self.percent)

    def least_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-self.percent * (a + b) // (100 + self.percent))

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest size, number of blocks and most differing blocks by size class."""
        last, size = [], 1
        while size < 1 << 40:
            last.append(size)
            size = max(size + 1, int(size * self.class_ratio))
        differ = np.array([self.most_different(s) for s in last])
        return np.array(last), differ + 1 + differ // 4, differ


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the documents, end to end, and their bounds."""
    starts, ends, owner = texts.words()
    h = Hasher(LOWER[texts.data]).spans(starts, ends)
    grams, own = shingles(h, owner, words)
    counts = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = np.array([_whole(h[f : f + n]) for f, n in zip(first, counts[short], strict=True)], np.uint64)
        grams, own = np.concatenate([grams, whole]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        grams, own = grams[order], own[order]
    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    return grams[new], np.searchsorted(own[new], np.arange(len(texts) + 1))


def _whole(words: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = np.uint64(len(words))
        for w in words:
            h = mix(h * np.uint64(3) + w)
    return int(h)


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums by set; equal for equal sets."""
    sums = []
    for seed in (1, 2):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ np.uint64(seed * 0x632BE59BD9B4E019)), out=total[1:])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def block_keys(grams: np.ndarray, bounds: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the column blocks of every set, the set of every key and the size class.

    A set joins the classes of all sizes that its smaller partners may have.
    Blocks with fewer than ``LEAST_COLUMNS`` shingles count only for sets with so
    many of them that a pair might agree on nothing else; both sets of such a
    pair have as many.
    """
    last, blocks, differ = like.classes
    sizes = np.diff(bounds)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams), out=sums[1:])
    high = grams >> np.uint64(32)
    keys, owners, kinds = [], [], []
    smallest = -(-sizes * like.percent // 100)
    lo, hi = np.searchsorted(last, smallest), np.searchsorted(last, sizes)
    for up in range(int((hi - lo).max(initial=-1)) + 1):
        kind = hi - up
        chosen = np.flatnonzero((sizes > 0) & (kind >= lo))
        if not len(chosen):
            continue
        counts = sizes[chosen]
        pick = np.repeat(bounds[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        own = np.repeat(np.arange(len(chosen)), counts)
        block = (high[pick] * blocks[kind[chosen]][own].astype(np.uint64)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])])
        end = np.r_[start[1:], len(own)]
        of = own[start]
        seed = mix(kind[chosen][of].astype(np.uint64) << np.uint64(40) | block[start])
        key = mix(sums[pick[end - 1] + 1] - sums[pick[start]] + seed)
        large = end - start >= LEAST_COLUMNS
        k, most = blocks[kind[chosen]], differ[kind[chosen]]
        needs = np.bincount(of[large], minlength=len(chosen)) <= most + most // 8
        large |= needs[of]
        keys.append(key[large])
        owners.append(chosen[of[large]])
        kinds.append(kind[chosen][of[large]])
        for i in np.flatnonzero(k - np.bincount(of, minlength=len(chosen)) >= k - most):
            empty = np.setdiff1d(np.arange(k[i], dtype=np.uint64), block[start][of == i])
            keys.append(mix(mix(np.uint64(kind[chosen][i]) << np.uint64(40) | empty)))
            owners.append(np.full(len(empty), chosen[i]))
            kinds.append(np.full(len(empty), kind[chosen][i]))
    if not keys:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(kinds)


def least_agreeing(owners: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, like: Similarity) -> np.ndarray:
    """For each of the ``block_keys`` the least number of keys of its class in which its set agrees with any that it links with.

    Linked sets share the class of the smaller one. Each column in which they differ spoils one
    block at most. If one set has keys of large blocks alone, these are more than
    ``most + most // 8``; if one has keys of all blocks that are not empty, more than ``most``.
    """
    _, blocks, differ = like.classes
    at = owners * len(blocks) + kinds
    counts, most = np.bincount(at, minlength=len(sizes) * len(blocks))[at], differ[kinds]
    sure = np.where(counts == blocks[kinds], most + 1, np.minimum(counts, most + 1 + most // 8))
    return sure - np.minimum(most, like.most_different(sizes[owners]))


def sketches(grams: np.ndarray, bounds: np.ndarray, like: Similarity) -> list[list[tuple[int, bytes]]]:
    """Size class and cells of every set, for each of its size classes.

    A cell is a byte of the sum of its columns. Cells of equal columns are equal,
    so two sets differ in at least as many columns as cells.
    """
    last, _, _ = like.classes
    sizes = np.diff(bounds)
    lo, hi = np.searchsorted(last, -(-sizes * like.percent // 100)), np.searchsorted(last, sizes)
    high, value = grams >> np.uint64(32), mix(grams).astype(np.uint8)
    out: list[list[tuple[int, bytes]]] = []
    for a, b, first, final in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        own = []
        for kind in range(first, final + 1) if b > a else ():
            cells = int(last[kind]) // 2 + 1
            place = (high[a:b] * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
            own.append((kind, np.bincount(place, weights=value[a:b], minlength=cells).astype(np.int64).astype(np.uint8).tobytes()))
        out.append(own)
    return out


def close_sketches(cells: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``left`` and ``right`` rows whose sketches allow a link."""
    one, two = [], []
    for i in left.tolist():
        differ = (cells[right] != cells[i]).sum(1)
        total = sizes[right] + sizes[i]
        fits = 100 * np.minimum(sizes[right], sizes[i]) >= like.percent * np.maximum(sizes[right], sizes[i])
        near = right[fits & (differ <= (100 - like.percent) * total // (100 + like.percent)) & (right != i)]
        one.append(np.full(len(near), i))
        two.append(near)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(one + none), np.concatenate(two + none)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.split())


def shingled(documents: DataFrame, like: Similarity) -> DataFrame:
    """``doc_id, n_shingles, key1, key2``: the size and the key of every set."""

    def run(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, part in texts.runs():
            grams, bounds = shingle_sets(part, like.words)
            ids = batch.column("doc_id").slice(first, len(part)).cast(pa.int64())
            yield _batch("doc_id n_shingles key1 key2", ids, np.diff(bounds), *set_keys(grams, bounds))

    return map_texts(documents, run, "doc_id BIGINT, n_shingles BIGINT, key1 BIGINT, key2 BIGINT")


def block_pairs(block: np.ndarray, kind: np.ndarray, doc: np.ndarray, *least: np.ndarray) -> tuple[np.ndarray, ...]:
    """``kind, a, b, whole`` of rows sorted by block, whose blocks are complete.

    A block of at most ``SMALL_BLOCK`` documents gives all its pairs (``whole``), a
    larger one pairs all its documents with the first. With ``least`` there is a fifth
    column, the larger value of a pair or that of the row paired with the first.
    """
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(block)])
    first, small = np.repeat(start, size), np.repeat(size <= SMALL_BLOCK, size)
    at = np.arange(len(block))
    one, two = [first[~small]], [at[~small]]
    for step in range(1, SMALL_BLOCK):
        later = at[small & (at - first >= step)]
        one.append(later - step)
        two.append(later)
    one, two = np.concatenate(one), np.concatenate(two)
    keep = doc[one] != doc[two]
    one, two = one[keep], two[keep]
    pairs = kind[two], np.minimum(doc[one], doc[two]), np.maximum(doc[one], doc[two]), small[two]
    return *pairs, *(np.where(small[two], np.maximum(x[one], x[two]), x[two]) for x in least)


def shared_blocks(documents: DataFrame, like: Similarity) -> DataFrame:
    """``kind, a, b, whole, blocks, least``: documents of a size class that agree on ``blocks`` blocks (``block_pairs``).

    Equal sets of one task are combined before the shuffle. Blocks arrive sorted,
    so a block of any size streams through its task. ``least`` is the least number of
    blocks (``least_agreeing``) of a linked pair, or, if the pair is not ``whole``, of links
    of ``b``, which is not the first of its block.
    """
    n_kinds = len(like.classes[0])

    def emit(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, part in texts.runs():
            grams, bounds = shingle_sets(part, like.words)
            ids = batch.column("doc_id").slice(first, len(part)).cast(pa.int64()).to_numpy()
            order = np.lexsort((ids, *set_keys(grams, bounds)))
            keys, owner, kinds = block_keys(grams, bounds, like)
            one, two = set_keys(grams, bounds)
            repeat = np.zeros(len(ids), bool)
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            repeat[order[1:][same]] = True
            keep = ~repeat[owner]
            # One number for the class and the least number of blocks: this is the largest shuffle.
            least = np.minimum(least_agreeing(owner, kinds, np.diff(bounds), like), (1 << 31) // n_kinds - 1)
            kinds = (kinds + n_kinds * least).astype(np.int32)
            yield _batch("block kind doc_id", keys[keep], kinds[keep], ids[owner[keep]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, leader = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32)], None, None
        for batch in batches:
            block, kind, doc = (c.to_numpy() for c in batch.columns)
            new = block, kind % n_kinds, doc, kind // n_kinds
            rows = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
            found = []
            if large is not None:
                # The rest of a large block whose first document has gone by.
                n = int(np.searchsorted(rows[0], large, "right"))
                doc = rows[2][:n]
                found.append((rows[1][:n], np.minimum(doc, leader), np.maximum(doc, leader), np.zeros(n, bool), rows[3][:n]))
                rows = [r[n:] for r in rows]
            if len(rows[0]):
                cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
                held, large = [r[cut:] for r in rows], None
                found.append(block_pairs(*[r[:cut] for r in rows]))
                if len(held[0]) > SMALL_BLOCK:
                    found.append(block_pairs(*held))
                    large, leader = held[0][0], held[2][0]
                    held = [h[:0] for h in held]
            else:
                held = rows
            for part in found:
                yield _batch("kind a b whole least", *part)
        yield _batch("kind a b whole least", *block_pairs(*held))

    rows = map_texts(documents.where("doc_id is not null"), emit, "block BIGINT, kind INT, doc_id BIGINT")
    rows = rows.repartition("block").sortWithinPartitions("block", "doc_id")
    found = rows.mapInArrow(pairs, "kind INT, a BIGINT, b BIGINT, whole BOOLEAN, least INT").where("a <> b")
    return found.groupBy("kind", "a", "b").agg(F.min("whole").alias("whole"), F.count(F.lit(1)).alias("blocks"), F.min("least").alias("least"))


def linkable(near: DataFrame) -> DataFrame:
    """``kind, a, b, whole`` of the pairs ``near (kind, a, b, whole, blocks, least)`` of sets that links may need.

    The larger a table is, the more of its sets agree on a block or two by chance or by a
    passage that many have. Pairs of small blocks go if they agree on too few of them. With
    the first set of a large block only sets stay that share enough blocks with any others;
    the first one itself need not.
    """
    ends = near.selectExpr("kind", "explode(array(a, b)) as b", "blocks")
    total = ends.groupBy("kind", "b").agg(F.sum("blocks").alias("total"))
    return near.join(total, ["kind", "b"]).where("if(whole, blocks, total) >= least").select("kind", "a", "b", "whole")


def possible_pairs(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The ``pairs (kind, a, b)`` whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("row_a", "row_b")]
            differ = np.array([np.count_nonzero(x != y) for x, y in zip(*rows, strict=True)], np.int64)
            one, two = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            fits = 100 * np.minimum(one, two) >= like.percent * np.maximum(one, two)
            fits &= differ <= (100 - like.percent) * (one + two) // (100 + like.percent)
            yield batch.select(["kind", "a", "b"]).filter(pa.array(fits, pa.bool_()))

    cells = sets.select("id", "size", F.explode("sketches").alias("kind", "row"))
    for side in ("a", "b"):
        pairs = pairs.join(cells.toDF(side, f"size_{side}", "kind", f"row_{side}"), ["kind", side])
    return pairs.mapInArrow(run, "kind INT, a BIGINT, b BIGINT")


UNIT = ["kind", "family", "one", "two"]


def product_links(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of ``left`` and ``right`` rows, by their blocked product."""
    sizes = np.array([len(r) for r in rows], np.int64)
    need = like.least_common(sizes[left][:, None], sizes[right][None, :])
    alive = np.minimum(sizes[left][:, None], sizes[right][None, :]) >= need
    alive &= left[:, None] != right[None, :]
    common = np.zeros(alive.shape, np.float32)
    grams, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.r_[True, grams[1:] != grams[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    rest = sizes - np.bincount(owner[~shared[column]], minlength=len(rows))
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    for first in range(0, int(shared.sum()), BLOCK_COLUMNS):
        alive &= common + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
        a, b = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(a):
            break
        lo, hi = np.searchsorted(column, [first, first + BLOCK_COLUMNS])
        matrix = np.zeros((len(rows), BLOCK_COLUMNS), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - first] = 1
        common[np.ix_(a, b)] += matrix[left[a]] @ matrix[right[b]].T
        rest = rest - np.bincount(owner[lo:hi], minlength=len(rows))
    one, two = np.nonzero(alive & (common >= need))
    return left[one], right[two]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs that connect what all pairs connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def unit_links(units: DataFrame, like: Similarity, sketched: bool = False) -> DataFrame:
    """``kind, a, b``: links that connect the rows of every unit as all its links do.

    ``units`` has ``kind, family, one, two``, with the numbers of two blocks of
    rows, and ``side``, ``id`` and ``row`` of their rows: shingles, or cells of a
    sketch with ``size``.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if rows.column("one")[0] == rows.column("two")[0]:
            right = left
        found = [np.frombuffer(g.as_buffer(), np.uint8 if sketched else np.uint64) for g in rows.column("row")]
        if sketched:
            a, b = close_sketches(np.stack(found), rows.column("size").to_numpy(), left, right, like)
        else:
            a, b = product_links(found, left, right, like)
        kept = spanning(a, b, len(ids))
        return _batch("kind a b", np.full(len(kept), rows.column("kind")[0].as_py(), np.int32), ids[a[kept]], ids[b[kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in UNIT])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and part.num_rows and any(held[0].column(c)[0] != part.column(c)[0] for c in UNIT):
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield links(pa.Table.from_batches(held))

    rows = units.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return rows.mapInArrow(run, "kind INT, a BIGINT, b BIGINT")


def jaccard_components(documents: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, with whole results.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text
    with fewer words than a shingle is one shingle, a text without words or null
    has none and links with nothing. ``component_id`` is the smallest id that is
    reachable by links, the own id included. Equal sets are one row of the
    product; rows that repeat an id belong together; a row with a null id has a
    null component. Other columns are not looked at.
    """
    prepare_arrow(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    found = materialize(shingled(documents, like), "shingled")
    full = found.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("first_id"))
    members = materialize(found.join(first, ["key1", "key2", "n_shingles"], "left"), "members")
    ids = members.where("first_id is not null").groupBy("doc_id", "first_id", "n_shingles").agg(F.lit(1))
    ids = ids.select("doc_id", "first_id", "n_shingles")

    shared = materialize(shared_blocks(documents, like), "blocks")

    # Families of sets of a size class, connected by the blocks they agree on. A pair of
    # a small block connects its sets only if their sketches allow a link. In other pairs
    # ``a`` stays the first set of a block.
    near = shared.join(ids.selectExpr("doc_id as a", "first_id as _a"), "a").join(ids.selectExpr("doc_id as b", "first_id as _b"), "b")
    near = near.where("_a <> _b").groupBy("kind", F.col("_a").alias("a"), F.col("_b").alias("b"))
    near = near.agg(F.min("whole").alias("whole"), F.max("blocks").alias("blocks"), F.min("least").alias("least"))
    blocks = materialize(near, "near")
    near, seen = materialize_observed(linkable(blocks), "linkable", F.count(F.lit(1)).alias("rows"))
    # No table of their sets, by size class, has more rows.
    most = 2 * seen["rows"]
    wanted = _sized(near.selectExpr("explode(array(a, b)) as doc_id").distinct(), "wanted", most)
    sets = materialize(_sets(documents.join(wanted, "doc_id", "left_semi"), like), "sets")
    edges = possible_pairs(near.where("whole").drop("whole"), sets, like).union(near.where("not whole").drop("whole"))
    edges = materialize(edges, "edges")
    families = _families(edges.selectExpr("struct(kind, a as id) as a", "struct(kind, b as id) as b"))

    key = ["kind", "family"]
    rows = families.join(families.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    cells = sets.select("id", "size", F.explode("sketches").alias("kind", "row"))
    rows = cells.join(_sized(rows, "rows", most), ["kind", "id"]).withColumns({"main": F.lit(False), "mains": F.lit(0)})
    close = unit_links(rows.select("id", "size", "row", *key, F.explode(_units()).alias("unit")).select("id", "size", "row", *key, "unit.*"), like, True)
    close_links = materialize(close, "close")
    close = close_links.selectExpr("struct(kind, a as id) as a", "struct(kind, b as id) as b")
    families, all_sets, sets = _families(close), sets, sets.select("id", "grams")
    sizes = families.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    sizes, seen = materialize_observed(few_tasks(sizes, most), "families", F.max("n").alias("most"))

    twice = ids.groupBy("doc_id").agg(F.min("first_id").alias("a"), F.count_distinct("first_id").alias("n"))
    links = twice.where("n > 1").join(ids, "doc_id").selectExpr("a", "first_id as b")
    rows = families.join(sizes, key).withColumns({"main": F.lit(False), "mains": F.lit(0)})
    if (seen["most"] or 0) > BLOCK_ROWS:
        # In large families, rows that link with the first row need no product among themselves.
        large = families.join(sizes, key).where(f"n > {BLOCK_ROWS}")
        first = _spokes(large.where("id <> family").select("family", "id").distinct(), sets, like)
        links = links.union(first)
        linked = first.toDF("family", "id").withColumn("main", F.lit(True))
        main = large.join(linked, ["family", "id"], "left").withColumn("main", F.expr("coalesce(main, id = family)"))
        main = main.where("main").select("kind", "family", "id", "main")
        counts = main.groupBy(*key).agg(F.count(F.lit(1)).alias("mains"))
        rows = families.join(sizes.join(counts, key, "left"), key).join(main, [*key, "id"], "left")
        rows = rows.withColumns({"main": F.coalesce("main", F.lit(False)), "mains": F.coalesce("mains", F.lit(0))})
    units = sets.join(_sized(rows, "rows", most), "id").select("id", F.col("grams").alias("row"), *key, F.explode(_units()).alias("unit"))
    links = links.union(materialize(unit_links(units.select("id", "row", *key, "unit.*"), like), "links").select("a", "b"))
    labels = components(links).toDF("first_id", "component")
    # Labels are written: what they were made of can go.
    release(found, shared, blocks, near, all_sets, edges, close_links)
    out = members.join(labels, "first_id", "left")
    return out.selectExpr("doc_id", "n_shingles", "coalesce(component, first_id, doc_id) as component_id")


def _sized(rows: DataFrame, label: str, most: int) -> DataFrame:
    """``rows``, at most ``most``, written out, to be broadcast if their counted number allows it."""
    rows, seen = materialize_observed(few_tasks(rows, most), label, F.count(F.lit(1)).alias("rows"))
    return F.broadcast(rows) if seen["rows"] <= BROADCAST_ROWS else rows


def _families(near: DataFrame) -> DataFrame:
    """``kind, id, family`` of the sets that ``near (a, b)`` connects within a size class."""
    return components(near).selectExpr("node.kind", "node.id", "component.id as family")


def _units():
    """The pairs of row blocks that a row takes part in, as ``one, two, side``.

    Rows are dealt to blocks by their hash; those of ``main`` to blocks of their
    own, of which no two are multiplied.
    """
    rest, mains = (f"bigint(ceil({x} / {BLOCK_ROWS}))" for x in ("(n - mains)", "mains"))
    own = f"if(main, {rest} + pmod(xxhash64(id), {mains}), pmod(xxhash64(id), {rest}))"
    others = f"filter(sequence(0L, {rest} + {mains} - 1), k -> not (main and k >= {rest}))"
    return F.expr(f"transform({others}, k -> struct(least(k, {own}) as one, greatest(k, {own}) as two, int(if({own} > k, 1, 0)) as side))")


def _spokes(rows: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """``a, b``: the ``rows`` (family, id) that link with the first row of their family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                pair = [np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("hub", "grams")]
                found.append(len(product_links(pair, np.array([0]), np.array([1]), like)[0]) > 0)
            yield batch.select(["family", "id"]).filter(pa.array(found, pa.bool_())).rename_columns(["a", "b"])

    pairs = rows.join(sets, "id").join(sets.toDF("family", "hub"), "family").select("family", "id", "hub", "grams")
    return materialize(pairs.mapInArrow(run, "a BIGINT, b BIGINT").distinct(), "spokes")


def _sets(documents: DataFrame, like: Similarity) -> DataFrame:
    def run(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, part in texts.runs():
            grams, bounds = shingle_sets(part, like.words)
            rows = pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            cells = pa.array(sketches(grams, bounds, like), pa.map_(pa.int32(), pa.binary()))
            ids = batch.column("doc_id").slice(first, len(part)).cast(pa.int64())
            yield _batch("id size grams sketches", ids, np.diff(bounds), rows, cells)

    return map_texts(documents, run, "id BIGINT, size BIGINT, grams BINARY, sketches MAP<INT, BINARY>")
