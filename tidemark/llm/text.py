"""Whole columns of texts as flat byte arrays inside Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Texts are handled in runs of whole documents of about this many bytes, which
# bounds the memory of a task (a longer document is a run of its own).
RUN_BYTES = 1_000_000

# The bytes that separate words.
SEPARATORS = b" \t\n\x0b\f\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def prepare_arrow(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, whatever the length of the texts.

    Workers look for this package where the driver found it, besides their path.
    Joins of all texts with a few chosen ids may filter the texts before their
    shuffle by a Bloom filter of the ids, of bounded size.
    """
    root, known = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "64m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.expectedNumItems", "4000000")
    return spark


_work: list[object] = [None]
_kept: list[Callable] = []


def kept_for_work(make: Callable) -> Callable:
    """A cache of what tasks build, by worker process, until the process goes on to other work."""
    _kept.append(cache(make))
    return _kept[-1]


def begin_work(work: object) -> None:
    """Drops what this process has built for other work and gives its memory back."""
    if work != _work[0]:
        _work[0] = work
        if any(made.cache_info().currsize for made in _kept):
            for made in _kept:
                made.cache_clear()
            gc.collect()
            # Freed pages between used ones go back only if asked for (glibc).
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


class Texts:
    """Documents laid end to end: ``data`` and the bounds of every document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        """Null texts are empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, bounds, data = column.buffers()
        bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(data[bounds[0] : bounds[-1]], bounds - bounds[0])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    def runs(self, limit: int = RUN_BYTES) -> Iterator[tuple[int, Texts]]:
        """Consecutive documents of about ``limit`` bytes, with the first index."""
        first = 0
        while first < len(self):
            last = int(np.searchsorted(self.bounds, self.bounds[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(self))
            lo, hi = self.bounds[first], self.bounds[last]
            yield first, Texts(self.data[lo:hi], self.bounds[first : last + 1] - lo)
            first = last

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word, in order."""
        inside = IS_WORD[self.data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(self.lengths)
        first, last = self.bounds[full], self.bounds[full + 1] - 1
        starts[first] = inside[first]
        ends[last] = inside[last]
        starts = np.flatnonzero(starts)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(self.bounds, starts, "right") - 1


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    return _powers(1 << max(16, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any substrings of ``data`` from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words inside one document."""
    n = max(0, len(words) - size + 1)
    keep = owner[:n] == owner[size - 1 :] if n else np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h + words[k : n + k] + np.uint64(k + 1))
    return h[keep], owner[:n][keep]


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch, Texts], Iterator[pa.RecordBatch]], schema: str, text: str = "text", work: object = None
) -> DataFrame:
    """``fn`` on Arrow batches of ``df``, with the texts as flat bytes.

    What ``fn`` keeps by ``kept_for_work`` stays in a worker for tasks of equal ``work``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work(work)
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch, Texts.of(batch.column(text)))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
