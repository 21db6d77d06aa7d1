"""Quality classifier: similarity-weighted vote of labelled neighbours.

Documents become counts of surface terms, the counts become latent-semantic
vectors, and every document takes the labels of its nearest labelled vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.text import LOWER, Hasher, Texts, map_texts, mix, prepare_arrow, shingles

CLASSES, WORDS, SHAPES, REPEATS = 512, 256, 256, 3
COLUMNS = CLASSES + WORDS + SHAPES + 2 * REPEATS

# Documents of a block of cosines: bounds the memory of short documents too.
BLOCK_ROWS = 256

# Bytes with a class of their own in the character trigrams.
SPECIAL = b" \n\t.,;:!?'\"()-|*#$%&<>/\\@=+_[]{}~^"


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are fitted and broadcast."""

    sample: int = 6000
    dims: int = 48
    neighbours: int = 25
    threshold: float = 0.3


@cache
def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[128:] = 4
    for k, b in enumerate(SPECIAL):
        table[b] = 5 + k
    return table


@cache
def _trigram_columns() -> np.ndarray:
    return (mix(np.arange(48**3, dtype=np.uint64)) % np.uint64(CLASSES)).astype(np.int64)


def term_counts(texts: Texts) -> np.ndarray:
    """Term counts of every document; empty texts have none."""
    n, data = len(texts), texts.data
    counts = np.zeros((n, COLUMNS), np.float32)

    def add(first: int, width: int, owner: np.ndarray, column: np.ndarray) -> None:
        counts[:, first : first + width] += np.bincount(owner * width + column, minlength=n * width).reshape(n, width)

    classes = _byte_classes()[data]
    if len(data) >= 3:
        owner = np.repeat(np.arange(n), texts.lengths)
        same = owner[:-2] == owner[2:]
        code = (classes[:-2] * 48 + classes[1:-1]) * 48 + classes[2:]
        add(0, CLASSES, owner[:-2][same], _trigram_columns()[code[same]])

    starts, ends, owner = texts.words()
    if len(starts):
        h = Hasher(LOWER[data]).spans(starts, ends)
        add(CLASSES, WORDS, owner, (h % np.uint64(WORDS)).astype(np.int64))
        shape = (classes[starts] * 48 + classes[ends - 1]) * 48 + classes[np.maximum(starts, ends - 2)]
        shape = shape * 8 + np.minimum(7, (ends - starts) // 3)
        add(CLASSES + WORDS, SHAPES, owner, (mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64))

        total = np.bincount(owner, minlength=n)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        repeats = [np.bincount(owner[again], minlength=n)]
        for size in (1, 3):
            g, own = (h, owner) if size == 1 else shingles(h, owner, size)
            distinct = np.unique(mix(g + mix(own.astype(np.uint64))), return_index=True)[1]
            repeats.append(np.bincount(own, minlength=n) - np.bincount(own[distinct], minlength=n))
        for k, r in enumerate(repeats):
            counts[:, CLASSES + WORDS + SHAPES + 2 * k] = r
            counts[:, CLASSES + WORDS + SHAPES + 2 * k + 1] = total - r
    return counts


# Share of each kind of term in a document's squared length.
BLOCKS = [(0, CLASSES, 1.0), (CLASSES, WORDS, 0.1), (CLASSES + WORDS, SHAPES, 1.0)]
BLOCKS += [(CLASSES + WORDS + SHAPES + 2 * k, 2, 0.35) for k in range(REPEATS)]


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares within each kind of term."""
    out = np.zeros_like(counts)
    for first, width, share in BLOCKS:
        part = counts[:, first : first + width]
        out[:, first : first + width] = np.sqrt(share * part / np.maximum(part.sum(1, keepdims=True), 1))
    return out


class Model:
    """Latent directions and the labelled vectors in them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, settings: Settings):
        self.settings, self.labels = settings, labels.astype(np.float32)
        rows = weighted(counts)
        used = (rows > 0).sum(0)
        self.scale = np.log((1 + len(rows)) / (1 + used)).astype(np.float32) + 1
        rows = rows * self.scale
        self.mean = rows.mean(0) if len(rows) else np.zeros(COLUMNS, np.float32)
        rows = rows - self.mean
        values, directions = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        self.directions = directions[:, np.argsort(-values)[: settings.dims]].astype(np.float32)
        self.vectors = self._unit(rows @ self.directions)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted mean label of the nearest labelled vectors, ties included."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        rows = self._unit((weighted(counts) * self.scale - self.mean) @ self.directions)
        return np.concatenate([self._votes(rows[k : k + BLOCK_ROWS], prior) for k in range(0, max(1, len(rows)), BLOCK_ROWS)])

    def _votes(self, rows: np.ndarray, prior: float) -> np.ndarray:
        cosine = np.round(rows @ self.vectors.T, 5)
        k = min(self.settings.neighbours, cosine.shape[1])
        edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, [cosine.shape[1] - k]]
        weight = np.where(cosine >= np.maximum(edge, 0), cosine, 0).astype(np.float64) ** 4
        total = weight.sum(1)
        score = np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-12), prior)
        return np.round(np.clip(score, 0, 1), 6)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """At most ``settings.sample`` labelled documents that are not held out.

    Rows are chosen by a hash of the id. Of several labels the lowest counts;
    null ids, null labels and labels without a document are left aside.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    texts = documents.select("doc_id", F.col("text")).where("doc_id is not null")
    return texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on the bounded sample; only its term counts reach the driver."""
    prepare_arrow(documents.sparkSession)
    schema = "doc_id BIGINT, label INT, terms BINARY"

    def featurise(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, run in texts.runs():
            rows = [r.tobytes() for r in term_counts(run)]
            ids, label = (batch.column(c).slice(first, len(run)) for c in ("doc_id", "_label"))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), label.cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "terms"])

    rows = map_texts(labelled_sample(documents, labels, settings), featurise, schema).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    terms = [rows["terms"][int(i)].as_buffer() for i in order]
    counts = np.stack([np.frombuffer(t, np.float32) for t in terms]) if terms else np.zeros((0, COLUMNS), np.float32)
    return Model(counts, rows["label"].to_numpy()[order], settings)


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` and ``predicted``.

    Scores see nothing but the text: a null text counts as an empty one, and
    equal texts get equal scores. Extra columns stay; columns of the three
    names are replaced. A null id is held out of nothing (``held_out`` null).
    """
    spark = prepare_arrow(documents.sparkSession)
    documents = documents.drop("held_out", "score", "predicted")
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*documents.schema.fields, StructField("score", DoubleType())])
    names = [*documents.columns, "score"]

    def score(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        values = [shared.value.scores(term_counts(run)) for _, run in texts.runs()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values))], names)

    scored = map_texts(documents, score, schema)
    predicted = (F.col("score") >= model.settings.threshold).cast("int")
    return scored.withColumns({"held_out": held_out(), "predicted": predicted})
