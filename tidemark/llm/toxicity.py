"""Toxicity: a classifier that may not change its score when a group is named.

Documents are sets of words and word beginnings. A logistic regression is fitted on
the terms that toxic documents use more often than others, with a penalty besides its
loss: in every labelled sentence that names a group, the name is swapped for the other
names of its kind and for a neutral word, and the squared change of the score counts.
Words that go with toxic texts only because the texts are about a group lose their
weight, and neutral mentions are no longer taken for attacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.quality import held_out
from tidemark.llm.text import LOWER, Hasher, Texts, map_texts, mix, prepare_arrow
from tidemark.session import materialize

# Names of groups by kind, in four languages; the first of a kind is the
# neutral word.
IDENTITIES = (
    "believers christian christians muslim muslims jewish jews hindu hindus buddhist atheist catholic muslime christen juden musulman musulmans chrétien juifs musulmán musulmanes cristiano judíos",
    "people black white asian african european american arab latino mexican chinese indian german french turkish polish immigrants refugees ausländer flüchtlinge türken araber étrangers arabe noirs inmigrantes árabes negros",
    "persons women men woman man girls boys female male frauen männer femmes hommes mujeres hombres",
    "folks gay lesbian bisexual transgender straight queer homosexual schwul lesbisch lesbienne lesbiana",
    "patients disabled deaf blind autistic elderly young behindert taub aveugle sourd ciego sordo ancianos",
)

PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``sample`` is about the number of labelled rows fitted on (all, if there are fewer)."""

    sample: int = 20_000
    candidates: int = 50_000
    features: int = 1_000
    least_documents: int = 3
    least_evidence: float = 15.0
    counterfactual: float = 30.0
    ridge: float = 1e-3
    threshold: float = 0.5


IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a") : ord("z") + 1] = True
IS_LETTER[128:] = True


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and document of every letter run and of its beginnings, and the runs of every document.

    The case of A to Z is folded.
    """
    data = LOWER[texts.data]
    inside = IS_LETTER[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(texts.lengths)
    first, last = texts.bounds[full], texts.bounds[full + 1] - 1
    starts[first], ends[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    owner = np.searchsorted(texts.bounds, starts, "right") - 1
    hasher = Hasher(data)
    codes, owners = [hasher.spans(starts, ends)], [owner]
    for size in PREFIXES:
        long = ends - starts >= size
        codes.append(mix(hasher.spans(starts[long], starts[long] + size) + np.uint64(size)))
        owners.append(owner[long])
    return np.concatenate(codes).view(np.int64), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


# Levels of use: once, more often, or so often for the number of words.
LEAST_USES, LEAST_PERCENT = (1, 2, 4), (1, 3)
LEVELS = len(LEAST_USES) + len(LEAST_PERCENT)


def levels(codes: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, level and document of the levels that the uses of a code reach, each once.

    ``words`` are the words of every document.
    """
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]) if len(codes) else np.zeros(0, np.int64)
    uses = np.diff(np.r_[first, len(codes)])
    codes, owner = codes[first], owner[first]
    reached = [uses >= n for n in LEAST_USES] + [100 * uses >= n * words[owner] for n in LEAST_PERCENT]
    row, level = np.nonzero(np.stack(reached, 1)) if len(codes) else (first, first)
    return codes[row], level, owner[row]


def known_terms(texts: Texts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (place in the sorted ``codes`` and level) that documents have, by document."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, owner, words = terms(texts)
    place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
    hit = codes[place] == found
    place, level, owner = levels(place[hit], owner[hit], words)
    return place * LEVELS + level, owner


# --- counterfactual sentences ------------------------------------------------------

_KIND = {name: kind.split() for kind in IDENTITIES for name in kind.split()[1:]}
_NAMES = re.compile(r"(?<!\w)(" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
_END = re.compile(r"[.!?\n]")


def sentences(text: str) -> Iterator[tuple[str, list[str]]]:
    """Sentences that name a group, each with its swaps, one name at a time."""
    for match in _NAMES.finditer(text):
        ends = [m.end() for m in _END.finditer(text, max(0, match.start() - 500), match.start())]
        first = ends[-1] if ends else max(0, match.start() - 500)
        end = _END.search(text, match.end(), match.end() + 500)
        last = end.end() if end else match.end() + 500
        name = match.group().lower()
        swaps = [text[first : match.start()] + other + text[match.end() : last] for other in _KIND.get(name, []) if other != name]
        yield text[first:last], swaps


def differences(texts: list[str], codes: np.ndarray, chosen: np.ndarray) -> Counter[tuple[int, ...]]:
    """Changes of the ``chosen`` features by swaps, as ``place + 1`` gained or ``-place - 1`` lost."""
    found: Counter[tuple[int, ...]] = Counter()
    for text in texts:
        for sentence, swaps in sentences(text):
            place, owner = known_terms(Texts.of(pa.array([sentence, *swaps])), codes)
            place, owner = place[chosen[place]], owner[chosen[place]]
            before = set(place[owner == 0].tolist())
            for k in range(1, len(swaps) + 1):
                after = set(place[owner == k].tolist())
                if before != after:
                    found[tuple(sorted([p + 1 for p in after - before] + [-p - 1 for p in before - after]))] += 1
    return found


# --- fit -------------------------------------------------------------------------


class Model:
    """Sorted term codes with a weight for each of their levels, and the bias."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, settings: Settings):
        self.codes, self.weights, self.bias, self.settings = codes, weights, bias, settings

    def scores(self, texts: Texts) -> np.ndarray:
        place, owner = known_terms(texts, self.codes)
        total = np.bincount(owner, self.weights[place], len(texts)) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(total, -40, 40))), 6)


def solve(place: np.ndarray, row: np.ndarray, labels: np.ndarray, n: int, changes: Counter[tuple[int, ...]], settings: Settings, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the penalised loss."""
    rows = len(labels)
    lost = [(k, abs(t) - 1, 1.0 if t > 0 else -1.0) for k, change in enumerate(changes) for t in change]
    pair, at, sign = (np.array(x, t) for x, t in zip(zip(*lost), (int, int, float), strict=False)) if lost else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    counts = np.array(list(changes.values()), float)
    share = settings.counterfactual * counts / counts.sum() if len(counts) else counts

    # The curvature of every weight bounds the step of that weight.
    width = np.bincount(row, minlength=rows)
    curve = 0.25 * np.bincount(place, width[row] + 1, n) / rows + settings.ridge
    if len(pair):
        curve = curve + 2 * np.bincount(at, (share * np.bincount(pair, minlength=len(share)))[pair], n)
    bias_curve = 0.25 * (1 + width.mean())
    weights, bias = np.zeros(n), float(np.log((labels.sum() + 1) / (rows - labels.sum() + 1)))
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(steps):
        total = np.bincount(row, ahead[place], rows) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - labels) / rows
        gradient = np.bincount(place, error[row], n) + settings.ridge * ahead
        if len(pair):
            change = np.bincount(pair, ahead[at] * sign, len(share))
            gradient = gradient + 2 * np.bincount(at, (share * change)[pair] * sign, n)
        new, new_bias = ahead - gradient / curve, ahead_bias - error.sum() / bias_curve
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / faster
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, faster
    return weights, float(bias)


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Labelled documents that are not held out, about ``settings.sample`` of them.

    Rows are chosen by a hash of the id. Of several labels the highest counts, of
    several texts of an id the least; null ids and labels are left aside.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = min(1.0, settings.sample / max(1, known.count()))
    known = known.where(f"pmod(xxhash64(doc_id), 1000000) < {round(share * 1e6)}")
    texts = documents.select("doc_id", "text").join(known, "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _document_counts(rows: DataFrame, codes: np.ndarray | None) -> DataFrame:
    """Documents at each level of each term (or of ``codes``), added up before they are shuffled."""

    def count(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        found = []
        for _, run in texts.runs():
            if codes is None:
                code, level, _ = levels(*terms(run))
            else:
                place, _ = known_terms(run, codes)
                code, level = codes[place // LEVELS], place % LEVELS
            found.append(np.stack([code, level]))
        (code, level), n = np.unique(np.concatenate(found, 1), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(level.astype(np.int32)), pa.array(n)], ["code", "level", "n"])

    return map_texts(rows, count, "code BIGINT, level INT, n BIGINT").groupBy("code", "level").agg(F.sum("n").alias("n"))


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a term's use, negative where clean documents use it more."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    share = (toxic + clean) / max(1, n_toxic + n_clean)
    found = part(toxic, share * n_toxic) + part(clean, share * n_clean)
    found = found + part(n_toxic - toxic, (1 - share) * n_toxic) + part(n_clean - clean, (1 - share) * n_clean)
    return 2 * found * np.where(toxic * n_clean >= clean * n_toxic, 1, -1)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Terms are chosen and gathered by tasks; weights are fitted on the driver.

    At most ``candidates`` levels of terms are compared and ``features`` kept. The driver holds
    which of them the sampled documents use, no texts. Without labelled rows of both
    kinds there are no terms, and every document gets the share of toxic labels.
    """
    prepare_arrow(documents.sparkSession)
    rows = materialize(labelled_sample(documents, labels, settings), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k == 1), sum(n for k, n in sizes.items() if k != 1)
    codes, chosen = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n_toxic and n_clean:
        used = materialize(_document_counts(rows.where("label = 1"), None).where(f"n >= {settings.least_documents}"), "terms")
        top = used.orderBy(F.desc("n"), "code", "level").limit(settings.candidates).toArrow()
        codes, place = np.unique(top["code"].to_numpy(), return_inverse=True)
        feature = place * LEVELS + top["level"].to_numpy()
        toxic = np.zeros(len(codes) * LEVELS)
        toxic[feature] = top["n"].to_numpy()
        other = _document_counts(rows.where("label <> 1"), codes).toArrow()
        clean = np.zeros(len(toxic))
        clean[np.searchsorted(codes, other["code"].to_numpy()) * LEVELS + other["level"].to_numpy()] = other["n"].to_numpy()
        proof = evidence(toxic, clean, n_toxic, n_clean)
        best = np.lexsort((np.arange(len(proof)), -proof))[: settings.features]
        best = best[proof[best] >= settings.least_evidence]
        kept = np.unique(best // LEVELS)
        chosen = np.searchsorted(kept, best // LEVELS) * LEVELS + best % LEVELS
        codes = codes[kept]
    is_chosen = np.isin(np.arange(len(codes) * LEVELS), chosen)

    def gather(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, run in texts.runs():
            place, owner = known_terms(run, codes)
            place, owner = place[is_chosen[place]], owner[is_chosen[place]]
            used = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(run) + 1)), pa.int32()), pa.array(place, pa.int32()))
            ids, label = (batch.column(c).slice(first, len(run)) for c in ("doc_id", "label"))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), label.cast(pa.int32()), used], ["doc_id", "label", "used"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            found += differences([t for t in batch.column("text").to_pylist() if t], codes, is_chosen)
        yield pa.RecordBatch.from_pydict({"change": [list(c) for c in found], "n": list(found.values())}, pa.schema([("change", pa.list_(pa.int32())), ("n", pa.int64())]))

    table = map_texts(rows, gather, "doc_id BIGINT, label INT, used ARRAY<INT>").toArrow()
    table = table.take(np.argsort(table["doc_id"].to_numpy(), kind="stable"))
    sizes = np.array([len(u) for u in table["used"]], np.int64) if table.num_rows else np.zeros(0, np.int64)
    place = table["used"].combine_chunks().flatten().to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
    labels_ = (table["label"].to_numpy() == 1).astype(float)

    swapped = rows.select("text").mapInArrow(swap, "change ARRAY<INT>, n BIGINT")
    changes = Counter({tuple(r["change"]): r["n"] for r in swapped.groupBy("change").agg(F.sum("n").alias("n")).collect()})
    # Every name also counts as one sentence of its own, so that none is unseen.
    changes += differences(list(_KIND), codes, is_chosen)
    changes = Counter(dict(sorted(changes.items())))  # sums follow no order of tasks
    if not len(codes):
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Model(codes, np.zeros(0), float(np.log(share / (1 - share))), settings)
    weights, bias = solve(place, np.repeat(np.arange(len(sizes)), sizes), labels_, len(is_chosen), changes, settings)
    return Model(codes, weights, bias, settings)


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` and ``predicted``.

    Scores see the whole text and nothing else: a null text counts as an empty one,
    equal texts get equal scores. Extra columns stay; columns of the three names are
    replaced. A null id is held out of nothing (``held_out`` null).
    """
    spark = prepare_arrow(documents.sparkSession)
    documents = documents.drop("held_out", "score", "predicted")
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*documents.schema.fields, StructField("score", DoubleType())])
    names = [*documents.columns, "score"]

    def score(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        values = [shared.value.scores(run) for _, run in texts.runs()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values))], names)

    predicted = (F.col("score") >= model.settings.threshold).cast("int")
    return map_texts(documents, score, schema).withColumns({"held_out": held_out(), "predicted": predicted})
