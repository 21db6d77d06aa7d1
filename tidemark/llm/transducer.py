"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent words of the corpus are compiled, with their token ids, into an
automaton whose states are shared by equal suffixes. Every transition carries the
number of words before it, so a walk gives the rank of a word and with it the
place of its ids. The automaton is one flat file that workers memory-map. Words
outside it are merged exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared_files
from tidemark.llm.bpe import Memo, distinct_words, vocabulary
from tidemark.llm.text import Texts, kept_for_work, map_texts, prepare_arrow
from tidemark.session import materialize, release, scratch_path

# Words compiled into the lexicon.
LEXICON_WORDS = 50_000


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The automaton of ``entries`` and their ids as one flat file."""
    states: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []
    counts: list[int] = []

    def frozen(node: tuple[bool, list]) -> int:
        key = (node[0], tuple(node[1]))
        if key not in states:
            states[key] = len(states)
            edges.append(key[1])
            finals.append(node[0])
            counts.append(node[0] + sum(counts[to] for _, to in key[1]))
        return states[key]

    # Words come sorted, so only the path of the last word is still open.
    path: list[tuple[bool, list]] = [(False, [])]
    last = b""
    words = sorted(entries)
    for word in words:
        same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(node)))
        path += [(False, []) for _ in word[same:]]
        path[-1] = (True, path[-1][1])
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], frozen(node)))
    root = frozen(path[0])

    keys, targets, before = [], [], []
    for state, out in enumerate(edges):
        passed = int(finals[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            before.append(passed)
            passed += counts[to]
    ids = [np.frombuffer(entries[w], "<u4") for w in words]
    parts = [
        np.array([root]), np.array(keys), np.array(targets), np.array(before), np.array(finals, np.int64),
        np.cumsum([0, *map(len, ids)]), np.concatenate([*ids, np.zeros(0, np.int64)]),
    ]
    head = np.array([len(parts), *map(len, parts)], np.int64)
    return b"".join(p.astype(np.int64).tobytes() for p in [head, *parts])


class Lexicon:
    """A compiled lexicon over a memory-mapped file."""

    def __init__(self, buffer: pa.Buffer):
        flat = np.frombuffer(buffer, np.int64)
        bounds = 1 + flat[0] + np.cumsum(np.r_[0, flat[1 : 1 + flat[0]]])
        parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        (self.root,), self.keys, self.targets, self.before, self.finals, self.bounds, ids = parts
        self.ids = ids.astype("<u4").tobytes()

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of every word, -1 for words outside; all words walk together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lengths) - lengths
        state, rank = np.full(n, self.root), np.zeros(n, np.int64)
        going, step = np.flatnonzero(lengths > 0), 0
        alive = np.ones(n, bool)
        while len(going) and len(self.keys):
            key = state[going] << 8 | data[start[going] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            alive[going[~found]] = False
            going, at = going[found], at[found]
            rank[going] += self.before[at]
            state[going] = self.targets[at]
            step += 1
            going = going[lengths[going] > step]
        alive &= (self.finals[state] > 0) & (len(self.keys) > 0)
        return np.where(alive, rank, -1)

    def get(self, ranks: np.ndarray) -> list[bytes]:
        """Packed ids of words inside."""
        lo, hi = (self.bounds[ranks] * 4).tolist(), (self.bounds[ranks + 1] * 4).tolist()
        return [self.ids[a:b] for a, b in zip(lo, hi, strict=True)]


def frequent_words(documents: DataFrame, limit: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``limit`` frequent words of all texts: those above a count that few enough have.

    Words are counted by tasks; the number of words of each count tells where the cut
    is, and no more than ``limit`` words reach the driver. Words that come once are
    left out. Which words are in changes no result.
    """

    def count(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for _, part in texts.runs():
            words, counts, _, _ = distinct_words(part)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], ["word", "n"])

    words = map_texts(documents, count, "word BINARY, n BIGINT").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = materialize(words.withColumn("level", F.expr(_LEVEL)), "word-counts")
    levels = words.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in levels:
        total += row["words"]
        if total > limit:
            break
        least = row["level"]
    rows = [] if least is None else words.where(f"level >= {least}").orderBy(F.desc("n"), "word").collect()
    release(words)
    return [bytes(r.word) for r in rows]


# Counts up to 1,024 by themselves, larger ones in steps of about one percent: some
# thousand levels at most.
_LEVEL = "if(n <= 1024, n, 384 + bigint(log2(n) * 64))"


def write_lexicon(documents: DataFrame, path: str, limit: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of ``documents`` into the shared folder."""
    words = frequent_words(documents, limit)
    uri = scratch_path(documents.sparkSession, "lexicon")
    shared_files.write(uri, compile_lexicon(dict(zip(words, vocabulary(path).merge_words(words), strict=True))))
    return uri


class Encoder:
    """Words to ids: the lexicon first, exact merges for the rest."""

    def __init__(self, path: str, lexicon: str):
        self.vocabulary = vocabulary(path)
        self.file = shared_files.mapped(lexicon)
        self.lexicon = Lexicon(self.file.read_buffer())
        self.rest = Memo(self.vocabulary.merge_words)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and the bounds of each."""
        words, _, which, owner = distinct_words(texts)
        ranks = self.lexicon.ranks(words)
        seen, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0).tolist()
        ids = [b""] * len(words)
        for k, packed in zip(seen.tolist(), self.lexicon.get(ranks[seen]), strict=True):
            ids[k] = packed
        for k, packed in zip(unseen, self.rest([words[k] for k in unseen]), strict=True):
            ids[k] = packed
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        place = np.repeat(begin[which] - np.cumsum(each) + each, each) + np.arange(each.sum())
        return flat[place], np.r_[0, np.cumsum(np.bincount(owner, weights=each, minlength=len(texts)))].astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library does for a file without a decoder: tokens between spaces."""
        return b" ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@kept_for_work
def _encoder(path: str, lexicon: str) -> Encoder:
    return Encoder(path, lexicon)


def encode(documents: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``documents``.

    ``ids`` are little-endian 32-bit integers as binary, ``decoded`` is the text
    decoded from them. A null text counts as empty and has neither ids nor text;
    rows keep their id, null or repeated; other columns are not looked at.
    """
    prepare_arrow(documents.sparkSession)
    documents = documents.selectExpr("bigint(doc_id) as doc_id", "text")
    lexicon = lexicon or write_lexicon(documents, path)

    def run(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batch, texts, path, lexicon):
            rows = [(i.astype("<u4").tobytes(), _encoder(path, lexicon).decode(i)) for i in ids]
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([doc, *columns], ["doc_id", "ids", "decoded"])

    return map_texts(documents, run, "doc_id BIGINT, ids BINARY, decoded STRING", work=("encode", path, lexicon))


def _encoded(batch: pa.RecordBatch, texts: Texts, path: str, lexicon: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for first, part in texts.runs():
        flat, bounds = _encoder(path, lexicon).encode(part)
        ids = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield batch.column("doc_id").slice(first, len(part)), ids


def digests(documents: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``."""
    encoded = encode(documents, path, lexicon)
    return encoded.selectExpr("doc_id", "octet_length(ids) div 4 as n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")
