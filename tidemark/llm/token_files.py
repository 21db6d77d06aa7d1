"""Token ids in Arrow files of equal-length sequences.

Every file holds fixed-size-list batches of ``ids`` and ``mask`` and, beside it,
a table of its documents. The mask is false on the padding at the end of a file.
Buffers are neither compressed nor of variable length, so sequence ``n`` of a
memory-mapped file is a view, without parsing or copying.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import shared_files
from tidemark.llm.bpe import Memo, distinct_words, plain_splitter
from tidemark.llm.text import Texts, prepare_arrow
from tidemark.session import materialize, scratch_path

# Words that one call of the library encodes; it bounds the memory of the call.
CALL_WORDS = 20_000


@dataclass(frozen=True)
class Layout:
    """Sequence length, sequences in a batch, and the id that ends a document."""

    length: int = 2048
    batch: int = 64
    end: int = 2

    def schema(self, vocabulary: int) -> pa.Schema:
        ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
        return pa.schema([("ids", pa.list_(ids, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()

    marks = [(t.content, n) for n, t in found.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.single_word or " " in t.content)]
    mark, number = marks[0] if marks else ("", -1)

    def alone(words: list[str]) -> list[bytes]:
        return [np.array(r.ids, "<u4").tobytes() for r in found.encode_batch_fast(words, add_special_tokens=False)]

    def together(words: list[str]) -> list[bytes]:
        """One call for all words, a special token between each two."""
        ids = np.array(found.encode_batch_fast([f" {mark} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == number)
        if len(ends) != len(words) - 1:  # a word yields the mark itself
            return alone(words)
        packed, starts = ids.tobytes(), [0, *(ends * 4 + 4).tolist()]
        return [packed[a:b] for a, b in zip(starts, [*(ends * 4).tolist(), len(packed)], strict=True)]

    def whole(texts: list[str]) -> list[bytes]:
        parts = [texts[k : k + CALL_WORDS] for k in range(0, len(texts), CALL_WORDS)]
        return [ids for part in parts for ids in (together(part) if mark else alone(part))]

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    size, suffix = found.get_vocab_size(with_added_tokens=True), spec["model"].get("end_of_word_suffix")
    is_end = np.zeros(size, bool)
    is_end[[n for token, n in found.get_vocab().items() if suffix and token.endswith(suffix)]] = True
    split = plain_splitter(spec) if suffix else lambda words: [None] * len(words)

    def joined(pieces: list[str]) -> list[bytes]:
        """One call for all pre-tokens; the last token of each tells its end."""
        out = []
        for part in (pieces[k : k + CALL_WORDS] for k in range(0, len(pieces), CALL_WORDS)):
            ids = np.array(found.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(is_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += whole(part)
                continue
            packed, ends = ids.tobytes(), [0, *(ends * 4).tolist()]
            out += [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    known = Memo(joined, 250_000)

    def encode(words: list[bytes]) -> list[bytes]:
        """Plain words by their pre-tokens, which many words share; the others whole."""
        texts = [w.decode("utf-8", "replace") for w in words]
        parts = split(texts)
        rest = iter(whole([t for t, part in zip(texts, parts, strict=True) if part is None]))
        pieces = list({p: None for part in parts if part for p in part})
        ids = dict(zip(pieces, known(pieces), strict=True))
        return [next(rest) if part is None else ids[part[0]] if len(part) == 1 else b"".join([ids[p] for p in part]) for part in parts]

    return Memo(encode, 500_000), size


def _encoded(path: str, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents end to end, and the number of each.

    White space ends the library's pre-tokens, so a text is encoded word by word,
    each distinct word once.
    """
    words, _, which, owner = distinct_words(texts)
    if not words:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    ids = _library(path)[0](words)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin, each = np.cumsum(sizes) - sizes, sizes[which]
    place = np.repeat(begin[which] - np.cumsum(each) + each, each) + np.arange(each.sum())
    return np.frombuffer(b"".join(ids), "<u4")[place], np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)


class _Writer:
    """One file of sequences, filled batch by batch."""

    def __init__(self, uri: str, layout: Layout, schema: pa.Schema):
        files, path = shared_files.store(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(path)
        self.out, self.layout, self.schema = pa.ipc.new_file(self.sink, schema), layout, schema
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.held, self.waiting, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        self.total += len(ids)
        size = self.layout.length * self.layout.batch
        if self.waiting >= size:
            flat = np.concatenate(self.held)
            for k in range(0, len(flat) - size + 1, size):
                self._write(flat[k : k + size], size)
            self.held = [flat[len(flat) // size * size :]]
            self.waiting = len(self.held[0])

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.layout.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        if len(flat):
            rows = -(-len(flat) // self.layout.length)
            self._write(np.pad(flat, (0, rows * self.layout.length - len(flat))), len(flat))
        self.out.close()
        self.sink.close()


def write_token_files(documents: DataFrame, path: str, layout: Layout = Layout()) -> tuple[DataFrame, str]:
    """Writes the ids of ``documents`` in ascending ``doc_id`` order.

    Returns the list of files (``file, part, n_ids``) and their folder. Each task
    writes files of its own name, and only listed files count, so lost or
    repeated tasks leave nothing behind that is read. Null ids come first,
    repeated ids in the order of their texts; a null text has only the end id.
    """
    spark = prepare_arrow(documents.sparkSession)
    folder = scratch_path(spark, "tokens")
    rows = documents.selectExpr("bigint(doc_id) as doc_id", "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, docs, sizes, part = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                uri = f"{folder}/{uuid.uuid4().hex}.arrow"
                writer = _Writer(uri, layout, layout.schema(_library(path)[1]))
                part = batch.column("part")[0].as_py()
            for first, texts in Texts.of(batch.column("text")).runs():
                flat, counts = _encoded(path, texts)
                ends = np.cumsum(counts + 1) - 1
                ids = np.full(len(flat) + len(counts), layout.end, np.uint32)
                inner = np.ones(len(ids), bool)
                inner[ends] = False
                ids[inner] = flat
                writer.add(ids)
                docs.append(batch.column("doc_id").slice(first, len(texts)))
                sizes.append(counts + 1)
        if writer is not None:
            writer.close()
            counts = np.concatenate(sizes)
            table = pa.table([pa.chunked_array(docs), pa.array(np.cumsum(counts) - counts), pa.array(counts)], ["doc_id", "first", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table, max_chunksize=100_000)
            shared_files.write(f"{uri}.docs", sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([writer.total])], ["file", "part", "n_ids"])

    return materialize(rows.mapInArrow(run, "file STRING, part INT, n_ids BIGINT"), "files"), folder


class TokenFile:
    """A file of sequences, memory-mapped where the folder is mounted."""

    def __init__(self, uri: str):
        self.file = shared_files.mapped(uri)
        self.reader = pa.ipc.open_file(self.file)
        self.batches = [self.reader.get_batch(k) for k in range(self.reader.num_record_batches)]
        self.length = self.reader.schema.field("ids").type.list_size
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``n``; the ids are a view of the file."""
        k = int(np.searchsorted(self.first, n, "right")) - 1
        at = (n - int(self.first[k])) * self.length
        ids, mask = (self.batches[k].column(c).values.slice(at, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start``, across sequences and batches."""
        parts = []
        while count:
            k = int(np.searchsorted(self.first * self.length, start, "right")) - 1
            at = start - int(self.first[k]) * self.length
            flat = self.batches[k].column("ids").values
            take = min(count, len(flat) - at)
            parts.append(flat.slice(at, take).to_numpy(zero_copy_only=True))
            start, count = start + take, count - take
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts the ids of all documents before it, over all files.
    """
    offset = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(files.select("file", offset.alias("offset")), "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                data = TokenFile(uri)
                for docs in pa.ipc.open_file(shared_files.mapped(f"{uri}.docs")).read_all().to_batches():
                    first, count = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(data.span(a, n).astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                    columns = [docs.column("doc_id"), pa.array(first + base), docs.column("n_tokens"), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)
