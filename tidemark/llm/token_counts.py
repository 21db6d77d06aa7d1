"""Token counts by rank-synchronous merging of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import Memo, distinct_words, vocabulary
from tidemark.llm.text import Texts, kept_for_work, map_texts, prepare_arrow


@kept_for_work
def _counter(path: str) -> Memo:
    return Memo(vocabulary(path).count_words)


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``documents``.

    Counts are those of the tokenizer file at ``path``, a place every executor
    has. A null text counts as empty, with no bytes and tokens; special tokens
    written out in a text count as one. Rows keep their id, null or repeated;
    other columns are not looked at.
    """
    prepare_arrow(documents.sparkSession)

    def run(batch: pa.RecordBatch, texts: Texts) -> Iterator[pa.RecordBatch]:
        for first, part in texts.runs():
            words, _, which, owner = distinct_words(part)
            each = np.array(_counter(path)(words), np.int64)
            tokens = np.bincount(owner, weights=each[which], minlength=len(part)).astype(np.int64)
            ids = batch.column("doc_id").slice(first, len(part))
            columns = [ids, pa.array(part.lengths), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN"
    return map_texts(documents.selectExpr("bigint(doc_id) as doc_id", "text"), run, schema, work=("count_tokens", path))
