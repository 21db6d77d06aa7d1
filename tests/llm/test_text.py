import re

import numpy as np
import pyarrow as pa

from tidemark.llm.text import Hasher, Texts

ODD = ["", None, " \t\n", "a", "a b  c", "é x\x0b\x0cy", "x" * 5000, "  z", "end "]


def test_words_are_those_of_the_pattern():
    texts = Texts.of(pa.array(ODD, pa.string()).slice(1))
    starts, ends, owner = texts.words()
    found = [(int(o), texts.data[a:b].tobytes().decode()) for a, b, o in zip(starts, ends, owner, strict=True)]
    assert found == [(k, w) for k, t in enumerate(ODD[1:]) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_runs_hold_every_document_once():
    texts = Texts.of(pa.array(ODD))
    runs = list(texts.runs(10))
    assert sum(len(r) for _, r in runs) == len(ODD)
    assert b"".join(r.data.tobytes() for _, r in runs) == texts.data.tobytes()
    assert [first for first, _ in runs] == np.cumsum([0, *(len(r) for _, r in runs)])[:-1].tolist()


def test_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"abcab-abc", np.uint8)
    h = Hasher(data)
    a, b, c = h.spans(np.array([0, 6, 3]), np.array([3, 9, 5]))
    assert a == b != c
    assert h.windows(3)[0] == h.windows(3)[6]
