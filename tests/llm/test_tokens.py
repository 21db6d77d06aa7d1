import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, shared_files, token_counts, token_files, transducer
from tidemark.llm.bpe import Memo, plain_splitter, vocabulary
from tidemark.llm.text import map_texts

RNG = random.Random(1)
ODD = [
    None, "", " ", "a b", "The cat's I'LL \n\t it's", "İstanbul ΣΑΣ ς", "x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "é x́",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234 ½ ² ٣", "日本語テスト 한국어", "👍🏽👨‍👩‍👧", "\x00\x1c\x85 　 z", "!" * 3000, "ab" * 2000, " ",
    "".join(chr(RNG.randrange(32, 0x2FF)) for _ in range(3000)), "".join(RNG.choice("abcdeinthr '") for _ in range(20_000)), "가 ᅡ",
]
ROWS = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "a b"), (3, "a b"), (-5, "minus")]


@pytest.fixture(scope="module")
def library(vocabulary_path):
    return Tokenizer.from_file(vocabulary_path)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(documents, library, vocabulary_path):
    rows = token_counts.count_tokens(documents(ROWS), vocabulary_path, limit=1500).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = [(str(i), len((t or "").encode()), n := len(ids_of(library, t)), n > 1500) for i, t in ROWS]
    assert got == sorted(want)
    assert token_counts.count_tokens(documents(ROWS).limit(0), vocabulary_path).count() == 0


def test_encoding_and_decoding_match_the_library(documents, library, vocabulary_path):
    rows = transducer.encode(documents(ROWS), vocabulary_path).collect()
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows)
    want = [(str(i), x := ids_of(library, t), library.decode(x, skip_special_tokens=False)) for i, t in ROWS]
    assert got == sorted(want)
    rows = transducer.digests(documents(ROWS[:9]), vocabulary_path).collect()
    assert all(r.ids_sha256 == hashlib.sha256(np.array(ids_of(library, ODD[r.doc_id]), "<u4").tobytes()).hexdigest() for r in rows)


def test_empty_corpus_has_an_empty_lexicon(documents, vocabulary_path):
    assert transducer.encode(documents(ROWS).limit(0), vocabulary_path).count() == 0
    assert transducer.encode(documents([(1, None)]), vocabulary_path).first().decoded == ""


def test_lexicon_knows_its_words_only():
    words = sorted({"".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 7))).encode() for _ in range(300)})
    entries = {w: np.array([k, k + 1][: k % 3], "<u4").tobytes() for k, w in enumerate(words)}
    lexicon = transducer.Lexicon(pa.py_buffer(transducer.compile_lexicon(entries)))
    probes = [*words, b"", b"zzz", *(w + b"a" for w in words), *(w[:-1] for w in words)]
    for word, rank in zip(probes, lexicon.ranks(probes).tolist(), strict=True):
        assert (rank >= 0) == (word in entries)
        if rank >= 0:
            assert lexicon.get(np.array([rank])) == [entries[word]]


def test_suffixes_are_shared():
    words = [f"{a}{b}ing".encode() for a in "abcdef" for b in "uvwxyz"]
    lexicon = transducer.Lexicon(pa.py_buffer(transducer.compile_lexicon({w: b"\1\0\0\0" for w in words})))
    assert len(lexicon.finals) == 6 and (lexicon.ranks(words) >= 0).all()


def test_lowest_pair_waits_where_its_result_merges_earlier(vocabulary_path):
    plain = vocabulary(vocabulary_path)
    pieces = ["inthe", "a", "ananan", "banana", "x" * 40]
    fast, bounds = plain.merged(pieces)
    plain_flags, plain.in_order = plain.in_order, np.zeros_like(plain.in_order)
    slow, slow_bounds = plain.merged(pieces)
    plain.in_order = plain_flags
    assert fast.tolist() == slow.tolist() and bounds.tolist() == slow_bounds.tolist()


def test_memo_stays_bounded():
    memo = Memo(lambda words: [len(w) for w in words], limit=5)
    for k in range(20):
        words = [b"x" * (k + j) for j in range(4)]
        assert memo(words) == [k + j for j in range(4)] and len(memo.new) + len(memo.old) <= 10
    assert memo([b"y" * j for j in range(9)]) == list(range(9)) and len(memo.new) + len(memo.old) <= 10


@pytest.mark.parametrize("layout", [token_files.Layout(8, 4), token_files.Layout()])
def test_files_give_back_every_id(documents, library, vocabulary_path, layout):
    files, _ = token_files.write_token_files(documents(ROWS), vocabulary_path, layout)
    rows = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (i, t) in zip(rows, ordered, strict=True):
        ids = np.array([*ids_of(library, t), layout.end], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sequences_are_views_of_equal_length(documents, library, vocabulary_path):
    layout = token_files.Layout(16, 2)
    files, _ = token_files.write_token_files(documents(ROWS).coalesce(1), vocabulary_path, layout)
    total = 0
    for row in files.collect():
        data = token_files.TokenFile(row.file)
        sequences = [data[k] for k in range(len(data))]
        assert all(len(ids) == len(mask) == 16 and ids.dtype == np.uint16 for ids, mask in sequences)
        assert sum(int(mask.sum()) for _, mask in sequences) == row.n_ids
        assert not any(ids.flags.owndata for ids, _ in sequences)
        assert (data.span(0, row.n_ids) == np.concatenate([ids[mask] for ids, mask in sequences])).all()
        total += row.n_ids
    assert total == sum(len(ids_of(library, t)) + 1 for _, t in ROWS)


def test_no_documents_no_files(documents, vocabulary_path):
    files, _ = token_files.write_token_files(documents(ROWS).limit(0), vocabulary_path)
    assert files.count() == 0 and token_files.read_token_files(files).count() == 0


def test_shared_files_round_trip(tmp_path):
    shared_files.write(f"file://{tmp_path}/deep/x.bin", b"abc")
    assert shared_files.mapped(f"{tmp_path}/deep/x.bin").read() == b"abc"


def test_lexicon_words_are_those_above_a_count(documents):
    from tidemark.llm import transducer

    rows = [(1, "a a a a b b b c c c d d e once"), (2, "a b a"), (3, None)]
    assert transducer.frequent_words(documents(rows), 10) == [b"a", b"b", b"c", b"d"]
    assert transducer.frequent_words(documents(rows), 3) == [b"a", b"b", b"c"]
    assert transducer.frequent_words(documents(rows), 2) == [b"a", b"b"] and transducer.frequent_words(documents(rows), 0) == []
    assert transducer.frequent_words(documents([(1, "x y " * 5000 + "z " * 1025)]), 2) == [b"x", b"y"]


def test_memo_keeps_results_over_its_limit():
    calls = []

    def fn(words):
        calls.extend(words)
        return [w * 2 for w in words]

    memo = Memo(fn, limit=4)
    for words in ([b"a", b"b", b"c"], [b"b", b"d"], [b"a", b"c"], [b"e", b"f", b"g", b"h", b"i"]):
        assert memo(words) == [w * 2 for w in words]
    assert calls.count(b"b") == calls.count(b"a") == 1


def test_library_words_in_one_call_equal_single_ones(library, vocabulary_path):
    texts = [w for t in ODD if t for w in t.split()]
    words = list(dict.fromkeys(w.encode() for t in texts for w in t.split()))
    plain = [w for w in words if b"<|startoftext|>" not in w]
    encode = token_files._library(vocabulary_path)[0]
    for given in (plain, words, plain[:1]):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode.fn(given)]
        assert got == [ids_of(library, w.decode()) for w in given]


PLAIN = [
    "Cat's", "I'LL", "''s", "don't.", "x-y_z", "A1b22", "!?#", "\u00c4rger", "\u0158\u00ed\u010dn\u00ed,", "\u0178o'd", "<|", "\u017d1\u017e",
    *(chr(k) for k in [*range(0x21, 0x7F), *range(0xC0, 0x180)] if k not in (0xD7, 0xF7, 0x130)),
]
OTHER = ["", "\u0130x", "x\u0301", "a\u00d7b", "\u00aa", "x\u00a0y", "<|endoftext|>", "a<|endoftext|>", "\u65e5", "\x7f", "a\x1cb", "\u03a3", "\u0181", "\u01c5"]


def test_plain_words_are_split_as_the_library_does(library, vocabulary_path):
    ours = vocabulary(vocabulary_path)
    for word, found in zip(PLAIN, ours.all_pieces([w.encode() for w in PLAIN]), strict=True):
        assert found == ours.pieces(word) == [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(word))], word
        parts = ours.plain([word])[0]
        assert parts and ours.plain(parts) == [[p] for p in parts]
        assert sum((ids_of(library, p) for p in parts), []) == ids_of(library, word)
    assert ours.plain([*OTHER, "a.", *OTHER]) == [*[None] * len(OTHER), ["a", "."], *[None] * len(OTHER)]
    texts = [w.encode() for w in [*PLAIN, *OTHER[1:], *PLAIN]]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files._library(vocabulary_path)[0](texts)] == [ids_of(library, w.decode()) for w in texts]


def test_other_steps_leave_all_words_to_the_library(vocabulary_path):
    spec = json.loads(Path(vocabulary_path).read_text(encoding="utf-8"))
    assert plain_splitter(spec)(["a.b"]) == [["a", ".", "b"]]
    level = spec["pre_tokenizer"]["pretokenizers"][1]
    for change in (
        {"normalizer": {"type": "StripAccents"}}, {"pre_tokenizer": level}, {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [spec["pre_tokenizer"]["pretokenizers"][0], level | {"add_prefix_space": True}]}},
        {"added_tokens": [spec["added_tokens"][0] | {"normalized": True}]},
    ):
        assert plain_splitter(spec | change)(["a.b"]) == [None]


def test_workers_drop_the_vocabulary_when_other_work_begins(documents, vocabulary_path):
    """A stage after the encoder has the memory of its Python workers for itself."""

    def held(batch, texts):
        kept = transducer._encoder.cache_info().currsize + bpe.vocabulary.cache_info().currsize
        yield pa.RecordBatch.from_arrays([pa.array([kept])], ["kept"])

    rows = documents([(k, f"some words {k}") for k in range(30)])
    assert transducer.encode(rows, vocabulary_path).count() == 30
    assert {r.kept for r in map_texts(rows, held, "kept BIGINT").collect()} == {0}
    # Tasks of the same work find what the tasks before them have built.
    work = ("test", vocabulary_path)

    def built(batch, texts):
        before = bpe.vocabulary.cache_info().currsize
        bpe.vocabulary(vocabulary_path)
        yield pa.RecordBatch.from_arrays([pa.array([before])], ["before"])

    again = map_texts(rows.repartition(40, "doc_id"), built, "before BIGINT", work=work)
    assert {r.before for r in again.collect()} >= {1}
