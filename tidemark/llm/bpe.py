"""Byte-pair merges of many pre-tokens at once, as ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from tidemark.llm.text import Hasher, Texts, kept_for_work

NONE = np.iinfo(np.int32).max


def _steps(step: dict | None) -> list[dict]:
    """The steps of a normaliser or pre-tokeniser, sequences laid out."""
    if not step:
        return []
    inner = step.get("normalizers", step.get("pretokenizers"))
    return [step] if inner is None else [x for s in inner for x in _steps(s)]


# Latin letters beyond ASCII that are in normal form and have one lower-case letter.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


def plain_splitter(spec: dict) -> Callable[[list[str]], list[list[str] | None]]:
    """Pre-tokens, as text, of words of visible ASCII and Latin letters without special tokens.

    For such words the usual steps come down to lower case and one regular expression, as
    they are in normal form. A pre-token taken as a word gives itself. Any other word gets
    None, and so does every word if the file has other steps or added tokens of other kinds.
    """
    normal, split = _steps(spec["normalizer"]), _steps(spec["pre_tokenizer"])
    lower = any(s["type"] == "Lowercase" for s in normal)
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = all(s["type"] in ("NFC", "Lowercase") or s == blanks for s in normal) and [s["type"] for s in split] == ["Split", "ByteLevel"]
    if known:
        cut, level = split
        pattern = cut["pattern"].get("Regex", "\\p").replace(r"\p{L}", f"A-Za-z{LATIN}").replace(r"\p{N}", "0-9")
        known = cut["behavior"] == "Removed" and cut["invert"] and "\\p" not in pattern and "(?" not in pattern
        known = known and not level["add_prefix_space"] and not level["use_regex"]
    added = spec["added_tokens"]
    if not known or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return lambda words: [None] * len(words)
    find = re.compile(pattern).findall
    special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)").search

    plain = re.compile(f"[!-~{LATIN}]+").fullmatch

    def pieces(words: list[str]) -> list[list[str] | None]:
        fits = list(map(plain, words))
        if special("\n".join(words)):
            fits = [fit and not special(word) for fit, word in zip(fits, words, strict=True)]
        if lower:
            words = list(map(str.lower, words))
        return [find(word) if fit else None for fit, word in zip(fits, words, strict=True)]

    return pieces


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_ALPHABET = _byte_alphabet()


class Vocabulary:
    """Merges of a tokenizer file, with its own normaliser and pre-tokeniser.

    White space ends pre-tokens, so the encoding of a text is that of its
    white-space separated words, one after the other; words are the unit here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        odd = model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
        if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: only plain byte-pair vocabularies")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids = model["vocab"] | {t["content"]: t["id"] for t in added}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, number in self.ids.items():
            self.tokens[number] = token.encode()
        self.end = model["end_of_word_suffix"] or ""
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.plain = plain_splitter(spec)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right, made = (np.array([self.ids[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.ranks, self.made = (left << 20 | right)[order], order.astype(np.int32), made
        # Whether all merges of what a merge makes come after it.
        first_use = np.full(len(self.tokens), NONE)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        self.in_order = first_use[made] > np.arange(len(made))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def pieces(self, word: str) -> list[str | int]:
        """Pre-tokens of a word in the byte alphabet; special tokens as ids."""
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(word) if self.special else [word]):
            if k % 2:
                out.append(self.ids[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def all_pieces(self, words: list[bytes]) -> list[list[str | int]]:
        """``pieces`` of every word; those of plain words need no call of the library."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out = []
        for text, plain in zip(texts, self.plain(texts), strict=True):
            if plain is None:
                plain = self.pieces(text)
            elif not text.isascii():
                plain = [p.encode().decode("latin-1").translate(BYTE_ALPHABET) for p in plain]
            out.append(plain)
        return out

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of every pre-token, end to end, and their bounds.

        In a round every pre-token applies its pair of lowest rank, at all places
        from the left, or at the first place only if the result takes part in a
        merge of still lower rank.
        """
        symbols = np.array([self.ids[c] for p in pieces for c in (*p[:-1], p[-1] + self.end)], np.int32)
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(owner)])
            lowest = np.minimum.reduceat(rank, start)
            over = np.repeat(lowest == NONE, length)
            if over.any():
                done.append((symbols[over], owner[over]))
                going = ~over
                symbols, owner, rank = symbols[going], owner[going], rank[going]
                length, lowest = length[lowest != NONE], lowest[lowest != NONE]
            if not len(symbols):
                break
            hit = rank == np.repeat(lowest, length)
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            late = ~self.in_order[lowest]
            if late.any():
                first = np.cumsum(hit) - np.repeat(np.r_[0, np.cumsum(hit)][np.cumsum(length) - length], length) == 1
                hit &= first | ~np.repeat(late, length)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols = np.concatenate([s for s, _ in done] or [np.zeros(0, np.int32)])
        owner = np.concatenate([o for _, o in done] or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as packed 32-bit integers; pre-tokens that words share are merged once."""
        parts = self.all_pieces(words)
        known = {p: k for k, p in enumerate(dict.fromkeys(p for part in parts for p in part if isinstance(p, str)))}
        symbols, bounds = self.merged(list(known))
        packed, bounds = symbols.astype("<u4").tobytes(), (bounds * 4).tolist()
        ids = {p: packed[a:b] for p, a, b in zip(known, bounds[:-1], bounds[1:], strict=True)}
        return [b"".join(ids[p] if isinstance(p, str) else np.array(p, "<u4").tobytes() for p in part) for part in parts]

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Number of surviving symbols of every word."""
        parts = self.all_pieces(words)
        flat = [p for part in parts for p in part]
        known = {p: k for k, p in enumerate(dict.fromkeys(p for p in flat if isinstance(p, str)))}
        sizes = np.r_[np.diff(self.merged(list(known))[1]), 1]
        each = sizes[[known[p] if isinstance(p, str) else -1 for p in flat]] if flat else np.zeros(0, np.int64)
        return np.bincount(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), weights=each, minlength=len(parts)).astype(np.int64)


@kept_for_work
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


class Memo:
    """Results of words, kept between batches: up to ``limit`` new and as many older ones."""

    def __init__(self, fn: Callable[[list[bytes]], list], limit: int = 300_000):
        self.fn, self.limit, self.new, self.old = fn, limit, {}, {}

    def __call__(self, words: list[bytes]) -> list:
        if len(words) > self.limit:
            half = len(words) // 2
            return [*self(words[:half]), *self(words[half:])]
        if len(self.new) + len(words) > self.limit:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        absent = [k for k, x in enumerate(found) if x is None]
        for k in absent:
            found[k] = self.old.get(words[k])
        missing = [k for k in absent if found[k] is None]
        for k, made in zip(missing, self.fn([words[k] for k in missing]) if missing else [], strict=True):
            found[k] = made
        self.new.update((words[k], found[k]) for k in absent)
        return found


def distinct_words(texts: Texts) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the word and document of every occurrence."""
    starts, ends, owner = texts.words()
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), owner
    h = Hasher(texts.data).spans(starts, ends)
    which, _ = pd.factorize(h.view(np.int64))
    counts = np.bincount(which)
    first = np.empty(len(counts), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    data = texts.data.tobytes()
    words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, counts, which, owner
