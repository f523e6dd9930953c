"""Token ids of whole texts, one encoding for each distinct piece of a slice.

Both public vocabularies cut texts at white space before merging, so a text's ids are those of
its white-space pieces in a row. Arrow finds the distinct pieces of a slice; only those are
encoded, and NumPy puts the ids in place.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import coded, words_of

#: Words whose ids a Python worker remembers between slices.
REMEMBERED = 500_000
#: Bytes of text in a slice that is encoded at once.
TOKEN_SLICE = 16_000_000

Ids = tuple[np.ndarray, np.ndarray]
_LOADED: dict[str, object] = {}


def library_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, once in each process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LOADED[path] = tokenizer
    return _LOADED[path]


class Remembered:
    """Ids of many strings, with a memory of the words in them.

    Most pieces are a run of letters, perhaps after a space, and then ASCII punctuation. Any
    pre-tokenizer here cuts between the two, so their ids are those of the parts in a row, and
    the parts are few. `words` encodes a list of distinct letter runs, `others` any strings.
    """

    PIECE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, words: Callable[[list[str]], list[list[int]]], others: Callable[[list[str]], list[list[int]]], lower: bool):
        self.words, self.others, self.lower = words, others, lower
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    @staticmethod
    def packed(found: list[list[int]]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in found]

    def __call__(self, strings: list[str]) -> Ids:
        known, marks, match, lower = self.known, self.marks, self.PIECE.fullmatch, self.lower
        cores: list[str | None] = []
        ends: list[str] = []
        odd: list[int] = []
        for i, s in enumerate(strings):
            m = match(s)
            if m is None:
                odd.append(i)
                cores.append(None)
                ends.append("")
                continue
            core, end = m.groups()
            cores.append(core.lower() if lower else core)
            ends.append(end)
        new = [c for c in dict.fromkeys(cores) if c is not None and c not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = [c for c in dict.fromkeys(cores) if c is not None]
        if new:
            known.update(zip(new, self.packed(self.words(new)), strict=True))
        if unmet := [e for e in dict.fromkeys(ends) if e not in marks]:
            if len(marks) > 10_000:
                marks.clear()
                marks[""] = b""
                unmet = [e for e in dict.fromkeys(ends) if e]
            marks.update(zip(unmet, self.packed(self.others(unmet)), strict=True))
        parts = [known[c] + marks[e] if c is not None else b"" for c, e in zip(cores, ends, strict=True)]
        if odd:
            for i, ids in zip(odd, self.packed(self.others([strings[i] for i in odd])), strict=True):
                parts[i] = ids
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return lengths, np.frombuffer(b"".join(parts), "<u4")


def library_encoder(path: str) -> Remembered:
    """An encoder by the tokenizers library. Letter runs are encoded many to a text and told apart by their first or last ids."""
    key = f"encoder {path}"
    if key not in _LOADED:
        tokenizer = library_tokenizer(path)
        suffix = tokenizer.model.end_of_word_suffix
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(i) or "" for i in range(size)]
        edge = np.array([n.endswith(suffix) if suffix else n.startswith("\u0120") for n in names])

        def others(strings: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

        def words(strings: list[str]) -> list[list[int]]:
            spaced = strings if suffix else [s for s in strings if s[0] == " "]
            out: dict[str, list[int]] = {}
            for i in range(0, len(spaced), 2000):
                some = spaced[i : i + 2000]
                ids = tokenizer.encode((" " if suffix else "").join(some), add_special_tokens=False).ids
                at = np.flatnonzero(edge[ids])
                cuts = [0, *(at + 1).tolist()] if suffix else [*at.tolist(), len(ids)]
                assert len(cuts) == len(some) + 1
                for s, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                    out[s] = ids[a:b]
            if len(spaced) < len(strings):
                bare = [s for s in strings if s[0] != " "]
                out |= zip(bare, others(bare), strict=True)
            return [out[s] for s in strings]

        _LOADED[key] = Remembered(words, others, bool(suffix))
    return _LOADED[key]


def spread(lengths: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> Ids:
    """Ids of pieces `codes` in a row, and how many each has."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at += np.repeat(starts[codes] - (ends - n), n)
    return n, flat[at]


def bounds(offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each document's ids begin, and the end."""
    return np.concatenate(([0], np.cumsum(n)))[offsets]


def word_ids(text: pa.Array, encode: Callable[[list[str]], Ids]) -> Ids:
    """(bounds, ids) for a vocabulary that drops white space: pieces are words between ASCII white space."""
    offsets, flat = words_of(text)
    codes, distinct = coded(flat)
    n, ids = spread(*encode(distinct.to_pylist()), codes)
    return bounds(offsets, n), ids


#: A space inside a run of white space other than its last character, or a special token: such texts are encoded whole.
UNEVEN = r"[\s\x0b\x{85}\p{Z}] ([\s\x0b\x{85}\p{Z}]|\z)|<\|endoftext\|>"


def spaced_ids(text: pa.Array, encode: Callable[[list[str]], Ids]) -> Ids:
    """(bounds, ids) for a byte-level vocabulary whose pieces keep the space before them.

    A text is cut before each single space, which is where its pre-tokenizer cuts too.
    """
    whole = np.asarray(pc.match_substring_regex(text, UNEVEN), dtype=bool)
    cut = pc.if_else(pa.array(whole), pa.scalar("", text.type), text)
    split = pc.split_pattern(cut, " ")
    offsets, flat = np.asarray(split.offsets, dtype=np.int64), split.flatten()
    offsets = offsets - offsets[0]
    codes, distinct = coded(flat)
    strings = distinct.to_pylist()
    # a document's first part has no space before it; texts that are encoded whole are further pieces
    first = offsets[:-1][np.diff(offsets) > 0]
    firsts, place = np.unique(codes[first], return_inverse=True)
    alone = text.filter(pa.array(whole)).to_pylist()
    lengths, ids = encode([" " + s for s in strings] + [strings[i] for i in firsts])
    codes[first] = len(strings) + place
    if alone:
        more_n, more = encode(alone)
        at = offsets[:-1][whole]
        codes[at] = len(lengths) + np.arange(len(alone))
        lengths, ids = np.concatenate((lengths, more_n)), np.concatenate((ids, more))
    n, ids = spread(lengths, ids, codes)
    return bounds(offsets, n), ids

