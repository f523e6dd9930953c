"""BPE as a deterministic automaton over tokens, compiled by successive merge gadgets.

The automaton reads token sequences and accepts those that the merges produce. It starts with
one state that every base symbol loops on. The gadget of merge (u, v) adds an arc for uv
wherever an arc u is followed by an arc v, leading where that v leads, and sends every arc u to
a copy of its target that has lost its arc v. All arcs of one label lead to one state, so the
compiled tables hold, for each label, the state it leads to, and for each state its parent, the
label it lost and when. What a state has lost is what it and its ancestors lost; an arc uv
exists where u's arc existed when uv was made and still did after that gadget.

A word's tokens are the one accepted path that spells it, and what comes before a token on that
path is the one accepted path of its own letters. So a prefix of a word determines the state
that it leads to, and reading a word is a table of transitions from prefix to prefix: the token
that ends a prefix is the only one whose arc leaves the state of what comes before it. Nothing
is taken back, and a word of n letters takes n times the longest token's length at most.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .tokens import TOKEN_SLICE, Remembered, word_ids

NEVER = 1 << 60
_COMPILED: dict[str, MergeAutomaton] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        names = self.vocab | self.special
        self.labels = [""] * (max(names.values()) + 1)
        for s, i in names.items():
            self.labels[i] = s
        self.longest = max(map(len, self.vocab))
        self.compile([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.arcs: dict[int, bool] = {}
        self.itself: dict[int, bool] = {}

    def compile(self, merges: list[tuple[str, str]]) -> None:
        n = len(self.labels)
        self.target = [0] * n  # label -> the state its arcs lead to
        self.parent, self.lost, self.made = [-1], [-1], [-1]  # of each state
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.gadget: dict[int, int] = {}  # label u * n + lost label v -> when
        self.n = n
        for k, (a, b) in enumerate(merges):
            u, v, w = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.born[w] < 0:
                self.left[w], self.right[w], self.born[w] = u, v, k
                self.target[w] = self.target[v]
            self.parent.append(self.target[u])
            self.lost.append(v)
            self.made.append(k)
            self.target[u] = len(self.parent) - 1
            self.gadget.setdefault(u * n + v, k)

    def arc(self, before: int, label: int, upto: int = NEVER) -> bool:
        """Whether the state that `before` leads to has an arc `label`, after all gadgets before `upto`.

        Its ancestors are the states that `before` led to since it was made, then those its
        right part led to before that, and so on.
        """
        n, gadget = self.n, self.gadget
        a, until = before, upto
        while a >= 0:
            x, by = label, upto
            while x >= 0:
                k = gadget.get(a * n + x)
                if k is not None and k < until and k <= by:
                    return False
                x, by = self.left[x], self.born[x]
            a, until = self.right[a], self.born[a]
        return True

    def spells_itself(self, label: int) -> bool:
        """Whether a label is what the merges make of its own letters: its parts are, and their arcs met when it was made."""
        known = self.itself.get(label)
        if known is None:
            u, v = self.left[label], self.right[label]
            known = self.itself[label] = u < 0 or (self.spells_itself(u) and self.spells_itself(v) and self.arc(u, v, self.born[label]))
        return known

    def step(self, before: int, label: int) -> bool:
        """The transition table, filled as it is used: whether `label` may follow `before`, or begin a word (-1)."""
        key = before * self.n + label
        ok = self.arcs.get(key)
        if ok is None:
            if len(self.arcs) > 1_000_000:
                self.arcs.clear()
            ok = self.arcs[key] = self.spells_itself(label) and (before < 0 or self.arc(before, label))
        return ok

    def encode_word(self, word: str) -> list[int]:
        """The accepted path that spells a pre-split word (of byte symbols)."""
        vocab, step, size, longest = self.vocab, self.step, len(word), self.longest
        whole = vocab.get(word + self.suffix)
        if whole is not None and step(-1, whole):
            return [whole]
        # of each prefix the token that ends it and where that begins; none where no path spells the prefix
        last, start = [-1] * (size + 1), [0] * (size + 1)
        for j in range(1, size + 1):
            end = self.suffix if j == size else ""
            for i in range(max(0, j - longest), j):
                if i and last[i] < 0:
                    continue
                t = vocab.get(word[i:j] + end)
                if t is not None and step(last[i], t):
                    last[j], start[j] = t, i
                    break
        if last[size] < 0:
            raise ValueError(f"no path spells {word!r}")
        path, j = [], size
        while j:
            path.append(last[j])
            j = start[j]
        return path[::-1]

    def pre_split(self, text: str) -> list[str | int]:
        """Words of byte symbols; ids of special tokens."""
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
            else:
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            for word in self.split.findall(part):
                out.append(word if word.isascii() else "".join(self.symbols[b] for b in word.encode()))
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.pre_split(text):
            out += [word] if isinstance(word, int) else self.encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by spaces, as a vocabulary without a decoder is read back."""
        return " ".join(self.labels[i] for i in ids)


def compiled(path: str) -> MergeAutomaton:
    if path not in _COMPILED:
        _COMPILED[path] = MergeAutomaton(path)
    return _COMPILED[path]


_WORDS: dict[str, Remembered] = {}


def encoder(path: str) -> Remembered:
    if path not in _WORDS:
        automaton = compiled(path)
        own = automaton.symbols

        def words(strings: list[str]) -> list[list[int]]:
            return [automaton.encode_word(w if w.isascii() else "".join(own[b] for b in w.encode())) for w in strings]

        _WORDS[path] = Remembered(words, lambda strings: [automaton.encode(s) for s in strings], True)
    return _WORDS[path]


def joined(ids: np.ndarray, at: np.ndarray, labels: pa.Array) -> pa.Array:
    """Per document the labels of its ids, joined by spaces."""
    parts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), labels.take(pa.array(ids)))
    return pc.binary_join(parts, " ")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Encode whole texts by the automaton and decode the ids again.

    With digests: doc_id, n_tokens, ids_sha256, decoded_sha256; else doc_id, ids, decoded. Null
    or empty text gives no ids and an empty string. Null and repeated ids are kept as they are.
    """
    import hashlib

    def run(batches):
        automaton, encode = compiled(tokenizer), encoder(tokenizer)
        labels = pa.array(automaton.labels, pa.string())
        numbers = pa.array([str(i) for i in range(len(automaton.labels))], pa.string())
        for batch in slices(batches, "text", TOKEN_SLICE):
            at, ids = word_ids(texts(batch, "text"), encode)
            decoded = joined(ids, at, labels)
            if digests:
                hashed = [[hashlib.sha256(s.as_buffer() or b"").hexdigest() for s in column] for column in (joined(ids, at, numbers), decoded)]
                arrays = [batch.column(0), pa.array(np.diff(at)), *map(pa.array, hashed)]
            else:
                arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), decoded.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
