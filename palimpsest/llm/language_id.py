"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression.

A text is the set of its letter n-grams of one to SPECTRUM letters: words in lower case, with
what isn't a letter between them as one space. The blended-spectrum presence kernel of two
texts is how many n-grams both have, over the root of the product of how many each has.
N-grams are hashed to WIDTH places, so a text of any length is one line of WIDTH bits.

Training rows give landmarks of every language. A text's kernel values with the landmarks,
turned by the inverse root of the landmarks' own kernel matrix, are its features; one ridge
regression for each language against the rest is solved on the features of the other training rows.
Scoring is two matrix products a batch: bits by landmarks, kernel values by coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, slices, texts

SPECTRUM, WIDTH = 3, 1 << 14
#: Most landmarks and training rows of a model, all languages together, and most languages that it learns (the most frequent).
LANDMARKS, TRAINING_ROWS, LANGUAGES = 128, 3000, 256
#: Texts that are one matrix, and code points of a text that are looked at together.
ROWS, PIECE = 256, 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(before: np.ndarray, text: str, ends: bool) -> np.ndarray:
    """Letters of a piece of text after `before`, which is folded, with single zeros between words and, where it `ends`, at the end."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.concatenate((before, points, np.zeros(int(ends), np.uint32)))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def grams(points: np.ndarray, spectrum: int = SPECTRUM, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Places of all n-grams of folded code points; those that hold nothing but a space don't count."""
    h = np.zeros(len(points), np.uint64)
    for n in range(1, spectrum + 1):
        if len(points) < n:
            return
        h = mixed(h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :].astype(np.uint64) + np.uint64(n))
        some = h if n > 1 else h[points != 0]
        yield (some & np.uint64(width - 1)).astype(np.int64)


def presence(text: pa.Array, spectrum: int = SPECTRUM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(bits, lettered): a line of uint8 bits for each text, and whether it has a letter. Long texts are read in pieces, each after the end of the one before."""
    bits, lettered = np.zeros((len(text), width), np.uint8), np.zeros(len(text), bool)
    for i, t in enumerate(text.to_pylist()):
        before = np.zeros(1, np.uint32)
        for lo in range(0, len(t), PIECE):
            points = folded(before, t[lo : lo + PIECE], lo + PIECE >= len(t))
            for at in grams(points, spectrum, width):
                bits[i, at] = 1
            lettered[i] |= bool(points.any())
            before = points[len(points) - spectrum + 1 :] if len(points) >= spectrum else points
    return bits, lettered


def kernel(bits: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of lines of bits with the landmarks' bits (as floats, a column each)."""
    shared = bits.astype(np.float32) @ marks  # whole numbers below 2**24, exact in any order
    return shared / np.sqrt(np.maximum(bits.sum(1, dtype=np.int64), 1)[:, None] * np.maximum(sizes, 1.0))


@dataclass(frozen=True)
class Model:
    """Landmarks as packed bits, how many each has, coefficients (landmark by language) and the languages."""

    packed: np.ndarray
    sizes: np.ndarray
    coefficients: np.ndarray
    languages: tuple[str, ...]
    spectrum: int = SPECTRUM
    width: int = WIDTH

    def marks(self) -> np.ndarray:
        return np.ascontiguousarray(np.unpackbits(self.packed, axis=1, count=self.width).T, dtype=np.float32)

    def outputs(self, text: pa.Array, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest outputs of each text, 0 to 1, and whether it has a letter."""
        bits, lettered = presence(text, self.spectrum, self.width)
        return np.clip(kernel(bits, marks, self.sizes) @ self.coefficients, 0, 1), lettered


def fit(packed: np.ndarray, lang: list[str], landmark: np.ndarray, ridge: float = 1e-3, spectrum: int = SPECTRUM, width: int = WIDTH) -> Model:
    """The model of training rows given as packed bits; `landmark` says which of them are landmarks. The same rows give the same model. Without rows it knows no language."""
    languages = tuple(sorted(set(lang)))
    if not languages:
        return Model(np.zeros((0, width // 8), np.uint8), np.zeros(0), np.zeros((0, 0)), (), spectrum, width)
    marks = packed[landmark]
    sizes = np.unpackbits(marks, axis=1, count=width).sum(1, dtype=np.int64).astype(np.float64)
    columns = np.ascontiguousarray(np.unpackbits(marks, axis=1, count=width).T, dtype=np.float32)
    k = np.concatenate([kernel(np.unpackbits(packed[i : i + ROWS], axis=1, count=width), columns, sizes) for i in range(0, len(packed), ROWS)])
    values, vectors = np.linalg.eigh(k[landmark].astype(np.float64))
    # directions that the landmarks hardly span would only carry noise
    real = values > values.max() * 1e-6
    root = vectors[:, real] / np.sqrt(values[real])
    features = k @ root
    wanted = (np.array(lang)[:, None] == np.array(languages)).astype(np.float64)
    each = len(lang) / np.maximum(wanted.sum(0), 1)  # every language weighs as much as any other
    weight = (wanted @ each / len(languages))[:, None]
    solved = np.linalg.solve(features.T @ (features * weight) + ridge * len(lang) * np.eye(features.shape[1]), features.T @ (wanted * weight))
    return Model(marks, sizes, root @ solved, languages, spectrum, width)


def training_rows(docs: DataFrame, learned: Column, id_col: str, text_col: str, lang_col: str, rows: int, landmarks: int, languages: int) -> DataFrame:
    """(lang, h, text, k): a sample of at most `rows` distinct texts, alike many of each of the most frequent languages; those of k <= landmarks per language come first by hash.

    How many rows a language has is counted first; its rows then pass by hash at a rate that
    leaves about twice what is wanted, so that no language's rows meet in one place.
    """
    c = F.col
    given = docs.filter(learned & c(lang_col).isNotNull()).select(c(lang_col).cast("string").alias("lang"), c(text_col).cast("string").alias("text")).filter(c("text").rlike("\\p{L}"))
    counts = docs.filter(learned & c(lang_col).isNotNull()).groupBy(c(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages)
    counts = counts.withColumn("quota", F.ceil(F.lit(rows) / F.count(F.lit(1)).over(Window.partitionBy())))
    rate = F.least(F.lit(1.0), F.greatest(2 * c("quota"), F.lit(200)) / c("count"))
    h = F.xxhash64("text")
    passing = given.join(F.broadcast(counts.withColumn("rate", rate)), "lang").filter(F.pmod(h, F.lit(1 << 30)) < c("rate") * (1 << 30))
    distinct = passing.groupBy("lang", h.alias("h")).agg(F.min("text").alias("text"), F.first("quota").alias("quota"))
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(c("k") <= c("quota"))
    return ranked.withColumn("landmark", c("k") <= F.greatest(F.lit(2), F.floor(c("quota") * landmarks / rows))).select("lang", "h", "text", "landmark")


def train(
    docs: DataFrame, learned: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS, landmarks: int = LANDMARKS, languages: int = LANGUAGES, spectrum: int = SPECTRUM, width: int = WIDTH
) -> Model:
    """A model of the rows that `learned` holds for (all, without it) and that have a language and a letter. Bits of the sample, `rows` times `width` at most, come to the driver."""

    def run(batches):
        for batch in slices(batches, "text"):
            text = texts(batch, "text")
            for lo in range(0, len(text), ROWS):
                bits, _ = presence(text.slice(lo, ROWS), spectrum, width)
                part = batch.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], ["lang", "h", "landmark", "bits"])

    sample = training_rows(docs, F.lit(True) if learned is None else learned, id_col, text_col, lang_col, rows, landmarks, languages)
    found = sample.mapInArrow(run, "lang string, h long, landmark boolean, bits binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    packed = np.frombuffer(b"".join(found["bits"].to_pylist()), np.uint8).reshape(-1, width // 8)
    return fit(packed, found["lang"].to_pylist(), np.asarray(found["landmark"], dtype=bool), spectrum=spectrum, width=width)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    The language of the greatest output, the first by name of equal ones; score is that output's share of
    all outputs. A null text, one without a letter, and any text where the model knows
    no language is `und` with score 0. Only the text is read, whole, whatever its length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches):
        own = sent.value
        marks = own.marks()
        for batch in slices(batches, "text"):
            text = texts(batch, "text")
            for lo in range(0, len(text), ROWS):
                part = text.slice(lo, ROWS)
                best, score = np.full(len(part), len(own.languages)), np.zeros(len(part))
                if own.languages:
                    out, lettered = own.outputs(part, marks)
                    first = out.argmax(1)
                    share = out[np.arange(len(part)), first] / np.maximum(out.sum(1), 1e-12)
                    best, score = np.where(lettered, first, best), np.where(lettered, share, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, ROWS), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of an id as text modulo `folds`; 0 for a row without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions for all rows of a model that has learned from those of folds 1 to 4: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs, fold() != 0)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
