"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector and rising thresholds t_0 < t_1 < t_2.
Features say which words and word beginnings of four and five letters a document has (hashed),
so that a longer text isn't more toxic for being long, and those that tell toxic from clean
rows of the sample are kept.

Labels say only toxic or not. Grades come from them: clean is 0; toxic rows are graded 1 to 3
by thirds of how many different marker words (found almost only in toxic rows) they have. A
document is rejected from the P(grade > 0) on that errs least on the sample, a clean row
rejected counting as ten toxic rows kept.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, slices, texts, words_of

#: Most labelled rows that a model is fitted on, chosen by a hash of doc_id.
SAMPLE_ROWS = 12_000
GRADES, FEATURES, HASH_MASK = 4, 4000, (1 << 22) - 1
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def features_of(word: str) -> list[int]:
    """Hashed features of a word between white space: itself, and its first four and five letters."""
    w = _NOT_LETTERS.sub("", word).lower()
    if not w:
        return []
    out = [zlib.crc32(w.encode()) & HASH_MASK]
    for n in (4, 5):
        if len(w) > n:
            out.append(zlib.crc32(f"{n} {w[:n]}".encode()) & HASH_MASK)
    return out


def present(text: pa.Array, wanted: dict[int, int] | None = None, width: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) of a slice's distinct features, and each document's words."""
    offsets, flat = words_of(text)
    codes, distinct = coded(flat)
    table = np.full((len(distinct), 3), -1, np.int64)
    for i, word in enumerate(distinct.to_pylist()):
        for j, f in enumerate(features_of(word)):
            table[i, j] = f if wanted is None else wanted.get(f, -1)
    used = np.flatnonzero((table >= 0).any(1)[codes]) if len(codes) else codes
    doc = np.searchsorted(offsets, used, side="right") - 1
    found = table[codes[used]]
    keys = (doc[:, None] * width + found)[found >= 0]
    keys = np.unique(keys)
    return keys // width, keys % width, np.diff(offsets)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = 0.5

    def severity(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P(grade > k) per document and k, and the expected severity."""
        wanted = {int(f): i for i, f in enumerate(self.features)}
        doc, f, words = present(text, wanted, max(1, len(wanted)))
        score = np.bincount(doc, self.weights[f], len(words)) if len(doc) else np.zeros(len(words))
        above = sigmoid(score[:, None] - self.thresholds)
        return above, above.sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """Features of at most `rows` labelled documents; null ids, labels and texts are left out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches):
        for batch in slices(batches, "text"):
            doc, f, words = present(texts(batch, "text"))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            cut = [f[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary()), pa.array(words)], ["doc_id", "toxic", "f", "words"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna().join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    found = rows_.mapInArrow(run, "doc_id long, toxic int, f binary, words long").collect()
    return sorted(found, key=lambda r: (r["doc_id"], bytes(r["f"])))


def fit(rows: list, features: int = FEATURES, steps: int = 400, ridge: float = 3e-5) -> Model:
    """Fit on the rows of sample(); the same rows give the same model. Without rows of both kinds nothing is toxic."""
    toxic = np.array([r["toxic"] > 0 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    parts = [np.frombuffer(r["f"], "<u4") for r in rows]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    held = np.zeros((2, HASH_MASK + 1), np.int32)  # clean and toxic rows that have each feature
    for f, t in zip(parts, toxic, strict=True):
        held[int(t), f] += 1
    ids = np.flatnonzero(held.sum(0) >= 4)
    d0, d1 = held[0, ids], held[1, ids]
    del held
    p = (d1 + d0) / (n1 + n0)
    z = (d1 / n1 - d0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    markers = np.zeros(HASH_MASK + 1, bool)
    markers[ids[(z > 5) & (d1 > 20 * (d0 + 0.5) * n1 / n0)]] = True
    marks = np.array([markers[f].sum() for f in parts])
    cuts = np.quantile(marks[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, marks, side="left"), 0)
    best = np.argsort(-np.abs(z), kind="stable")[:features]
    best = np.sort(ids[best[np.abs(z[best]) > 5]])
    place = np.full(HASH_MASK + 1, -1, np.int32)
    place[best] = np.arange(len(best))
    kept = [place[f] for f in parts]
    kept = [k[k >= 0] for k in kept]
    doc, f = np.repeat(np.arange(len(rows)), [len(k) for k in kept]), np.concatenate(kept)
    above = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    # thresholds: the first, and the logarithms of the gaps, so that they stay in order
    w, t = np.zeros(len(best)), np.array([2.0, 0.0, 0.0])
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        th = np.array([t[0], t[0] + gaps[0], t[0] + gaps.sum()])
        score = np.bincount(doc, w[f], len(rows))
        error = (sigmoid(score[:, None] - th) - above) / len(rows)
        gw = np.bincount(f, error.sum(1)[doc], len(w)) + ridge * w
        gth = -error.sum(0)
        gt = np.array([gth.sum(), gaps[0] * (gth[1] + gth[2]), gaps[1] * gth[2]])
        g = np.concatenate((gw, gt))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:-3], t - move[-3:]
    gaps = np.exp(t[1:])
    p_toxic = sigmoid(np.bincount(doc, w[f], len(rows)) - t[0])
    cost = {c: int((toxic & (p_toxic < c)).sum() + 10 * (~toxic & (p_toxic >= c)).sum()) for c in np.linspace(0.5, 0.05, 46)}
    return Model(best, w, np.array([t[0], t[0] + gaps[0], t[0] + gaps.sum()]), float(min(cost, key=cost.get)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(sample(docs, labels, rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float | None = None) -> DataFrame:
    """One row per input row: doc_id, severity (expected, 0 to 3), grade (likeliest), p_toxic, toxic.

    Severity orders texts by how much of what marks toxic rows they have; the labels hold no
    grades, so nothing else says what it should be.
    Null text counts as empty, which is clean unless the sample's empty texts weren't. Whole
    texts are read. Null and repeated doc_ids are kept; other columns are not read.
    """

    reject_at = model.reject_at if reject_at is None else reject_at

    def run(batches):
        for batch in slices(batches, "text"):
            above, severity = model.severity(texts(batch, "text"))
            each = np.diff(-above, axis=1, prepend=-1.0, append=0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(each.argmax(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= reject_at)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade long, p_toxic double, toxic boolean")


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose P(grade > 0) is below reject_at."""

    reject_at = model.reject_at if reject_at is None else reject_at

    def run(batches):
        for batch in slices(batches, text_col):
            above, _ = model.severity(texts(batch, text_col))
            yield batch.filter(pa.array(above[:, 0] < reject_at))

    return docs.mapInArrow(run, docs.schema)
