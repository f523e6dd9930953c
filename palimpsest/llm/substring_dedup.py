"""Substring dedup of words by recompression.

Rounds of recompression replace runs of one symbol by a symbol for the run, and then pairs of a
left and a right symbol by a symbol for the pair; a hash of the symbol says which side it is
on. Names are hashes of what they stand for, so every partition gives equal parts of texts
equal names without exchanging any. Each symbol carries the range of words that its parsing
looked at. Symbols whose range lies in a window are the same wherever that window occurs: the
least of those of the highest round is the window's anchor. Shared symbols reveal repeats, and
spans of words, and windows where spans differ, verify them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, by_row, coded, mixed, slices, string_hashes, texts, words_of
from .repeats import SLICE, by_document, consecutive, listed, ranges_joined, removed_units, rows_of, sharing, window_runs, windows_at

WINDOW, ROUNDS = 50, 3


class Parse:
    """Symbols of one round over documents in a row; ranges outside a document mark what its end decided."""

    def __init__(self, sym, start, low, high, doc):
        self.sym, self.start, self.low, self.high, self.doc = sym, start, low, high, doc


def neighbour_ranges(p: Parse, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low of the symbol before and high of the symbol after, or just outside the document."""
    n = len(p.sym)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = p.doc[1:] != p.doc[:-1]
    last[:-1] = first[1:]
    before = np.where(first, begins[p.doc] - 1, np.concatenate(([0], p.low[:-1])))
    after = np.where(last, ends[p.doc] + 1, np.concatenate((p.high[1:], [0])))
    return before, after


def compressed(p: Parse, round_: int, begins: np.ndarray, ends: np.ndarray) -> Parse:
    n = len(p.sym)
    if not n:
        return p
    # runs
    new = np.ones(n, bool)
    new[1:] = (p.sym[1:] != p.sym[:-1]) | (p.doc[1:] != p.doc[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [n])) - 1
    length = tail - head + 1
    before, after = neighbour_ranges(p, begins, ends)
    sym = np.where(length > 1, mixed(p.sym[head] + mixed(length.astype(np.uint64) + np.uint64(round_ << 40))), p.sym[head])
    p = Parse(sym, p.start[head], before[head], after[tail], p.doc[head])
    # pairs
    n = len(p.sym)
    right = mixed(p.sym ^ np.uint64(0xA5A5 + round_)) >> np.uint64(63) == 1
    pair = np.zeros(n, bool)
    pair[:-1] = ~right[:-1] & right[1:] & (p.doc[1:] == p.doc[:-1])
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    before, after = neighbour_ranges(p, begins, ends)
    nxt = np.concatenate((np.arange(1, n), [n - 1]))
    low = np.where(right, before, p.low)
    high = np.where(pair, p.high[nxt], np.where(right, p.high, after))
    sym = np.where(pair, mixed(mixed(p.sym + np.uint64(round_)) + p.sym[nxt]), p.sym)
    keep = ~second
    return Parse(sym[keep], p.start[keep], low[keep], high[keep], p.doc[keep])


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each non-empty range."""
    out = np.zeros(len(lo), values.dtype)
    k = np.frexp((hi - lo).astype(float))[1] - 1
    table, width = values, 1
    for level in range(int(k.max()) + 1 if len(k) else 0):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def anchors(h: np.ndarray, sizes: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, lo, hi (words of the document), key, span."""
    doc, at, begins = windows_at(sizes, window)
    n, ends = len(h), begins + sizes
    units = np.arange(n)
    levels = [Parse(h, units, units, units + 1, np.repeat(np.arange(len(sizes)), sizes))]
    for r in range(1, rounds + 1):
        levels.append(compressed(levels[-1], r, begins, ends))
    chosen_level, chosen = np.full(len(at), -1), np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    bits = np.uint64(max(1, n).bit_length())
    for level in range(rounds, -1, -1):
        p = levels[level]
        if not len(open_):
            break
        # symbols with low < s, and with high <= s + window; both rise along the text
        lo = np.cumsum(np.bincount(p.low + 1, minlength=n + 3))[at[open_]]
        hi = np.cumsum(np.bincount(p.high, minlength=n + window + 3))[at[open_] + window]
        some = hi > lo
        if some.any():
            rank = (mixed(p.sym ^ np.uint64(77)) >> bits << bits) | np.arange(len(p.sym), dtype=np.uint64)
            best = least_in(rank, lo[some], hi[some]) & ((np.uint64(1) << bits) - np.uint64(1))
            chosen_level[open_[some]], chosen[open_[some]] = level, best.astype(np.int64)
        open_ = open_[~some]
    first, last = consecutive(doc, at, chosen_level * (n + 1) + chosen)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    level, index = chosen_level[first], chosen[first]
    low, high, start = (np.zeros(len(first), np.int64) for _ in range(3))
    for j, p in enumerate(levels):
        own = level == j
        low[own], high[own], start[own] = p.low[index[own]], p.high[index[own]], p.start[index[own]]
    key = mixed(RangeHash(h, 1).of(low, high) ^ mixed((level * 1000 + start - low).astype(np.uint64)))
    a, b = at[first], at[last]
    span = mixed(RangeHash(h, 2).of(a, b + window) ^ mixed((start - a).astype(np.uint64)))
    return doc[first], a - begins[doc[first]], b - begins[doc[first]], key, span


def repeated_ranges(rows: DataFrame, text_rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc_id, lo, end): words covered by a window that also starts in a document with a smaller doc_id."""

    def find(batch):
        offsets, flat = words_of(texts(batch, "text"))
        codes, distinct = coded(flat)
        return anchors(string_hashes(distinct)[codes], np.diff(offsets), window, rounds)

    runs, folder = window_runs(rows, find)
    runs = runs.filter(F.col("doc_id").isNotNull())
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), (F.min("span") == F.max("span")).alias("whole"))
    whole, runs = sharing(runs, folder, shared.filter("least < last").select("key", "whole", "least"))
    spans = runs.groupBy("key", "span").agg(F.min("doc_id").alias("first"))
    # by way of its key, so that the join of runs has exchanges of its own, which can be split where a span is frequent
    several = spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans"))
    judged = runs.join(spans.join(several, "key"), ["key", "span"])
    settled = whole.unionByName(judged.filter("doc_id > first").select("doc_id", "lo", "hi")).select("doc_id", "lo", (F.col("hi") + window).alias("end"))
    unclear = judged.filter("doc_id = first and spans > 1").select("doc_id", "lo", "hi", "key")

    def windows(batches):
        for batch in slices(batches, "text", SLICE):
            offsets, flat = words_of(texts(batch, "text"))
            codes, distinct = coded(flat)
            row, items = listed(batch, "items")
            lo, hi = (items.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            n = hi - lo + 1
            which = np.repeat(np.arange(len(lo)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            first = at + offsets[:-1][row[which]]
            w = RangeHash(string_hashes(distinct)[codes], 3).of(first, first + window)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row[which])), pa.array(at), items.field("key").take(pa.array(which)), pa.array(w.view(np.int64))], ["doc_id", "at", "key", "w"])

    looked = text_rows.join(by_document(unclear, "lo", "hi", "key").hint("shuffle_hash"), "doc_id").mapInArrow(windows, "doc_id long, at long, key long, w long")
    firsts = looked.groupBy("key", "w").agg(F.min("doc_id").alias("first"))
    found = looked.join(firsts, ["key", "w"]).filter("doc_id > first").select("doc_id", F.col("at").alias("lo"), (F.col("at") + window).alias("end"))
    return settled.unionByName(found)


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words joined by one space.

    Words are runs without ASCII white space, unchanged. A word goes when a window of `window`
    consecutive words covers it whose words also start in a document with a smaller doc_id, as
    the input has them. Null or empty texts have no words; null doc_ids lose nothing and take
    nothing away; rows that repeat a doc_id are documents in the order of their texts' digests. Other
    columns are not read.
    """
    return by_row(rows_of(docs, id_col, text_col), lambda rows: cleaned(rows, window, rounds, with_text))


def cleaned(rows: DataFrame, window: int, rounds: int, with_text: bool) -> DataFrame:
    """remove_repeats of (doc_id, text) whose ids, nulls apart, don't repeat."""
    text_rows = rows.repartition("doc_id")
    ranges = repeated_ranges(rows, text_rows, window, rounds)

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            offsets, flat = words_of(texts(batch, "text"))
            sizes = np.diff(offsets)
            kept = ~removed_units(batch, sizes)
            at = np.concatenate(([0], np.cumsum(kept)))[offsets]
            joined = pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(at), flat.filter(pa.array(kept))).cast(pa.list_(pa.string())), " ")
            hashed = [hashlib.sha256(s.as_buffer() or b"").hexdigest() for s in joined]
            arrays = [batch.column(0), pa.array(sizes), pa.array(sizes - np.diff(at)), pa.array(hashed), *[joined] * with_text]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return ranges_joined(text_rows, ranges).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns in place, with the repeated words gone from the text.

    A text that loses nothing stays as it is, white space included; one that loses words becomes
    the kept words joined by one space, and size_col, if docs has it, their code points. A
    document that loses all its words is left out.
    """
    rows = rows_of(docs, id_col, text_col)
    whole = docs.withColumn("__repeats_id", F.col(id_col).cast("long")).repartition("__repeats_id")
    text_rows = whole.select(F.col("__repeats_id").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(rows, text_rows, window, rounds).groupBy(F.col("doc_id").alias("__repeats_key")).agg(F.collect_list(F.struct("lo", "end")).alias("__repeats"))
    joined = whole.join(ranges.hint("shuffle_hash"), F.col("__repeats_id") == F.col("__repeats_key"), "left").drop("__repeats_id", "__repeats_key")
    names = docs.columns

    def run(batches):
        for batch in slices(batches, text_col, SLICE):
            offsets, flat = words_of(texts(batch, text_col))
            sizes = np.diff(offsets)
            kept = ~removed_units(batch, sizes, "__repeats")
            at = np.concatenate(([0], np.cumsum(kept)))[offsets]
            left = np.diff(at)
            strings = pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(at), flat.filter(pa.array(kept))).cast(pa.list_(pa.string())), " ")
            out = batch.select(names)
            old = out.column(names.index(text_col))
            new = pa.compute.if_else(pa.array(left < sizes), strings, old.cast(pa.string())).cast(old.type)
            columns = list(out.columns)
            columns[names.index(text_col)] = new
            if size_col in names:
                size = columns[names.index(size_col)]
                columns[names.index(size_col)] = pa.compute.if_else(pa.array(left < sizes), pa.compute.utf8_length(strings).cast(size.type), size)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array((left > 0) | (sizes == 0)))

    return joined.mapInArrow(run, docs.schema)
