"""Suffix-array dedup of bytes by run-length indexes.

Windows of `length` bytes are dealt by the least hash of the byte strings of length GRAM in
them, so all places of one window get one key. What shares a key is indexed together: the
run-length Burrows-Wheeler transform of the distinct spans, with the suffix samples at both
ends of each run. The samples' common prefixes with their neighbours, streamed along the text,
give each position's matching statistic: its longest match elsewhere. Positions whose
statistic reaches `length` begin a window that occurs again.

Spans that occur several times as a whole are settled before, and enter an index once. An
index holds MANY distinct spans of a key at most: a key with more, such as a phrase of
boilerplate, is dealt again by a longer gram, which parts what only shares the shorter one, and
so on, up to the window itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, by_row, checkpointed, mixed, slices, texts
from .repeats import SLICE, by_document, consecutive, listed, ranges_joined, removed_units, rows_of, sharing, window_runs, windows_at

#: A gram of half the window: what shares less than that shares no key.
LENGTH, GRAM = 200, 100
#: Distinct spans of a key that are indexed together, and bytes of spans in one index.
MANY, BLOCK_BYTES = 256, 400_000
#: Each deal leaves a gram shorter than the window by a quarter of what it was before.
NARROWER = 4
#: Ids of documents that are sent to every task at most, where few texts are looked at.
BROADCAST_IDS = 2_000_000
_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64))


def bytes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice's texts, and each document's number of bytes."""
    column = texts(batch, "text")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    table, covered = values, 1
    while covered * 2 <= width:
        table = np.minimum(table[:-covered], table[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(table[: len(table) - rest], table[rest:]) if rest else table


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, lo, hi (bytes of the document), key, span."""
    doc, at, begins = windows_at(sizes, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    h, n = _BYTE_HASHES[data], len(data)
    grams = RangeHash(h, 4).of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = np.uint64(n.bit_length())
    rank = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = least_of_next(rank, length - gram + 1)
    anchor = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first, last = consecutive(doc, at, anchor)
    a, b, q = at[first], at[last], anchor[first]
    span = mixed(RangeHash(h, 5).of(a, b + length) ^ mixed((q - a).astype(np.uint64)))
    return doc[first], a - begins[doc[first]], b - begins[doc[first]], grams[q], span


class RunLengthIndex:
    """The run-compressed transform of spans in a row, with suffix samples at run ends."""

    def __init__(self, spans: list[bytes]):
        sizes = np.array([len(s) for s in spans], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(spans), np.uint8).astype(np.int64) + len(spans)
        text[ends] = np.arange(len(spans))  # a separator of its own after each span
        self.text, self.ends, self.sizes, self.n = text, ends, sizes, n
        order, rank = np.argsort(text, kind="stable"), np.zeros(n, np.int64)
        step = 1
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(text[order]) != 0)))
        while rank[order[-1]] < n - 1:
            after = np.concatenate((rank[step:], np.full(min(step, n), -1)))[:n]
            keys = rank * (n + 1) + after + 1
            order = np.argsort(keys, kind="stable")
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(keys[order]) != 0)))
            step *= 2
        before = text[order - 1]
        heads = np.concatenate(([0], np.flatnonzero(np.diff(before) != 0) + 1))
        tails = np.concatenate((heads[1:], [n])) - 1
        #: run characters, run starts, and the suffixes at each run's two ends with those next to them
        self.chars, self.heads = before[heads], heads
        self.head_suffix, self.above = order[heads], order[np.maximum(heads - 1, 0)]
        self.tail_suffix, self.below = order[tails], order[np.minimum(tails + 1, n - 1)]

    def common(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffixes x and y, `most` at most."""
        text, n = self.text, self.n
        out, open_ = np.zeros(len(x), np.int64), np.flatnonzero(x != y)
        for i in range(most):
            if not len(open_):
                break
            p, q = x[open_] + i, y[open_] + i
            same = (p < n) & (q < n)
            same &= text[np.minimum(p, n - 1)] == text[np.minimum(q, n - 1)]
            open_ = open_[same]
            out[open_] += 1
        return out

    def statistics(self, most: int) -> np.ndarray:
        """For each position the longest match elsewhere, where it is below `most`; at least `most` otherwise.

        Along the text a suffix's common prefix with its neighbour shrinks by one a position
        until the next sample, on either side.
        """
        out = np.zeros(self.n, np.int64)
        for suffix, other in ((self.head_suffix, self.above), (self.tail_suffix, self.below)):
            # a sampled value may exceed `most`, and is then streamed on by whole spans
            value = self.common(suffix, other, int(self.sizes.max()) + 1)
            reach = np.full(self.n, -1, np.int64)
            reach[suffix] = suffix + value
            seen = np.maximum.accumulate(np.where(reach >= 0, np.arange(self.n), -1))
            streamed = np.where(seen >= 0, reach[np.maximum(seen, 0)] - np.arange(self.n), 0)
            out = np.maximum(out, streamed)
        return out

    def repeated_starts(self, length: int) -> list[np.ndarray]:
        """Of each span, the positions whose next `length` bytes occur elsewhere."""
        hit = self.statistics(length) >= length
        begins = self.ends - self.sizes
        return [np.flatnonzero(hit[a:b]) for a, b in zip(begins.tolist(), self.ends.tolist(), strict=True)]


def ranges_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Consecutive starts as (lo, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(s[0]), int(s[-1]) + length) for s in np.split(starts, cut)]


FOUND = "doc_id long, lo long, end long"


def indexed(spans: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, lo, unclear, raw) -> ranges of unclear spans that occur in another span of the key."""

    def matched(held):
        out = []
        index = RunLengthIndex([h[3] for h in held])
        for (doc, lo, unclear, _), starts in zip(held, index.repeated_starts(length), strict=True):
            if unclear:
                out += [(doc, lo + a, lo + b) for a, b in ranges_of(starts, length)]
        return out

    def run(batches):
        held, size, last, out = [], 0, None, []
        for batch in batches:
            for key, doc, lo, unclear, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != last and size >= BLOCK_BYTES:
                    out += matched(held)
                    held, size = [], 0
                held.append((doc, lo, unclear, raw))
                size, last = size + len(raw), key
            if len(out) > 10_000:
                yield columns(out)
                out = []
        if held:
            out += matched(held)
        yield columns(out)

    def columns(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc_id", "lo", "end"])

    return spans.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def cut_spans(looked: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            data, sizes = bytes_of(batch)
            begins = np.cumsum(sizes) - sizes
            row, items = listed(batch, "items")
            lo, hi = (items.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            raw, first = data.tobytes(), begins[row] + lo
            cut = [raw[a:b] for a, b in zip(first.tolist(), (first + hi - lo + length).tolist(), strict=True)]
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([items.field("key"), ids, pa.array(lo), items.field("unclear"), pa.array(cut, pa.binary())], ["key", "doc_id", "lo", "unclear", "raw"])

    return looked.mapInArrow(run, "key long, doc_id long, lo long, unclear boolean, raw binary")


def dealt_again(spans: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, doc_id, lo, unclear, raw) -> their windows' runs by the least gram of another length: (doc_id, lo, hi, key, span, unclear, raw)."""

    def run(batches):
        for batch in slices(batches, "raw", SLICE):
            raws = batch.column(4).to_pylist()
            sizes = np.array([len(x) for x in raws], np.int64)
            which, lo, hi, key, span = anchors(np.frombuffer(b"".join(raws), np.uint8), sizes, length, gram)
            take, base = pa.array(which), np.asarray(batch.column(2))[which]
            cut = [raws[i][a : b + length] for i, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            arrays = [batch.column(1).take(take), pa.array(lo + base), pa.array(hi + base), pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), batch.column(3).take(take), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lo", "hi", "key", "span", "unclear", "raw"])

    return spans.mapInArrow(run, "doc_id long, lo long, hi long, key long, span long, unclear boolean, raw binary")


def judged(runs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Of runs (doc_id, lo, hi, key, span, unclear): those unclear ones whose span occurs again as a whole, and one place of each span to look at.

    A span is looked at where its key has several and one of them, unclear, occurs once. The
    places are (key, doc_id, lo, hi, unclear, many, more).
    """
    place = F.struct("doc_id", "lo", "hi", "unclear", *more)
    spans = checkpointed(runs.groupBy("key", "span").agg(F.count(F.lit(1)).alias("places"), F.min(place).alias("place")))
    alone = (F.col("places") == 1) & F.col("place.unclear")
    keys = checkpointed(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans"), F.max(alone).alias("alone")).filter("spans > 1 and alone").select("key", "spans"))
    one = spans.join(keys, "key").select("key", "place.doc_id", "place.lo", "place.hi", alone.alias("unclear"), (F.col("spans") > MANY).alias("many"), *(f"place.{c}" for c in more))
    again = runs.filter("unclear").join(spans.filter("places > 1").select("key", "span"), ["key", "span"], "left_semi").select("doc_id", "lo", "hi")
    return again, one


def crowded(places: DataFrame, rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, lo, end) of unclear spans under keys of more than MANY spans, dealt again until no key has as many."""
    lists = checkpointed(by_document(places, "key", "lo", "hi", "unclear"))
    # so few ids are sent to every task, which spares shuffling all texts
    ids = lists.select("doc_id")
    texts_ = rows.join(F.broadcast(ids) if lists.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    spans, found = cut_spans(texts_.join(lists, "doc_id").select("doc_id", "text", "items"), length), []
    gap = length - gram
    while gap:
        gap //= NARROWER
        runs = checkpointed(dealt_again(spans, length, length - gap))
        if runs.isEmpty():
            break
        again, one = judged(runs, "raw")
        one = checkpointed(one)
        raw = one.select("key", "doc_id", "lo", "unclear", "raw", "many")
        found += [again.select("doc_id", "lo", (F.col("hi") + length).alias("end")), indexed(raw.filter("not many").drop("many"), length)]
        spans = raw.filter("many").drop("many")
    out = rows.sparkSession.createDataFrame([], FOUND)
    for part in found:
        out = out.unionByName(part)
    return out


def repeated_ranges(rows: DataFrame, text_rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, lo, end): bytes covered by a string of `length` bytes that starts somewhere else too."""
    runs, folder = window_runs(rows, lambda batch: anchors(*bytes_of(batch), length, gram))
    runs = runs.filter(F.col("doc_id").isNotNull())
    shared = runs.groupBy("key").agg(F.count(F.lit(1)).alias("places"), (F.min("span") == F.max("span")).alias("whole")).filter("places > 1")
    whole, runs = sharing(runs, folder, shared.select("key", "whole"))
    again, one = judged(runs.withColumn("unclear", F.lit(True)))
    settled = whole.unionByName(again).select("doc_id", "lo", (F.col("hi") + length).alias("end"))
    lists = by_document(one.filter("not many"), "key", "lo", "hi", "unclear")
    few = text_rows.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "items")
    return settled.unionByName(indexed(cut_spans(few, length), length)).unionByName(crowded(one.filter("many"), rows, length, gram))


def remove_long_matches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes kept.

    A byte of the UTF-8 text goes when a string of `length` bytes covers it that starts anywhere
    else too, in this document or another; matches do not cross documents, and count on the
    input as it is. Null text counts as empty; null doc_ids lose nothing and take nothing away; a row that
    repeats a doc_id is another place. Other columns are not read.
    """
    return by_row(rows_of(docs, id_col, text_col), lambda rows: cleaned(rows, length, gram, with_text))


def cleaned(rows: DataFrame, length: int, gram: int, with_text: bool) -> DataFrame:
    """remove_long_matches of (doc_id, text) whose ids, nulls apart, don't repeat."""
    text_rows = rows.repartition("doc_id")
    ranges = repeated_ranges(rows, text_rows, length, gram)

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            data, sizes = bytes_of(batch)
            gone = removed_units(batch, sizes)
            ends = np.cumsum(sizes)
            at = np.concatenate(([0], np.cumsum(~gone)))
            begins_run = gone.copy()
            begins_run[1:] &= ~gone[:-1]
            begins_run[(ends - sizes)[sizes > 0]] = gone[(ends - sizes)[sizes > 0]]
            spans = np.concatenate(([0], np.cumsum(begins_run)))
            kept = memoryview(data[~gone].tobytes())
            cut = [kept[a:b] for a, b in zip(at[ends - sizes].tolist(), at[ends].tolist(), strict=True)]
            arrays = [batch.column(0), pa.array(sizes), pa.array(sizes - (at[ends] - at[ends - sizes])), pa.array(spans[ends] - spans[ends - sizes]), pa.array([hashlib.sha256(c).hexdigest() for c in cut])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array([c.tobytes() for c in cut], pa.binary())] * with_text, [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return ranges_joined(text_rows, ranges).mapInArrow(run, schema)
