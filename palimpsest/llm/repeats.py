"""What the two substring dedups share: window runs, their text pass, and the removal.

A window is `length` consecutive units of one document. Each window has an anchor that its
content alone determines, so equal windows have equal anchors. Consecutive windows with one
anchor are a run; its span is what they cover. Runs with equal spans are settled at once; only
runs that share an anchor's key with a different span are looked at window by window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discarded, shared_folder, slices

RUNS = "doc_id long, lo long, hi long, key long, span long"
#: Bytes of text that are looked at together; arrays over their windows take about a hundred times as much.
SLICE = 1_000_000


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame, name: str, schema: str) -> tuple[DataFrame, str]:
    """df in the shared folder, read back, and the folder."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder), folder


def window_runs(rows: DataFrame, find: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> tuple[DataFrame, str]:
    """find: a slice -> (document in the slice, lo, hi, key, span), lo and hi as units of the document."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            doc, lo, hi, key, span = find(batch)
            ids = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lo), pa.array(hi), pa.array(key.view(np.int64)), pa.array(span.view(np.int64))], ["doc_id", "lo", "hi", "key", "span"])

    return written(rows.mapInArrow(run, RUNS), "runs", RUNS)


def consecutive(doc: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows of one document with one anchor."""
    if not len(at):
        return at, at
    new = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) != 1) | (np.diff(anchor) != 0)) + 1
    return np.concatenate(([0], new)), np.concatenate((new - 1, [len(at) - 1]))


def windows_at(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of `sizes` units in a row: each window's document, its first unit among all, and where documents begin."""
    starts = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + starts[doc], starts


def listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """A column of lists of structs: each item's row, and the items."""
    column = batch.column(batch.schema.get_field_index(name))
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    return np.repeat(np.arange(len(n)), n), column.flatten()


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, columns) -> (doc_id, items). A document's list is no longer than its text."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("items"))


def removed_units(batch: pa.RecordBatch, sizes: np.ndarray, name: str = "items") -> np.ndarray:
    """Units of a slice's documents in a row that the ranges in a column of lists cover."""
    starts = np.cumsum(sizes) - sizes
    row, items = listed(batch, name)
    cover = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(cover, items.field("lo").to_numpy(zero_copy_only=False) + starts[row], 1)
    np.add.at(cover, items.field("end").to_numpy(zero_copy_only=False) + starts[row], -1)
    return np.cumsum(cover)[:-1] > 0


def ranges_joined(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every document with the ranges to remove, null where there are none."""
    return texts.join(by_document(ranges, "lo", "end").hint("shuffle_hash"), "doc_id", "left")


#: Keys that are sent to every task at most; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def sharing(runs: DataFrame, folder: str, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs to remove at once, and those to look at, whose key is in shared: (key, whole), and least where it matters.

    Where a key has one span only (whole), its runs are repeats as they are, and go no further
    than this join: all of them, or with `least` those of larger doc_ids. Both results are
    written, as what follows reads them several times; all runs, in `folder`, are deleted then.
    """
    shared = checkpointed(shared)
    sent = F.broadcast if shared.count() <= BROADCAST_KEYS else lambda keys: keys
    place = ["doc_id", "lo", "hi"]
    looked = runs.join(sent(shared.filter("not whole").select("key")), "key", "left_semi").select(*place, "key", "span")
    if "least" in shared.columns:
        whole = runs.join(sent(shared.filter("whole").select("key", "least")), "key").filter("doc_id > least")
    else:
        whole = runs.join(sent(shared.filter("whole").select("key")), "key", "left_semi")
    none = F.lit(None).cast("long")
    out, _ = written(looked.unionByName(whole.select(*place, none.alias("key"), none.alias("span"))), "shared-runs", RUNS)
    discarded(runs.sparkSession, folder)
    return out.filter("key is null").select(place), out.filter("key is not null")
