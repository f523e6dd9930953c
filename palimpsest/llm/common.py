"""Helpers that the corpus operators share: checkpoints, hashing, Arrow word tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed, discarded, shared_folder  # noqa: F401

#: Bytes of text that one Arrow slice holds in a Python worker.
SLICE_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def repeated(docs: DataFrame) -> bool:
    """Whether some doc_id has several rows; nulls don't count."""
    return not docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def numbered(docs: DataFrame, *order: Column) -> DataFrame:
    """docs with a number for each row as doc_id, in the order of doc_id, then of `order`; the old one is __own_id, and rows without one have no number."""
    folder = shared_folder(docs.sparkSession, "numbered")
    ordered = docs.withColumn("__own_id", F.col("doc_id")).withColumn("__place", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("__own_id"), *order, "__place")
    # sorted partitions are in order, and so are these numbers; once written they stay
    ordered.drop("__place").withColumn("doc_id", F.when(F.col("__own_id").isNotNull(), F.monotonically_increasing_id())).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def by_row(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], *ids: str) -> DataFrame:
    """stage(rows), which takes doc_id for a key. Where ids repeat, rows are numbered before, in the order of ids and texts, and the ids in the result named back."""
    if not repeated(rows):
        return stage(rows)
    given = numbered(rows, F.sha2("text", 256))
    out = stage(given.drop("__own_id"))
    names = given.filter("__own_id is not null").select("doc_id", "__own_id")
    for c in ("doc_id", *ids):
        own = names.select(F.col("doc_id").alias("__number"), F.col("__own_id").alias("__own"))
        out = out.join(own, out[c] == F.col("__number"), "left").withColumn(c, F.col("__own")).select(out.columns)
    return out


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what a large slice took would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
            give_back()


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column, null as empty, copied to buffers of its own (some string kernels misread slices)."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))), "")


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+`: where each document's begin (one more than documents), and all words."""
    split = pc.ascii_split_whitespace(text)
    flat, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.not_equal(flat, ""), dtype=bool)
    if not real.all():
        kept = np.concatenate(([0], np.cumsum(real)))
        offsets, flat = kept[offsets], flat.filter(pa.array(real))
    return offsets, flat


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the distinct words, and the distinct words."""
    if not len(flat):
        return np.zeros(0, np.int64), pa.array([], flat.type)
    encoded = flat.dictionary_encode()
    return np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def string_hashes(values: pa.Array) -> np.ndarray:
    """64 bits of each string, alike on every machine."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int, of: int) -> np.ndarray:
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """Hashes of any range of an array of 64-bit symbols, from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        base = mixed(np.array([BASE + 2 * seed], np.uint64))[0] | np.uint64(1)
        self.down = powers(len(symbols), pow(int(base), -1, 1 << 64))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers(len(symbols), int(base))[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + mixed((hi - lo).astype(np.uint64)))
