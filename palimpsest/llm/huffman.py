"""Token files: canonical length-limited Huffman codes, in blocks that decode by themselves.

A file set is a folder with two Parquet parts that Spark writes. `header` has the code lengths
of all ids. `blocks` has one row for each block: its range partition and number, the documents'
ids and lengths, the coded bits, and the bit offset of every SEGMENT-th id. Blocks hold whole
documents in ascending id order; any block decodes without the others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, shared_folder, slices, texts  # noqa: F401
from .tokens import TOKEN_SLICE, library_encoder, library_tokenizer, word_ids

LIMIT, SEGMENT, BLOCK_IDS = 18, 256, 1_000_000
BLOCKS = "part int, block int, n_ids long, doc_ids binary, doc_lengths binary, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((leaves, pairs))
        at = np.argsort(merged, kind="stable")
        row, is_leaf = merged[at], at < len(leaves)
    levels.append(is_leaf)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for flags in reversed(levels):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max()) if len(used) else 0
    left = np.cumsum(np.concatenate(([0], (1 << (top - lengths[order].astype(np.int64)))[:-1]))) if len(used) else used
    codes[order] = (left >> (top - lengths[order].astype(np.int64))).astype(np.uint64)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[bytes, np.ndarray]:
    """The codes of ids in a row, first bit highest, and the bit offset of every segment-th id."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(n.sum())
    word, inside = at >> 5, at & 31
    window = codes[ids] << (64 - n - inside).astype(np.uint64)
    size = (total >> 5) + 2
    high = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::segment].astype("<u8")


class Decoder:
    """Looks up LIMIT bits at a time; all segments of a block advance together."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max()) if len(lengths) else 1)
        codes = canonical_codes(lengths)
        self.symbol, self.length = np.zeros(1 << self.top, np.uint32), np.ones(1 << self.top, np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = 1 << (self.top - lengths[order].astype(np.int64))
        filled = int(width.sum())
        self.symbol[:filled], self.length[:filled] = np.repeat(order, width), np.repeat(lengths[order].astype(np.int64), width)
        assert not len(order) or codes[order[0]] == 0

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((segment, len(at)), np.uint32)
        mask = np.uint32((1 << self.top) - 1)
        last = len(windows) - 1
        for step in range(min(segment, n)):
            w = (windows[np.minimum(at >> 3, last)] >> (32 - self.top - (at & 7)).astype(np.uint32)) & mask
            out[step] = self.symbol[w]
            at += self.length[w]
        return out.T.reshape(-1)[:n]


RAW = "part int, block int, doc_ids binary, doc_lengths binary, raw binary"


def raw_blocks(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids in ascending doc_id order, in blocks of whole documents."""

    def run(batches):
        encode, part = library_encoder(tokenizer), TaskContext.get().partitionId()
        block, held, keys, sizes, n = 0, [], [], [], 0

        def made():
            row = [[part], [block], *([np.concatenate(x).astype(kind).tobytes()] for x, kind in ((keys, "<i8"), (sizes, "<u8"), (held, "<u4")))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], [x.split()[0] for x in RAW.split(", ")])

        for batch in slices(batches, "text", TOKEN_SLICE):
            at, ids = word_ids(texts(batch, "text"), encode)
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            cuts = np.flatnonzero(np.diff(at[:-1] // BLOCK_IDS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                held.append(ids[at[a] : at[b]])
                keys.append(np.asarray(batch.column(0))[a:b])
                sizes.append(np.diff(at[a : b + 1]))
                n += len(held[-1])
                if n >= BLOCK_IDS:
                    yield made()
                    block, held, keys, sizes, n = block + 1, [], [], [], 0
        if held:
            yield made()

    # rows that repeat an id stand in the order of their texts, so that a task that runs again writes the same blocks
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, RAW)


def id_counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs over all documents; the result is bounded by the vocabulary."""

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u4"), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["id", "n"])

    total = np.zeros(vocabulary, np.int64)
    for r in raw.select("raw").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return total


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Write every document's ids and the end id to the token files in `path`, in ascending doc_id order.

    Texts are encoded once, into raw blocks in `path`/raw; the global counts of their ids give
    the code, which then packs each block by itself; the raw blocks are deleted. Null text counts as empty. Rows with a null
    doc_id have no place in the order and are left out; rows that repeat a doc_id are all
    written. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    raw_blocks(rows, tokenizer, end_id).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(RAW).parquet(f"{path}/raw")
    lengths = code_lengths(id_counts(raw, library_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True)))
    codes = canonical_codes(lengths)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["raw"], "<u4")
                bits, marks = pack_bits(ids, codes, lengths)
                row = [[r["part"]], [r["block"]], [len(ids)], [r["doc_ids"]], [r["doc_lengths"]], [marks.tobytes()], [bits]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    raw.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(), tokenizer.rsplit("/", 1)[-1], SEGMENT, end_id)], "lengths binary, tokenizer string, segment int, end_id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    discarded(spark, f"{path}/raw")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids if asked for."""
    header = spark.read.parquet(f"{path}/header").first()
    lengths, segment = np.frombuffer(header["lengths"], np.uint8), header["segment"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_part"))
    places = sizes.join(F.broadcast(parts), "part").select("part", "block", (F.col("in_part") + F.col("before_part")).alias("base"))

    def run(batches):
        decoder = Decoder(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = decoder.decode(r["bits"], r["n_ids"], np.frombuffer(r["checkpoints"], "<u8"), segment)
                keys, n = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_lengths"], "<u8").astype(np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                columns = [np.full(len(keys), r["part"], np.int32), np.full(len(keys), r["block"], np.int32), keys, ends - n, n, np.array(crc, np.int64)]
                arrays = [pa.array(c) for c in columns]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    decoded = blocks.mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return decoded.join(places, ["part", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
