"""Packing documents into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .tokens import TOKEN_SLICE, library_encoder, spaced_ids

END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """A complete binary tree over bins; each node holds the largest capacity left below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and its room before; the room is taken."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        room = tree[node]
        tree[node] = room - size
        at = node
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return node - self.leaves, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and its offset there. Pieces are 1 to capacity long."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    if rest := order[full:].tolist():
        tree = Tournament(len(rest), capacity)
        for i in rest:
            b, room = tree.first_fit(int(lengths[i]))
            bins[i], offsets[i] = full + b, capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as ids with the end id, cut every `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = library_encoder(tokenizer)
        for batch in slices(batches, "text", TOKEN_SLICE):
            at, ids = spaced_ids(texts(batch, "text"), encode)
            raw = memoryview(ids.astype("<u4").tobytes())
            keys, out = batch.column(0).to_pylist(), []
            for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a + 1
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    crc = zlib.crc32(raw[4 * (a + s) : 4 * min(b, a + e)])
                    tail = end if e == n else b""
                    row = (key, s, e - s, zlib.crc32(tail, crc), n)
                    out.append((*row, [*ids[a + s : min(b, a + e)].tolist(), *[end_id] * (e == n)]) if with_ids else row)
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, groups: int, capacity: int = 2048) -> DataFrame:
    """Give each piece a sequence and its place there: sequence_id, offset.

    Pieces are dealt to `groups` groups by a hash of document and start; each group is packed by
    itself, and numbers its sequences from group * 2**32. Offsets have no gaps.
    """
    names = cut.columns

    def one(table: pa.Table) -> pa.Table:
        # rows that repeat an id differ in their tokens or not at all, so that a task that runs again packs alike
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        group = table["pack_group"].to_numpy().astype(np.int64)
        table = table.select(names)
        return table.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(7), "doc_id", "start"), F.lit(groups)).cast("int"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("pack_group").applyInArrow(one, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_docs: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Sequences of at most `capacity` tokens that hold each document's ids and the end id once.

    Full pieces fill a sequence each; what is left of the documents is packed by first-fit
    decreasing within randomised groups of about `group_docs` documents. Null or empty text
    gives the end id alone; a null doc_id is kept; rows that repeat a doc_id are packed each.
    Other columns are not read.
    """
    groups = max(1, -(-docs.select(id_col).count() // group_docs))
    return pack(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids=with_ids), groups, capacity)
