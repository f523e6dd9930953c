"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with one set form a class; only classes
are compared. In each of several trees a node chooses some minwise positions, and its members
branch by their values there: two sets of similarity s share a branch with probability s. No
position serves two trees, or two branches or levels that a pair can meet in, so that these
chances are independent, and the threshold says how many trees it takes. Nodes of at most LEAF members, and those left at the last level, are compared
exhaustively by sketches, and what may reach the threshold is confirmed on full sets.

Comparing a node need not mean all its pairs. First a maximum spanning forest of sketch
similarity is confirmed; then only pairs whose ends the confirmed links leave apart. A large
node at the last level is split into blocks, which meet through the node's central members,
and then through its members that are still apart, each of which visits every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_row, checkpointed, coded, mixed, shared_folder, slices, string_hashes, texts, words_of
from .components import components

POSITIONS, BRANCHES = 128, (2, 2, 1, 1, 1)
#: Positions of a tree: one for each branch of each path.
PLACES = int(np.cumprod(BRANCHES).sum())
#: How likely all trees together may miss a pair at the threshold.
MISS = 1e-4
LEAF, BLOCK = 128, 2048
#: Bytes of shingle sets in a block.
BLOCK_BYTES = 32_000_000
#: Ids of documents to confirm that are broadcast at most.
BROADCAST_IDS = 2_000_000
#: How many standard errors below the threshold a sketch's estimate may be.
SLACK = 3.9


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): each document's distinct shingles in ascending order. Fewer words than `width`: the whole sequence."""
    import pyarrow.compute as pc

    offsets, flat = words_of(text)
    codes, distinct = coded(flat)
    h = string_hashes(pc.ascii_lower(distinct))[codes]
    n = np.diff(offsets)
    made = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(made)))
    first = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], made)
    span = np.repeat(np.minimum(n, width), made)
    s = np.zeros(len(first), np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for j in range(width):
        s = np.where(span > j, mixed(s * np.uint64(0x9E3779B97F4A7C15) + padded[first + j]), s)
    out, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        u = np.unique(s[a:b])
        out.append(u)
        sizes.append(len(u))
    return np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int64), np.concatenate(out) if out else s


def minwise(at: np.ndarray, s: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """documents x positions: the least value of each of `positions` hash functions over each set (all ones for an empty set)."""
    out = np.full((len(at) - 1, positions), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        low, starts = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32), at[:-1][full]
        keys = mixed(np.arange(1, 2 * positions + 1, dtype=np.uint64))
        for j in range(positions):
            a, b = np.uint32(keys[2 * j] & np.uint64(0xFFFFFFFF)) | np.uint32(1), np.uint32(keys[2 * j + 1] & np.uint64(0xFFFFFFFF))
            v = (low ^ b) * a
            out[full, j] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), starts)
    return out


def trees_for(percent: int) -> int:
    """Trees that miss a pair at the threshold with a probability of MISS at most, should it have to come down to the last level."""
    share, met = percent / 100, 1.0
    for b in reversed(BRANCHES):
        met = 1 - (1 - share * met) ** b
    return 1 if met >= 1 else math.ceil(math.log(MISS) / math.log1p(-met))


def signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (minwise values, PLACES for each tree), sketch (one byte of the first POSITIONS)."""
    import hashlib

    positions = max(POSITIONS, PLACES * trees)

    def run(batches):
        for batch in slices(batches, "text", 2_000_000):
            at, s = shingle_sets(texts(batch, "text"), width)
            sig = minwise(at, s, positions)
            raw = memoryview(s.tobytes())
            keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            arrays = [batch.column(0), pa.array(np.diff(at)), pa.array(keys, pa.binary())]
            arrays += [pa.array([row.tobytes() for row in m], pa.binary()) for m in (sig, (sig[:, :POSITIONS] >> np.uint32(7)).astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_key", "sig", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, sketch binary")


def branches(node: np.ndarray, free: np.ndarray, sig: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes below, positions free there) of each branch: a node chooses among the positions free for it, and the rest is dealt to its branches."""
    rows, size, count = np.arange(len(node)), free.shape[1], BRANCHES[level]
    choice = mixed(node ^ np.uint64(level + 1))
    turn = ((choice >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
    free = np.take_along_axis(free, (turn[:, None] + np.arange(size)) % size, 1)
    for j in range(count):
        p = free[:, j]
        yield mixed(mixed(choice + p.astype(np.uint64)) + sig[rows, p].astype(np.uint64)), free[:, count + j :: count]


def first_branches(tree: int, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    root = np.full(len(sig), mixed(np.array([1 + tree], np.uint64))[0])
    return branches(root, np.tile(np.arange(PLACES * tree, PLACES * (tree + 1)), (len(sig), 1)), sig, 0)


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def first_level(classes: DataFrame, trees: int) -> DataFrame:
    """(doc_id, sig, n_shingles) -> (node, place, doc_id, n_shingles): members of the first nodes of all trees, and which branch of which tree each is."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = np.asarray(batch.column(0)), signature_rows(batch.column(1))
            out = [node for t in range(trees) for node, _ in first_branches(t, sig)]
            place = np.repeat(np.arange(len(out), dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(place), pa.array(np.tile(ids, len(out))), pa.array(np.tile(np.asarray(batch.column(2)), len(out)))], ["node", "place", "doc_id", "n_shingles"])

    return classes.select("doc_id", "sig", "n_shingles").mapInArrow(run, "node long, place int, doc_id long, n_shingles long")


def deeper_levels(large: DataFrame, trees: int) -> DataFrame:
    """(node, place, doc_id, n_shingles, sig) -> (doc_id, n_shingles, n1, n2, ...): every path from a first node down to the last level."""
    names = [f"n{i}" for i in range(1, len(BRANCHES))]

    def run(batches):
        blank = np.zeros((1, PLACES * trees), np.uint32)
        free = np.concatenate([left for t in range(trees) for _, left in first_branches(t, blank)])
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = signature_rows(batch.column(4))
            paths = [([np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)], free[np.asarray(batch.column(1))])]
            for level in range(1, len(BRANCHES)):
                paths = [([*p, node], left) for p, own in paths for node, left in branches(p[-1], own, sig, level)]
            columns = [np.concatenate([p[i] for p, _ in paths]).view(np.int64) for i in range(1, len(BRANCHES))]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.tile(np.asarray(batch.column(i)), len(paths))) for i in (2, 3)), *map(pa.array, columns)], ["doc_id", "n_shingles", *names])

    return large.select("node", "place", "doc_id", "n_shingles", "sig").mapInArrow(run, "doc_id long, n_shingles long, " + ", ".join(f"{n} long" for n in names))


def leaves(classes: DataFrame, trees: int) -> DataFrame:
    """(doc_id, sig, n_shingles) -> (node, n, doc_id, n_shingles): members of the nodes to compare, of n members each.

    Signatures are looked up once more, for members of large first nodes, whose whole paths are
    worked out then; the levels below only count.
    """

    def counted(rows: DataFrame, node: str) -> DataFrame:
        sizes = rows.groupBy(node).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return checkpointed(rows.join(sizes, node))

    level = counted(first_level(classes, trees), "node")
    done = level.filter(F.col("n") <= LEAF).select("node", "n", "doc_id", "n_shingles")
    large = level.filter(F.col("n") > LEAF)
    if large.isEmpty():
        return done
    paths = deeper_levels(large.select("node", "place", "doc_id", "n_shingles").join(classes.select("doc_id", "sig"), "doc_id"), trees)
    for i in range(1, len(BRANCHES)):
        # branches that meet again lower down are one path
        paths = counted(paths.dropDuplicates(["doc_id", f"n{i}"]) if i > 1 else paths, f"n{i}")
        last = i == len(BRANCHES) - 1
        ripe = paths if last else paths.filter(F.col("n") <= LEAF)
        done = done.unionByName(ripe.select(F.col(f"n{i}").alias("node"), "n", "doc_id", "n_shingles"))
        paths = paths.filter(F.col("n") > LEAF).drop("n", f"n{i}")
        if last or paths.isEmpty():
            break
    return done


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns, one group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((np.diff(k, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def agreement(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many positions agree, less what chance gives."""
    return ((sketches == one).sum(1) - POSITIONS / 256) * (256 / 255)


def spanning_forest(sketches: np.ndarray, least: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest of pairs with agreement >= least, each member's tree, and its total agreement."""
    n = len(sketches)
    sims = np.stack([agreement(sketches, s) for s in sketches])
    total = sims.sum(1)
    best, parent, tree = np.full(n, -1.0), np.full(n, -1), np.full(n, -1)
    out, open_, t = [], np.ones(n, bool), -1
    for _ in range(n):
        i = int(np.argmax(np.where(open_, best, -2.0)))
        if best[i] < least:
            i, t = int(np.argmax(np.where(open_, total, -np.inf))), t + 1
        else:
            out.append((int(parent[i]), i))
        open_[i], tree[i] = False, t
        better = open_ & (sims[i] > best)
        best[better], parent[better] = sims[i][better], i
    return out, tree, total


PAIR = "a long, b long"


def pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def blocked(rows: DataFrame, size: int) -> DataFrame:
    count = F.ceil(F.col("n") / size)
    return rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64(F.lit(11), "doc_id"), count))


def first_pairs(members: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Spanning forests of the nodes' blocks, and each tree's best links to the central members of a node with several blocks."""
    rows = blocked(members, LEAF).join(sketches, "doc_id").select("node", "block", "doc_id", "sketch", "n")
    central = rows.filter(F.col("n") > LEAF).select("node", "block", "doc_id", "sketch").repartition("node", "block").sortWithinPartitions("node", "block")

    def centres(batches):
        for g in grouped(batches, 2):
            s = matrix(g["sketch"])
            _, _, total = spanning_forest(s, least)
            i = int(np.argmax(total))
            yield pa.RecordBatch.from_arrays([g["node"][:1].combine_chunks(), g["doc_id"][i : i + 1].combine_chunks(), g["sketch"][i : i + 1].combine_chunks(), pa.array([float(total[i] / len(s))])], ["node", "centre", "centre_sketch", "score"])

    top = Window.partitionBy("node").orderBy(F.desc("score"), "centre")
    pivots = central.mapInArrow(centres, "node long, centre long, centre_sketch binary, score double").withColumn("k", F.row_number().over(top)).filter("k <= 2")
    pivots = pivots.groupBy("node").agg(F.collect_list(F.struct("centre", "centre_sketch")).alias("pivots"))
    kept = rows.join(pivots, "node", "left").select("node", "block", "doc_id", "sketch", "pivots").repartition("node", "block").sortWithinPartitions("node", "block")

    def run(batches):
        a, b = [], []
        for g in grouped(batches, 2):
            ids, s = g["doc_id"].to_pylist(), matrix(g["sketch"])
            if len(ids) > 1:
                edges, tree, _ = spanning_forest(s, least)
                a += [ids[i] for i, _ in edges]
                b += [ids[j] for _, j in edges]
            else:
                tree = np.zeros(1, np.int64)
            for p in g["pivots"][0].as_py() or []:
                near = agreement(s, np.frombuffer(p["centre_sketch"], np.uint8))
                for t in range(int(tree.max()) + 1):
                    own = np.flatnonzero(tree == t)
                    for i in own[np.argsort(-near[own], kind="stable")[:2]]:
                        if near[i] >= least and ids[i] != p["centre"]:
                            a.append(ids[i])
                            b.append(p["centre"])
            if len(a) > 20_000:
                yield pairs_batch(a, b)
                a, b = [], []
        if a:
            yield pairs_batch(a, b)

    return kept.mapInArrow(run, PAIR).distinct()


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Rows sorted by node, block and visits, homes (visits 0) first: each block's home rows with one batch of its visitors after the other."""
    held: list[pa.RecordBatch] = []
    key, home = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(k, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if (own := (int(k[0, lo]), int(k[1, lo]))) != key:
                key, held, home = own, [], None
            if k[2, lo]:
                home = home or (pa.Table.from_batches(held) if held else None)
                if home:
                    yield home, part
            else:
                held.append(part)


MET = "node long, at long, visits int, doc_id long, part long"


def met_by_sketch(rows: DataFrame, least: float) -> DataFrame:
    """(node, at, visits, doc_id, part, sketch) -> its rows that may reach the threshold with a row of another part, without sketches."""
    names = ["node", "at", "visits", "doc_id", "part"]

    def chosen(table, keep) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column(n))[keep]) for n in names], names)

    def run(batches):
        last, marked = None, None
        for home, visitors in meetings(batches):
            if home is not last:
                if last is not None:
                    yield chosen(last, marked)
                last, marked = home, np.zeros(home.num_rows, bool)
                parts, sketches = np.asarray(home.column("part")), matrix(home.column("sketch"))
            own, keep = np.asarray(visitors.column(4)), np.zeros(visitors.num_rows, bool)
            for i, s in enumerate(matrix(visitors.column(5))):
                near = (parts != own[i]) & (agreement(sketches, s) >= least)
                keep[i] = near.any()
                marked |= near
            yield chosen(visitors, keep)
        if last is not None:
            yield chosen(last, marked)

    return rows.repartition("node", "at").sortWithinPartitions("node", "at", "visits", "doc_id").mapInArrow(run, MET)


class Block:
    """Full sets of a block's home rows, indexed by shingle, and which of their parts confirmed links have joined."""

    def __init__(self, home: pa.Table):
        sets = [np.frombuffer(x, np.uint64) for x in home.column("shingles").to_pylist()]
        self.ids, self.sizes = np.asarray(home.column("doc_id")), np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.label, self.names = np.asarray(home.column("part")).copy(), {}

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many of the shingles x each home row has."""
        lo, hi = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return np.bincount(self.owner[at], minlength=len(self.ids))

    def links(self, x: np.ndarray, part: int, percent: int) -> list[int]:
        """Home rows of parts that x links with its own, one of each; from now on these parts are one."""
        while part in self.names:
            part = self.names[part]
        if (self.label == part).all():
            return []
        both = self.shared(x)
        good = (self.label != part) & (100 * both >= percent * (self.sizes + len(x) - both)) & (both > 0)
        out = []
        for j in np.flatnonzero(good).tolist():
            if (other := int(self.label[j])) != part:
                self.label[self.label == other] = part
                self.names[other] = part
                out.append(j)
        return out


def chosen_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids. Few ids are sent to every task, which spares shuffling all texts."""
    ids = checkpointed(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def links_apart(members: DataFrame, classes: DataFrame, parts: DataFrame, docs: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """Links, confirmed on full sets, between what other confirmed links leave apart; they join the same parts as all such links would.

    Of a node's members those outside its largest part meet every other member: each visits all
    blocks of its node. Sketches choose who takes part; these bring their full sets, and a block
    gives one link for each two parts it joins, fewer than it has members and visitors. The sets
    of a block hold BLOCK_BYTES or a single row at most, visitors pass one batch at a time.
    """
    named = members.join(parts, members["doc_id"] == parts["id"], "left").select("node", "n_shingles", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    sizes = named.groupBy("node", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    largest = sizes.groupBy("node").agg(F.max(F.struct("c", "part")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n"), (F.sum("w") * 8).alias("bytes")).filter("parts > 1")
    count = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    open_ = named.join(largest.select("node", F.col("m.part").alias("largest"), count.alias("blocks")), "node").join(classes.select("doc_id", "sketch"), "doc_id")
    place = lambda at, visits: F.struct(at.cast("long").alias("at"), F.lit(visits).alias("visits"))
    home = F.array(place(F.pmod(F.xxhash64(F.lit(11), "doc_id"), "blocks"), 0))
    visited = F.when(F.col("part") != F.col("largest"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: place(b, 1))).otherwise(F.array().cast("array<struct<at:bigint,visits:int>>"))
    rows = open_.select("node", "doc_id", "part", "sketch", F.explode(F.concat(home, visited)).alias("m")).select("node", "m.at", "m.visits", "doc_id", "part", "sketch")
    met = checkpointed(met_by_sketch(rows, least))

    def sets(batches):
        for batch in slices(batches, "text", 1_000_000):
            at, s = shingle_sets(texts(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "shingles"])

    full = chosen_texts(docs, met.select("doc_id").distinct()).select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles binary")
    rows = met.join(full, "doc_id").select("node", "at", "visits", "doc_id", "part", "shingles").repartition("node", "at").sortWithinPartitions("node", "at", "visits", "doc_id")

    def run(batches):
        last, a, b = None, [], []
        for home, visitors in meetings(batches):
            if home is not last:
                last, block = home, Block(home)
            for doc, part, raw in zip(*(visitors.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                found = block.links(np.frombuffer(raw, np.uint64), part, percent)
                a += [doc] * len(found)
                b += block.ids[found].tolist()
            if len(a) > 20_000:
                yield pairs_batch(a, b)
                a, b = [], []
        if a:
            yield pairs_batch(a, b)

    return rows.mapInArrow(run, PAIR).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in slices(batches, "text_a", 1_000_000):
            (x_at, x), (y_at, y) = (shingle_sets(texts(batch, c), width) for c in ("text_a", "text_b"))
            good = []
            for i in range(batch.num_rows):
                p, q = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                union = len(np.union1d(p, q))
                good.append(100 * (len(p) + len(q) - union) >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    used = chosen_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    ends = [used.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    return pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "text_a", "text_b").mapInArrow(run, PAIR).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs without ASCII white space. Documents are linked when 100 *
    intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable, and that document is kept. Null or empty texts have no shingles and are linked
    with nothing. A null doc_id is linked with nothing, has component_id null and is kept. Rows that
    repeat a doc_id are documents of their own, in the order of their texts' digests; one of them is kept
    at most. Other columns are not read. Unless `trees` is given, a pair at the threshold is missed by all trees with a probability
    of MISS at most, and by the sketches with about 0.00005 more.
    """
    trees = trees_for(percent) if trees is None else trees
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return by_row(rows, lambda given: classified(given, width, percent, trees), "component_id")


def classified(rows: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """near_duplicates of (doc_id, text) whose ids, nulls apart, don't repeat."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "near")
    signatures(rows, width, trees).write.parquet(folder)
    base = spark.read.parquet(folder)
    reps = base.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).dropna()
    reps = checkpointed(reps)
    folder = shared_folder(spark, "classes")
    base.select("doc_id", "n_shingles", "sig", "sketch").join(reps.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).write.parquet(folder)
    classes = spark.read.parquet(folder)
    share = percent / 100
    least = POSITIONS * share - SLACK * np.sqrt(POSITIONS * share * (1 - share))
    # one part of the union for each level: as many partitions as a shuffle makes are enough
    members = checkpointed(leaves(classes, trees).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sketches = classes.select("doc_id", "sketch")
    links = checkpointed(confirmed(checkpointed(first_pairs(members, sketches, least)), rows, width, percent))
    parts = components(links)
    more = checkpointed(links_apart(members, classes, parts, rows, width, percent, least))
    if not more.isEmpty():
        parts = components(parts.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = reps.join(parts, reps["doc_id"] == parts["id"], "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
