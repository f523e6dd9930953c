"""Hard-negative mining by a full sort of each anchor's scores.

Components become whole numbers, so that scores are exact. Anchors go out in chunks of bounded
size; for each chunk Spark reads all rows, and a task scores its rows block by block against
the chunk, sorts each anchor's block by score and id, and reads from it what may be wanted: a
block gives at most as many rows as the whole would, so the best of all blocks are the best of
all. The first reading finds each anchor's positives. In the second one every positive's upper
limit is found in the sorted scores by binary search, and rows of other labels are read from
there down to the lower limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, give_back, numbered, repeated, shared_folder

#: Components that a chunk of anchors has about, and a block of rows: each some ten megabytes at most.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Scores that are held at once: a block's rows times some anchors.
SCORES = 1 << 20


def rows_of(embeddings: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, shift_every: int, classes: int) -> DataFrame:
    """(num, vec_id, label, v): the rows that take part, components floor(scale * x), labels shifted. num numbers rows in the order of ids."""
    c = F.col
    given = embeddings.select(c(id_col).cast("long").alias("doc_id"), c(vec_col).cast("array<double>").alias("vec"), c(label_col).cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.filter(c("doc_id").isNotNull() & c("label").isNotNull() & c("vec").isNotNull() & finite)
    if repeated(given):
        given = numbered(given, c("label"), F.sha2(F.to_json("vec"), 256)).withColumnRenamed("doc_id", "num").withColumnRenamed("__own_id", "vec_id")
    else:
        given = given.select(c("doc_id").alias("num"), c("doc_id").alias("vec_id"), "vec", "label")
    label = F.when(F.pmod("vec_id", F.lit(shift_every)) == 0, (c("label") + 1) % classes).otherwise(c("label")) if shift_every else c("label")
    return given.select("num", "vec_id", label.alias("label"), F.transform("vec", lambda x: F.floor(x * scale)).alias("v"))


@dataclass
class Rows:
    """Some rows as arrays; v holds all components, ends says where each row's stop."""

    num: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    ends: np.ndarray
    #: Of anchors: each one's positives as (score, num, vec_id), best first.
    positives: list = field(default_factory=list)

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Rows:
        batch = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        at = lambda name: batch[name].combine_chunks() if batch.num_rows else pa.array([], batch[name].type)
        whole = lambda name: np.asarray(at(name), dtype=np.int64)
        v = at("v")
        sizes = np.asarray(v.value_lengths(), dtype=np.int64) if len(v) else np.zeros(0, np.int64)
        return cls(whole("num"), whole("vec_id"), whole("label"), np.asarray(v.flatten(), dtype=np.int64), np.cumsum(sizes))

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def matrix(self, which: np.ndarray, size: int) -> np.ndarray:
        """The vectors of rows `which`, all of `size` components."""
        return self.v[(self.ends[which] - size)[:, None] + np.arange(size)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact as far as they fit a long."""
    most = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 2**53:  # every partial sum is a whole number that a double holds
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def scored(anchors: Rows, rows: Rows, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor places, row places, scores) of blocks, rows in the order of num: rows of the anchors' label, or of other labels. Only vectors of one size meet."""
    for size in np.intersect1d(anchors.sizes(), rows.sizes()):
        fit = np.flatnonzero(rows.sizes() == size)
        fit = fit[np.argsort(rows.num[fit], kind="stable")]
        of_size = np.flatnonzero(anchors.sizes() == size)
        for label in np.unique(anchors.label[of_size]):
            own = of_size[anchors.label[of_size] == label]
            there = fit[(rows.label[fit] == label) == same]
            if not len(there):
                continue
            b = rows.matrix(there, size)
            step = max(1, SCORES // len(there))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                yield some, there, products(anchors.matrix(some, size), b)


def first_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each line's scores in falling order, the first k; equal scores in the order they stand."""
    return np.lexsort((np.broadcast_to(np.arange(scores.shape[1]), scores.shape), -scores))[:, :k]


def positives_in(anchors: Rows, rows: Rows, k: int) -> dict[str, np.ndarray]:
    """Of each anchor the k best other rows of its label."""
    out = []
    for some, there, scores in scored(anchors, rows, True):
        order = first_of(scores, k + 1)
        a = np.repeat(some, order.shape[1])
        r = there[order.ravel()]
        s = np.take_along_axis(scores, order, 1).ravel()
        other = rows.num[r] != anchors.num[a]
        out.append(np.stack((anchors.num[a], rows.num[r], rows.vec_id[r], s))[:, other])
    return dict(zip(("anchor", "num", "vec_id", "score"), np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64), strict=True))


def negatives_in(anchors: Rows, rows: Rows, k: int, low_percent: int, high_percent: int) -> dict[str, np.ndarray]:
    """For each anchor and positive the first k rows of other labels between the positive's limits."""
    out = []
    for some, there, scores in scored(anchors, rows, False):
        order = first_of(scores, scores.shape[1])
        for i, a in enumerate(some):
            if not anchors.positives[a]:
                continue
            falling = -scores[i, order[i]]
            score, num = np.array([(s, n) for s, n, _ in anchors.positives[a]], np.int64).T
            # low * positive <= 100 * negative <= high * positive, in whole numbers
            lowest, highest = -((-low_percent * score) // 100), high_percent * score // 100
            begin, end = np.searchsorted(falling, -highest, "left"), np.searchsorted(falling, -lowest, "right")
            n = np.clip(end - begin, 0, k)
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r = there[order[i, at]]
            out.append(np.stack((np.full(len(at), anchors.num[a]), np.repeat(num, n), rows.num[r], rows.vec_id[r], -falling[at])))
    return dict(zip(("anchor", "positive", "num", "vec_id", "score"), np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64), strict=True))


def blocks_of(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[Rows]:
    """Batches joined and cut to blocks of about `size` components."""
    for batch in batches:
        if batch.num_rows:
            ends = Rows.of(batch).ends
            step = max(1, batch.num_rows * size // max(int(ends[-1]), 1))
            for lo in range(0, batch.num_rows, step):
                yield Rows.of(batch.slice(lo, step))
        give_back()


def chunk_of(anchors: DataFrame) -> Rows:
    return Rows.of(anchors.toArrow())


def hard_negatives(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, shift_every: int = 0, classes: int = 10, scale: int = 256,
    n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100, chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no
    part. Rows that repeat an id are rows of their own, in the order of label and digest of the
    vector: each of them that is an anchor has results, and the others may be its positives or
    negatives. Vectors of different lengths have no score. Equal scores go by the smaller id.
    Scores have to fit a long. Anchors without a positive, and positives without a negative
    between their limits, have no rows. Other columns are not read. `chunk` bounds the components of the anchors
    that are sent to all tasks at once; all rows are read twice for each chunk.
    """
    spark = embeddings.sparkSession
    rows = rows_of(embeddings, id_col, vec_col, label_col, scale, shift_every, classes)
    anchors = rows.filter(F.pmod("vec_id", F.lit(anchor_every)) == 0)
    out, waiting = shared_folder(spark, "hard-negatives"), shared_folder(spark, "anchors")
    held = anchors.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    parts = -(-held // chunk) or 1
    anchors.withColumn("part", F.pmod(F.xxhash64("num"), F.lit(parts))).write.partitionBy("part").parquet(waiting)
    found = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], found).write.parquet(out)
    if held:
        stored = spark.read.parquet(waiting)
        for part in range(parts):
            some = chunk_of(stored.filter(F.col("part") == part).select("num", "vec_id", "label", "v"))
            if len(some.num):
                mined(spark, rows, some, n_positives, n_negatives, low_percent, high_percent).write.mode("append").parquet(out)
    discarded(spark, waiting)
    return spark.read.schema(found).parquet(out)


def mined(spark: SparkSession, rows: DataFrame, anchors: Rows, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """hard_negatives of one chunk of anchors."""
    sent = spark.sparkContext.broadcast(anchors)

    def near(batches):
        for block in blocks_of(batches):
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in positives_in(sent.value, block, n_positives).items()})

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "num")
    close = rows.mapInArrow(near, "anchor long, num long, vec_id long, score long").withColumn("k", F.row_number().over(best)).filter(F.col("k") <= n_positives)
    place = {n: i for i, n in enumerate(anchors.num.tolist())}
    anchors.positives = [[] for _ in place]
    for r in close.orderBy("anchor", "k").toArrow().to_pylist():  # a few for each anchor of the chunk
        anchors.positives[place[r["anchor"]]].append((r["score"], r["num"], r["vec_id"]))
    full = spark.sparkContext.broadcast(anchors)

    def hard(batches):
        for block in blocks_of(batches):
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in negatives_in(full.value, block, n_negatives, low, high).items()})

    first = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "num")
    taken = rows.mapInArrow(hard, "anchor long, positive long, num long, vec_id long, score long").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n_negatives)
    known = [(int(n), p, int(v), q, s) for n, v, ps in zip(anchors.num, anchors.vec_id, anchors.positives, strict=True) for s, p, q in ps]
    names = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in known], pa.int64()) for i, c in enumerate(("anchor", "positive", "anchor_id", "positive_id", "positive_score"))}))
    return taken.join(F.broadcast(names), ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
