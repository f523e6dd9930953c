"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def locally_joined(edges: DataFrame) -> DataFrame:
    """Each partition's links as stars: the same components, no more links than vertices."""

    def run(batches):
        forest, held = Forest(), 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            held = len(forest.up)
            if held > 500_000:  # bounded memory: hand on what is known and begin anew
                yield stars(forest)
                forest = Forest()
        yield stars(forest)

    def stars(forest: Forest) -> pa.RecordBatch:
        ids = [x for x in forest.up if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.root(x) for x in ids], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) links -> (id, component) for every id that has a link; component is its smallest member.

    Links with a null end and links of an id to itself are ignored; repeated links count once.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().filter("a <> b")
    links = checkpointed(locally_joined(links).distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a vertex joins the smallest of its neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a vertex and its smaller neighbours join the smallest of these
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
