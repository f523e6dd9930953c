"""What is linked, directly or not: the least node that each node leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Rounds after which linking stops with an error; each more than halves how far a node is from its root.
ROUNDS = 60


def linked(edges: DataFrame, *space: str) -> DataFrame:
    """(space..., node, root) of every node of edges (space..., a, b), nulls left out; only equal space links.

    Alternates between tying each node's larger neighbours, and its smaller ones, to the least of
    them, until every node is tied to a root only. A node of many links is a key of an aggregation,
    never a list.
    """
    c, on = F.col, [*space]
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = checkpointed(edges.filter(c("a").isNotNull() & c("b").isNotNull()).select(*on, hi, lo).filter("hi <> lo").distinct())
    nodes = edges.select(*on, F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    for _ in range(ROUNDS):
        both = now.select(*on, c("hi").alias("u"), c("lo").alias("v")).unionByName(now.select(*on, c("lo").alias("u"), c("hi").alias("v")))
        least = both.groupBy(*on, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        larger = both.filter("v > u").join(least, [*on, "u"]).select(*on, c("v").alias("hi"), c("m").alias("lo")).distinct()
        least = larger.groupBy(*on, "hi").agg(F.min("lo").alias("m"))
        smaller = larger.join(least, [*on, "hi"])
        tied = smaller.filter("lo <> m").select(*on, c("lo").alias("hi"), c("m").alias("lo")).unionByName(least.select(*on, "hi", c("m").alias("lo"))).distinct()
        tied = checkpointed(tied)
        same = tied.join(now, [*on, "hi", "lo"], "left_anti").isEmpty() and now.join(tied, [*on, "hi", "lo"], "left_anti").isEmpty()
        now = tied
        if same:
            return nodes.join(now.select(*on, c("hi").alias("node"), c("lo").alias("root")), [*on, "node"], "left").select(*on, "node", F.coalesce("root", "node").alias("root"))
    raise ValueError(f"not linked up after {ROUNDS} rounds")
