"""Joins of points, boxes and names by equal keys: a grid over each page, and endings of texts.

A box lies on the level of the grid whose cells are at least as long as its longer side, so that
it touches four of them at most; a point looks into one cell of each level that its page has.
What lies in no common cell is never paired, whatever a page holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The side of a cell on level 0, and the highest level.
CELL, TOP = 32.0, 20


def level_of(width: Column, height: Column) -> Column:
    """The level whose cells are at least as long as a box; each has cells twice as long as the one before."""
    return F.greatest(F.lit(0), F.least(F.lit(TOP), F.ceil(F.log2(F.greatest(width, height, F.lit(1.0)) / CELL)))).cast("int")


def side_of(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(2.0), level)


def indexed(boxes: DataFrame) -> DataFrame:
    """boxes (x, y, width, height) once for each cell that they touch: adds g_level, g_x, g_y. Those without four finite numbers go."""
    c = F.col
    whole = F.lit(True)
    for n in ("x", "y", "width", "height"):
        whole = whole & c(n).isNotNull() & ~F.isnan(c(n).cast("double")) & (F.abs(c(n)) < 1e12)
    rows = boxes.filter(whole).withColumn("g_level", level_of(c("width").cast("double"), c("height").cast("double")))
    side = side_of(c("g_level"))
    span = lambda lo, size: F.sequence(F.floor(c(lo) / side), F.floor((c(lo) + F.greatest(c(size), F.lit(0.0))) / side))
    return rows.withColumn("g_x", F.explode(span("x", "width"))).withColumn("g_y", F.explode(span("y", "height")))


def containing(points: DataFrame, boxes: DataFrame, *page: str) -> DataFrame:
    """Each point (px, py) with each box of its page that it lies in or on the edge of: the columns of both."""
    c = F.col
    cells = indexed(boxes)
    levels = cells.groupBy(*page).agg(F.collect_set("g_level").alias("g_levels"))
    probes = points.join(levels, list(page)).withColumn("g_level", F.explode("g_levels")).drop("g_levels")
    side = side_of(c("g_level"))
    probes = probes.withColumn("g_x", F.floor(c("px") / side)).withColumn("g_y", F.floor(c("py") / side))
    inside = c("px").between(c("x"), c("x") + c("width")) & c("py").between(c("y"), c("y") + c("height"))
    return probes.join(cells, [*page, "g_level", "g_x", "g_y"]).filter(inside).drop("g_level", "g_x", "g_y")


def overlapping(boxes: DataFrame, key: str, *page: str) -> DataFrame:
    """(page..., a, b and both boxes as a_x ... b_height): pairs of boxes of a page, a's key less than b's, that share some area.

    A box stands in its cells of its own level and of each higher one that its page has; two boxes meet
    on the level of the larger one. A pair that shares several cells is found in the least of them.
    """
    c = F.col
    own = boxes.select(*page, c(key).alias("k"), *(c(n).cast("double").alias(n) for n in ("x", "y", "width", "height"))).filter("width > 0 and height > 0")
    sized = own.withColumn("own", level_of(c("width"), c("height")))
    levels = sized.groupBy(*page).agg(F.collect_set("own").alias("g_levels"))
    rows = sized.join(levels, list(page)).withColumn("g_level", F.explode(F.filter("g_levels", lambda n: n >= c("own")))).drop("g_levels")
    side = side_of(c("g_level"))
    span = lambda lo, size: F.sequence(F.floor(c(lo) / side), F.floor((c(lo) + c(size)) / side))
    cells = rows.withColumn("g_x", F.explode(span("x", "width"))).withColumn("g_y", F.explode(span("y", "height")))
    half = lambda p: cells.select(*page, "g_level", "g_x", "g_y", *(c(n).alias(f"{p}_{n}") for n in ("k", "own", "x", "y", "width", "height")))
    met = half("a").join(half("b"), [*page, "g_level", "g_x", "g_y"]).filter((c("a_k") < c("b_k")) & (F.greatest("a_own", "b_own") == c("g_level")))
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    shared = (left < F.least(c("a_x") + c("a_width"), c("b_x") + c("b_width"))) & (top < F.least(c("a_y") + c("a_height"), c("b_y") + c("b_height")))
    first = (c("g_x") == F.floor(left / side)) & (c("g_y") == F.floor(top / side))
    return met.filter(shared & first).select(*page, c("a_k").alias("a"), c("b_k").alias("b"), *(f"{p}_{n}" for p in "ab" for n in ("x", "y", "width", "height")))


def reached(points: DataFrame, reach: float) -> DataFrame:
    """Each point (px, py) once for each cell that lies within reach: adds g_x and g_y. Cells are four times as long as that, so a point has one, two or four, 2.25 on the average."""
    c = F.col
    span = lambda n: F.when(c(n).isNotNull(), F.sequence(F.floor((c(n) - reach) / (4 * reach)), F.floor((c(n) + reach) / (4 * reach))))
    return points.withColumn("g_x", F.explode(span("px"))).withColumn("g_y", F.explode(span("py")))


def near(points: DataFrame, centres: DataFrame, reach: float, *page: str) -> DataFrame:
    """Each point (px, py) with each centre (cx, cy) of its page that is at most `reach` away: the columns of both, and away."""
    c = F.col
    cell = lambda n: F.floor(c(n) / (4 * reach))
    dx, dy = c("px") - c("cx"), c("py") - c("cy")
    pairs = reached(points, reach).join(centres.withColumn("g_x", cell("cx")).withColumn("g_y", cell("cy")), [*page, "g_x", "g_y"]).drop("g_x", "g_y")
    return pairs.withColumn("away", F.sqrt(dx * dx + dy * dy)).filter(c("away") <= reach)


def endings(rows: DataFrame, text: str, wanted: DataFrame, ending: str, *page: str) -> DataFrame:
    """rows once for each ending of `text` that is as long as some `ending` of its page: adds end. An equality join on it then finds what a text ends in."""
    lengths = wanted.groupBy(*page).agg(F.collect_set(F.length(ending)).alias("g_lengths"))
    ends = F.transform(F.filter("g_lengths", lambda n: n <= F.length(text)), lambda n: F.right(F.col(text), n))
    return rows.join(lengths, list(page)).withColumn("end", F.explode(ends)).drop("g_lengths")


def beginnings(rows: DataFrame, text: str, mark: str, wanted: DataFrame, start: str, *page: str) -> DataFrame:
    """rows once for each place of `mark` in `text` and each length of a `start` of its page: adds begin, what stands there. An equality join on it finds the texts that hold a start, which begins with the mark."""
    lengths = wanted.groupBy(*page).agg(F.collect_set(F.length(start)).alias("g_lengths"))
    parts = F.split(F.col(text), "\\Q" + mark + "\\E")
    tails = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda _, i: F.concat(F.lit(mark), F.array_join(F.slice(parts, i + 2, F.size(parts)), mark)))
    rows = rows.join(lengths, list(page)).withColumn("g_tail", F.explode(tails))
    begins = F.transform(F.filter("g_lengths", lambda n: n <= F.length("g_tail")), lambda n: F.left(F.col("g_tail"), n))
    return rows.withColumn("begin", F.explode(begins)).drop("g_lengths", "g_tail")
