"""Where nodes and frames of pages are, which lies on top of a point, and what a selector names through shadow roots.

All follow pointers upwards, to a frame, a positioned ancestor or a shadow host. Pointers are
doubled: each round joins a row to the one it points at and takes over how far that has come,
so that a nesting of d takes log2(d) rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed
from . import grid

#: Rounds after which what still points somewhere points in a circle.
ROUNDS = 20


def climbed(rows: DataFrame, page: str, key: str, up: str, combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """rows with each column of `combine` taken all the way up: combine[c](what is above, own).

    key is a row's own name in its page, up the one it points at (null: it is at the top). `up`
    ends as null; it stays where the row points at nothing there is, or in a circle, and the
    columns of combine are null then.
    """
    c = F.col
    done, open_ = rows.filter(c(up).isNull()), checkpointed(rows.filter(c(up).isNotNull()))
    settled, lost = [done], []
    # of the rows at the top only those that others point at are met, here and in all rounds
    asked = open_.select(page, c(up).alias(key)).distinct()
    heads = checkpointed(done.join(asked, [page, key], "left_semi"))
    every = heads.unionByName(open_)
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        above = every.select(c(page).alias("__page"), c(key).alias("__key"), c(up).alias("__over"), *(c(n).alias(f"__{n}") for n in combine))
        met = open_.join(above, (c(page) == c("__page")) & (c(up) == c("__key")), "left")
        taken = met.select(*(f(c(f"__{n}"), c(n)).alias(n) if (f := combine.get(n)) else F.when(c("__key").isNotNull(), c("__over")).otherwise(c(up)).alias(up) if n == up else c(n) for n in rows.columns), c("__key").isNull().alias("__none"))
        taken = checkpointed(taken)
        lost.append(taken.filter("__none").drop("__none"))
        now = taken.filter("not __none").drop("__none")
        settled.append(now.filter(c(up).isNull()))
        open_ = now.filter(c(up).isNotNull())
        # rows that have got to the top stay there for the others to point at; lost ones are no longer met, so what points at them is lost too
        every = heads
        for s in (*settled[1:], open_):
            every = every.unionByName(s)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    unknown = [n for n in rows.columns if n in combine]
    for s in (*lost, open_):
        out = out.unionByName(s.withColumns({n: F.lit(None).cast(s.schema[n].dataType) for n in unknown}))
    return out


def plus(above: Column, own: Column) -> Column:
    return above + own


def frame_offsets(frames: DataFrame) -> DataFrame:
    """(page_id, frame_id, dx, dy, known) of frames (page_id, frame_id, parent_id, x, y): places in the page, halves rounded up.

    x and y are a frame's place in the one around it; a parent_id of null is the page itself.
    Where one of the frames around has no place, which one of another origin has not, or isn't
    there, the place is unknown.
    """
    c = F.col
    rows = frames.select("page_id", "frame_id", c("parent_id").alias("up"), c("x").cast("double").alias("dx"), c("y").cast("double").alias("dy"))
    out = climbed(rows, "page_id", "frame_id", "up", {"dx": plus, "dy": plus})
    known = c("dx").isNotNull() & c("dy").isNotNull()
    at = lambda n: F.when(known, F.floor(c(n) + 0.5).cast("long")).alias(n)
    return out.select("page_id", "frame_id", at("dx"), at("dy"), known.alias("known"))


def placed(nodes: DataFrame) -> DataFrame:
    """Adds x, y and layer to nodes (page_id, ord, up, left, top, z): places in the page, and layers that compare as what is painted later.

    up is the positioned ancestor that left and top count from. A layer names the stacking contexts around a
    node, each by z and ord, then the node itself; nodes without a place have none.
    """
    c = F.col
    own = F.struct(F.coalesce("z", F.lit(0)).cast("int").alias("z"), c("ord").cast("long").alias("ord"))
    rows = checkpointed(nodes).withColumns({"__up": c("up"), "x": c("left"), "y": c("top"), "layer": F.when(c("z").isNotNull(), F.array(own)).otherwise(F.array_repeat(own, 0))})
    out = climbed(rows, "page_id", "ord", "__up", {"x": plus, "y": plus, "layer": lambda a, b: F.concat(a, b)}).drop("__up")
    return checkpointed(out.withColumn("layer", F.when(c("x").isNotNull() & c("y").isNotNull(), F.when(c("z").isNotNull(), c("layer")).otherwise(F.concat("layer", F.array(own))))))


def topmost(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, point_id, top_ord, top_last) of each point (page_id, point_id, px, py) that a shown node of placed() lies at: the one painted last."""
    c = F.col
    boxes = nodes.filter(c("shown") & c("layer").isNotNull() & (c("width") > 0) & (c("height") > 0)).select("page_id", c("ord").alias("top_ord"), c("last").alias("top_last"), "layer", "x", "y", "width", "height")
    met = grid.containing(points.select("page_id", "point_id", "px", "py"), boxes, "page_id")
    # a box reaches to its right and lower edge, which are no longer its own
    met = met.filter((c("px") < c("x") + c("width")) & (c("py") < c("y") + c("height")))
    return met.groupBy("page_id", "point_id").agg(F.max_by(F.struct("top_ord", "top_last"), "layer").alias("t")).select("page_id", "point_id", "t.top_ord", "t.top_last")


def hit_tested(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """Adds top_ord and visible to nodes of placed(): what lies on top at a node's middle, and whether that is the node, in it or around it.

    Only nodes that are shown and whose boxes meet the view are visible. last is the last ord inside a node, shadow roots included.
    """
    c = F.col
    middle = lambda at, size, most: F.least(F.greatest(c(at) + c(size) / 2, F.lit(0.0)), F.lit(float(most - 1)))
    seen = (c("width") > 0) & (c("height") > 0) & (c("x") + c("width") > 0) & (c("y") + c("height") > 0) & (c("x") < width) & (c("y") < height)
    nodes = nodes.withColumn("__seen", F.coalesce(c("shown") & c("layer").isNotNull() & seen, F.lit(False)))
    points = nodes.filter("__seen").select("page_id", c("ord").alias("point_id"), middle("x", "width", width).alias("px"), middle("y", "height", height).alias("py"))
    found = topmost(points, nodes).withColumnRenamed("point_id", "ord")
    related = c("top_ord").between(c("ord"), c("last")) | c("ord").between(c("top_ord"), c("top_last"))
    met = nodes.join(found, ["page_id", "ord"], "left")
    return met.withColumn("visible", F.coalesce(c("__seen") & (c("top_ord").isNull() | related), F.lit(False))).drop("__seen", "top_last")


def pierced(nodes: DataFrame) -> DataFrame:
    """Adds path to nodes (page_id, ord, host, selector): the selectors of the shadow hosts around a node and its own, joined by ` >>> `."""
    c = F.col
    nodes = checkpointed(nodes)
    hosts = nodes.select("page_id", c("host").alias("ord")).filter("ord is not null").distinct()
    # only hosts are pointed at, so only their paths are worked out by rounds
    rows = nodes.join(hosts, ["page_id", "ord"], "left_semi").select("page_id", "ord", c("host").alias("up"), c("selector").alias("host_path"))
    paths = climbed(rows, "page_id", "ord", "up", {"host_path": lambda a, b: F.concat(a, F.lit(" >>> "), b)})
    inside = nodes.filter("host is not null").join(paths.select("page_id", c("ord").alias("host"), "host_path"), ["page_id", "host"], "left")
    inside = inside.withColumn("path", F.concat("host_path", F.lit(" >>> "), "selector")).drop("host_path")
    return nodes.filter("host is null").withColumn("path", c("selector")).unionByName(inside)


def named(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ord to selectors (page_id, selector): the first node of pierced() with that path, through any number of shadow hosts; null where there is none."""
    first = nodes.filter(F.col("path").isNotNull()).groupBy("page_id", F.col("path").alias("selector")).agg(F.min("ord").alias("ord"))
    spaced = F.regexp_replace(F.trim("selector"), r"\s*>>>\s*", " >>> ")
    return selectors.withColumn("__s", spaced).join(first.withColumnRenamed("selector", "__s"), ["page_id", "__s"], "left").drop("__s")
