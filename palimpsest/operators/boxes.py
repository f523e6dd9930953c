"""Boxes: geometry, tiles, grounding of points, suppression, boxes of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed
from . import grid


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Overlap of two boxes (x, y, width, height columns) over their union; 0 where there is none."""
    ax, ay, aw, ah = map(F.col, a)
    bx, by, bw, bh = map(F.col, b)
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def tiles(boxes: DataFrame, size: int, columns: int, rows: int) -> DataFrame:
    """Each box's tiles of a grid: adds tile, row by row from 0. Parts outside the grid are cut off."""
    lo = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) / size)).cast("int")
    hi = lambda c, d, n: F.least(F.lit(n - 1), F.ceil((F.col(c) + F.col(d)) / size) - 1).cast("int")
    inside = (hi("x", "width", columns) >= lo("x")) & (hi("y", "height", rows) >= lo("y"))
    across = boxes.filter(inside).withColumn("__c", F.explode(F.sequence(lo("x"), hi("x", "width", columns)))).withColumn("__r", F.explode(F.sequence(lo("y"), hi("y", "height", rows))))
    return across.withColumn("tile", F.col("__r") * columns + F.col("__c")).drop("__c", "__r")


# Tags to act on and tags that only hold others.
ACTIVE_TAGS, CONTAINER_TAGS = ["button", "input", "select", "textarea", "a"], ["div", "section", "article", "main", "table", "tbody", "tr", "td", "ul", "ol", "li", "span"]


def specificity(tag: Column, type_: Column, text: Column, aria: Column, in_modal: Column) -> Column:
    """How specific an element is: active ones, buttons, named ones and those of a dialog more, nameless containers less."""
    tag = F.lower(F.coalesce(tag, F.lit("")))
    on = lambda c, n: F.when(c, n).otherwise(0)
    named = F.coalesce(text, F.lit("")) != ""
    marked = F.coalesce(aria, F.lit("")) != ""
    return on(tag.isin(ACTIVE_TAGS), 500) + on(type_.isin("button", "submit"), 200) + on(F.trim(F.coalesce(text, F.lit(""))) != "", 50) + on(marked, 50) + on(in_modal, 300) - on(tag.isin(CONTAINER_TAGS) & ~named & ~marked, 200)


def grounded(points: DataFrame, elements: DataFrame, page: str = "page_id", reach: float = 45.0) -> DataFrame:
    """(page, point_id, element_id, method, distance, confidence) of each point that has an element.

    Of the elements around a point the most specific one, then the smallest, then the first (by
    ord); else the one whose centre is nearest, within reach; active ones count as a fifth
    nearer. Disabled, hidden and empty elements have no part in it. Points meet the elements of
    their cells of a grid, and only those without an element around them the centres near by.
    """
    c = F.col
    usable = F.coalesce("enabled", F.lit(True)) & F.coalesce("visible", F.lit(True)) & (c("width") > 0) & (c("height") > 0)
    active = F.coalesce(c("tag").isin(ACTIVE_TAGS), F.lit(False)) | F.coalesce(c("type") == "button", F.lit(False))
    own = elements.filter(usable).select(page, c("id").alias("element_id"), "ord", "x", "y", "width", "height", active.alias("active"), specificity(c("tag"), c("type"), c("text"), c("aria_label"), c("in_modal")).alias("score"))
    p = points.select(page, "point_id", c("px").cast("double").alias("px"), c("py").cast("double").alias("py"))
    best = F.min(F.struct((-c("score").cast("double")).alias("a"), (c("width") * c("height")).alias("b"), "ord", "element_id", F.lit(0.0).alias("far")))
    around = grid.containing(p, own, page).groupBy(page, "point_id").agg(best.alias("m")).withColumn("method", F.lit("EXACT_CONTAINMENT"))
    centres = own.select(page, "element_id", "ord", "active", (c("x") + c("width") / 2).alias("cx"), (c("y") + c("height") / 2).alias("cy"))
    far = c("away") * F.when(c("active"), 0.8).otherwise(1.0)
    others = grid.near(p.join(around, [page, "point_id"], "left_anti"), centres, reach / 0.8, page).withColumn("far", far).filter(c("far") <= reach)
    nearest = F.min(F.struct(c("far").alias("a"), F.lit(0.0).alias("b"), "ord", "element_id", "far"))
    out = around.unionByName(others.groupBy(page, "point_id").agg(nearest.alias("m")).withColumn("method", F.lit("APPROXIMATE_PROXIMITY")))
    sure = F.when(c("method") == "EXACT_CONTAINMENT", 1.0).otherwise(F.greatest(F.lit(0.2), (reach - c("m.far")) / reach))
    return out.select(page, "point_id", "m.element_id", "method", F.floor(c("m.far") + 0.5).cast("long").alias("distance"), sure.alias("confidence"))


def suppressed(boxes: DataFrame, image: str, threshold: float = 0.30, most: int = 5000) -> DataFrame:
    """Greedy non-maximum suppression: of each image's `most` best boxes by falling score, then box_id, those that overlap no kept one before them by the threshold.

    Overlaps are found by a grid. Each round keeps the boxes that no open box before them overlaps, and
    drops those that a kept one does, until none is open; boxes that overlap nothing are kept at once.
    """
    top = Window.partitionBy(image).orderBy(F.desc("score"), "box_id")
    best = checkpointed(boxes.withColumn("__k", F.row_number().over(top)).filter(F.col("__k") <= most))
    pair = lambda p: tuple(f"{p}_{n}" for n in ("x", "y", "width", "height"))
    edges = checkpointed(grid.overlapping(best, "__k", image).filter(iou(pair("a"), pair("b")) >= threshold).select(image, "a", "b"))
    gone = best.limit(0).select(image, F.col("__k").alias("b"))
    left = edges
    while not left.isEmpty():
        # a box that nothing open comes before is settled: it stays, and what it overlaps goes
        waiting = left.select(image, F.col("b").alias("a")).distinct()
        settled = left.join(waiting, [image, "a"], "left_anti")
        dropped = checkpointed(settled.select(image, "b").distinct())
        gone = gone.unionByName(dropped)
        left = checkpointed(left.join(dropped, [image, "b"], "left_anti").join(dropped.withColumnRenamed("b", "a"), [image, "a"], "left_anti"))
    return best.join(gone.withColumnRenamed("b", "__k"), [image, "__k"], "left_anti").select(boxes.columns)


# Rectangles are structs of x, y, width and height. ------------------------------------------------


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def cut(r: Column, width: Column, height: Column) -> Column:
    """What of a rectangle lies in an image."""
    x, y = F.greatest(F.lit(0.0), r["x"]), F.greatest(F.lit(0.0), r["y"])
    return rect(x, y, F.greatest(F.lit(0.0), F.least(width, r["x"] + r["width"]) - x), F.greatest(F.lit(0.0), F.least(height, r["y"] + r["height"]) - y))


def padded(r: Column, by: Column) -> Column:
    return rect(r["x"] - by, r["y"] - by, r["width"] + by * 2, r["height"] + by * 2)


def scaled(r: Column, across: Column, down: Column) -> Column:
    return rect(r["x"] * across, r["y"] * down, r["width"] * across, r["height"] * down)


def on_screenshot(r: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column, padding: float = 4.0) -> Column:
    """A box of the page as one of its picture: scaled, padded by the mean scale, cut."""
    across, down = image_w / view_w, image_h / view_h
    return cut(padded(scaled(r, across, down), (across + down) / 2 * padding), image_w, image_h)


def on_page(x: Column, y: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """struct<x, y> on the page of a point of its picture; null without sizes."""
    known = (view_w > 0) & (view_h > 0) & (image_w > 0) & (image_h > 0)
    return F.when(known, F.struct((x * view_w / image_w).alias("x"), (y * view_h / image_h).alias("y")))


def in_view(x: Column, y: Column, width: Column, height: Column, view_w: Column, view_h: Column) -> Column:
    """Whether a box meets the viewport."""
    return F.coalesce((width > 0) & (height > 0) & (y + height > 0) & (x + width > 0) & (y < view_h) & (x < view_w), F.lit(False))


def fold(y: Column, height: Column, view_h: Column) -> Column:
    return F.when(y.isNull(), "unknown").when(y + height <= 0, "above the fold").when(y >= view_h, "below the fold").otherwise("on screen")


def redaction_boxes(items: DataFrame, view: tuple[str, str] = ("view_w", "view_h"), image: tuple[str, str] = ("image_w", "image_h")) -> DataFrame:
    """(page_id, kind, x, y, width, height) to black out: found text with 4 pixels around, faces with 10 (whole pixels), identity documents with 8; empty boxes are left out.

    items has kind (text, face or id), a box (of the page; of the picture for faces) and the sizes.
    """
    vw, vh, iw, ih = (F.col(c).cast("double") for c in (*view, *image))
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    clip = lambda v, lo, hi: F.greatest(lo, F.least(hi, v))
    x, y = clip(F.floor(box["x"] - 10), F.lit(0), iw), clip(F.floor(box["y"] - 10), F.lit(0), ih)
    face = rect(x.cast("double"), y.cast("double"), (clip(F.ceil(box["x"] + box["width"] + 10), x, iw) - x).cast("double"), (clip(F.ceil(box["y"] + box["height"] + 10), y, ih) - y).cast("double"))
    made = F.when(F.col("kind") == "face", face).when(F.col("kind") == "id", on_screenshot(box, vw, vh, iw, ih, 8.0)).otherwise(on_screenshot(box, vw, vh, iw, ih, 4.0))
    return items.withColumn("__b", made).filter("__b.width > 0 and __b.height > 0").select("page_id", "kind", *(F.col(f"__b.{c}").alias(c) for c in ("x", "y", "width", "height")))
