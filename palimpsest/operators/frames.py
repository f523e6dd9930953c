"""Screens as pixels (frame, x, y, gray): statistics of regions, edges, changes, overlays, painted elements, decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed
from .linking import linked

# Tiles and what of them counts as change.
TILE, TILE_CHANGED, NOISE, SPINNER, MAJOR = 16, 8.0, 0.0008, 0.06, 0.35
# A spinner's span and structure; edges.
SPINNER_SPAN, SPINNER_EDGES, EDGE = 0.28, 0.05, 24.0
# The scrim of a dialog.
MARGIN, GAP, PERIMETER_VARIANCE, BAND_SPREAD, PERIMETER_DROP = 0.12, 22.0, 2200.0, 26.0, 18.0
BLOCK_FILL, BLOCK_LEAST, BLOCK_MOST, BLOCK_LIFT, BLOCK_RANGE = 0.45, 0.02, 0.72, 26.0, 0.45
# What is painted, and what looks like an icon.
PAINT_VARIANCE, PAINT_EDGES, ICON_EDGES, ICON_VARIANCE = 12.0, 0.01, 0.04, 60.0


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def verdict(ratio: Column) -> Column:
    return F.when(ratio <= NOISE, "no_change").when(ratio >= MAJOR, "major_change").when(ratio <= SPINNER, "localized_change").otherwise("partial_change")


def compared(before: DataFrame, after: DataFrame, size: int = TILE) -> DataFrame:
    """(frame, comparable, changed_tiles, total_tiles, change_ratio, x, y, width, height, verdict) of frames that both have.

    Frames of different sizes are not comparable, and a major change. The box bounds the changed
    tiles, cut at the frame's edge; it is null where nothing changed.
    """
    c = F.col
    tile = (F.floor(c("x") / size).alias("tx"), F.floor(c("y") / size).alias("ty"))
    # what changes from row to row stands together, as that is compressed better
    side = lambda d, first: d.select("frame", F.lit(first).alias("first"), *tile, "y", c("gray").cast("double").alias("gray"), "x")
    # pixels go to their tiles once, and meet there; tables of pixels are never joined, as their size is easily taken for a small one
    rows = side(before, True).unionByName(side(after, False)).filter("frame is not null and x is not null and y is not null").repartition("frame", "tx", "ty")
    of = lambda n, first: F.max(F.when(first, c(n)))
    pixels = rows.groupBy("frame", "tx", "ty", "x", "y").agg(of("gray", c("first")).alias("g0"), of("gray", ~c("first")).alias("g1"), F.bool_or("first").alias("a"), F.bool_or(~c("first")).alias("b"))
    edge = lambda n: (of(n, c("a")).alias(f"a{n}"), of(n, c("b")).alias(f"b{n}"))
    tiles = pixels.groupBy("frame", "tx", "ty").agg(F.avg(F.abs(c("g0") - c("g1"))).alias("d"), F.count_if(c("a") & c("b")).alias("n"), *edge("x"), *edge("y")).withColumn("c", (c("n") > 0) & (c("d") >= TILE_CHANGED))
    hit = lambda f, n: f(F.when(c("c"), c(n)))
    shape = [(F.max(f"{n}{i}") + 1).alias(f"{n}{j}") for n in "ab" for i, j in (("x", "w"), ("y", "h"))]
    total = F.count_if(c("n") > 0)
    per = tiles.groupBy("frame").agg(F.when(total > 0, F.count_if("c")).alias("changed_tiles"), F.nullif(total, F.lit(0).cast("long")).alias("total_tiles"), hit(F.min, "tx").alias("x0"), hit(F.min, "ty").alias("y0"), hit(F.max, "tx").alias("x1"), hit(F.max, "ty").alias("y1"), *shape)
    rows = per.filter("aw is not null and bw is not null").withColumn("comparable", (c("aw") == c("bw")) & (c("ah") == c("bh")))
    ok = F.col("comparable")
    ratio = F.when(ok, F.col("changed_tiles") / F.col("total_tiles")).otherwise(0.0)
    side = lambda hi, lo, edge: F.when(ok, F.least(F.col(edge), (F.col(hi) + 1) * size) - F.col(lo) * size)
    return rows.select(
        "frame", "comparable", F.when(ok, F.col("changed_tiles")).otherwise(0).alias("changed_tiles"), F.when(ok, F.col("total_tiles")).otherwise(0).alias("total_tiles"), ratio.alias("change_ratio"),
        F.when(ok, F.col("x0") * size).alias("x"), F.when(ok, F.col("y0") * size).alias("y"), side("x1", "x0", "bw").alias("width"), side("y1", "y0", "bh").alias("height"),
        F.when(ok, verdict(ratio)).otherwise("major_change").alias("verdict"), F.least("bw", "bh").alias("shorter"),
    )


def with_edges(pixels: DataFrame) -> DataFrame:
    """Pixels with edge: whether the gradient is steep; null on the frame's border."""
    across, down = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    gx, gy = F.lead("gray").over(across) - F.lag("gray").over(across), F.lead("gray").over(down) - F.lag("gray").over(down)
    return pixels.withColumn("__gx", gx).withColumn("__gy", gy).withColumn("edge", F.sqrt(F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy")) >= EDGE).drop("__gx", "__gy")


def region_stats(edged: DataFrame, boxes: DataFrame) -> DataFrame:
    """(frame, box_id, n, mean, variance, edge_density) of each box, widened to whole pixels; population variance. Without pixels: zeros."""
    b = boxes.select("frame", "box_id", F.floor("x").alias("x0"), F.floor("y").alias("y0"), F.ceil(F.col("x") + F.col("width")).alias("x1"), F.ceil(F.col("y") + F.col("height")).alias("y1"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    got = edged.join(b.hint("shuffle_hash"), "frame").filter(inside).groupBy("frame", "box_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gray").alias("mean"), F.var_pop("gray").alias("variance"), F.avg(F.col("edge").cast("double")).alias("edge_density"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return boxes.select("frame", "box_id").join(got, ["frame", "box_id"], "left").select("frame", "box_id", F.coalesce("n", F.lit(0)).alias("n"), zero("mean"), zero("variance"), zero("edge_density"))


def _around(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels in boxes of their frame, and those next to them."""
    c = F.col
    near = lambda n, size: (c(f"p.{n}") >= F.floor(f"b.{n}") - 1) & (c(f"p.{n}") <= F.ceil(c(f"b.{n}") + c(f"b.{size}")))
    return pixels.alias("p").join(_few(checkpointed(boxes)).alias("b"), (c("p.frame") == c("b.frame")) & near("x", "width") & near("y", "height"), "left_semi")


#: Rows that a side of a join may have to be sent to all tasks.
SENT = 200_000


def _few(rows: DataFrame) -> DataFrame:
    """Written rows that meet pixels, one or a few for each frame: sent to all tasks up to a bound, beyond it dealt out with the pixels. Pixels are never sent, whatever size they are taken for."""
    return rows.hint("broadcast" if rows.limit(SENT + 1).count() <= SENT else "shuffle_hash")


def loading(changes: DataFrame, pixels: DataFrame) -> DataFrame:
    """(frame, is_loading, reason): a small, compact change with structure is an animation of loading.

    Edges count only where a change is small and compact. pixels of with_edges() are taken as they are; of
    others the edges are worked out there alone.
    """
    span = F.greatest("width", "height") / F.col("shorter")
    open_ = F.col("comparable") & F.col("x").isNotNull() & (F.col("change_ratio") > NOISE) & (F.col("change_ratio") <= SPINNER) & (span <= SPINNER_SPAN)
    boxes = changes.filter(open_).select("frame", F.lit(0).alias("box_id"), "x", "y", "width", "height")
    edged = pixels if "edge" in pixels.columns else with_edges(_around(pixels, boxes))
    rows = changes.join(region_stats(edged, boxes).select("frame", "edge_density"), "frame", "left")
    reason = (
        F.when(~F.col("comparable") | F.col("x").isNull() | (F.col("change_ratio") <= NOISE), "no_animation").when(F.col("change_ratio") > SPINNER, "change_too_large")
        .when(span > SPINNER_SPAN, "change_not_compact").when(F.col("edge_density") < SPINNER_EDGES, "region_unstructured").otherwise("compact_structured_animation")
    )
    return rows.select("frame", (reason == "compact_structured_animation").alias("is_loading"), reason.alias("reason"))


def perimeter(pixels: DataFrame) -> DataFrame:
    """(frame, w, h, top, bottom, left, right, centre, pooled_mean, pooled_variance, spread): means of the bands along the edges, and of what they enclose."""
    shape = pixels.groupBy("frame").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    at = pixels.join(shape.hint("shuffle_hash"), "frame").withColumn("mx", F.greatest(F.lit(1), F.floor(F.col("w") * MARGIN))).withColumn("my", F.greatest(F.lit(1), F.floor(F.col("h") * MARGIN)))
    band = F.when(F.col("y") < F.col("my"), "top").when(F.col("y") >= F.col("h") - F.col("my"), "bottom").when(F.col("x") < F.col("mx"), "left").when(F.col("x") >= F.col("w") - F.col("mx"), "right").otherwise("centre")
    rows = at.withColumn("band", band)
    names = ["top", "bottom", "left", "right"]
    of = lambda n: F.avg(F.when(F.col("band") == n, F.col("gray"))).alias(n)
    edge = F.when(F.col("band") != "centre", F.col("gray"))
    out = rows.groupBy("frame").agg(F.first("w").alias("w"), F.first("h").alias("h"), *map(of, [*names, "centre"]), F.avg(edge).alias("pooled_mean"), F.var_pop(edge).alias("pooled_variance"), F.max("gray").alias("brightest"))
    return out.withColumn("spread", F.greatest(*names) - F.least(*names))


#: The side of the tiles that connected parts are found in before tiles are joined.
PART = 64


def labelled(pixels: DataFrame, size: int = PART) -> DataFrame:
    """(frame, x, y, value, part): pixels, each with the least place (y, then x) of those it is connected to inside its tile."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        x0, y0 = x.min() // size * size, y.min() // size * size
        far = np.iinfo(np.int64).max
        names = np.full((size + 2, size + 2), far)
        names[y - y0 + 1, x - x0 + 1] = (y << 32) | x
        lit = names < far
        while True:  # the least name around, until nothing changes; a tile has few steps
            best = names
            for axis in (0, 1):
                for step in (-1, 1):
                    best = np.minimum(best, np.roll(names, step, axis))
            best = np.where(lit, best, far)
            if (best == names).all():
                break
            names = best
        return pdf[["frame", "x", "y", "value"]].assign(part=names[y - y0 + 1, x - x0 + 1])

    kind = dict(pixels.dtypes)["frame"]
    rows = pixels.select("frame", F.col("x").cast("long"), F.col("y").cast("long"), F.col("value").cast("double"), F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"))
    return rows.groupBy("frame", "tx", "ty").applyInPandas(one, f"frame {kind}, x long, y long, value double, part long")


def components(pixels: DataFrame, size: int = PART) -> DataFrame:
    """(frame, component, n, total, x0, y0, x1, y1) of the connected parts of each frame's pixels (frame, x, y, value), by their four neighbours.

    Parts are found in tiles; those that touch over a tile's edge are linked, and their counts,
    sums and bounds added up. component is the least place of its pixels. A frame of any size is never one group.
    """
    c = F.col
    found = checkpointed(labelled(pixels, size))
    parts = found.groupBy("frame", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    touching = []
    for along, across in (("x", "y"), ("y", "x")):
        before = found.filter((c(along) + 1) % size == 0).select("frame", (c(along) + 1).alias(along), across, c("part").alias("a"))
        touching.append(found.filter(c(along) % size == 0).select("frame", along, across, c("part").alias("b")).join(before, ["frame", along, across]).select("frame", "a", "b"))
    roots = linked(touching[0].unionByName(touching[1]).distinct(), "frame").withColumnRenamed("node", "part")
    rows = parts.join(roots, ["frame", "part"], "left").withColumn("component", F.coalesce("root", "part"))
    return rows.groupBy("frame", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def brightest_block(pixels: DataFrame, threshold: DataFrame) -> DataFrame:
    """(frame, fill, area, x, y, width, height) of the largest connected part of each frame's pixels at or over its threshold (frame, level); of equal ones the first."""
    c = F.col
    lit = pixels.join(_few(checkpointed(threshold.select("frame", "level"))), "frame").filter(c("gray") >= c("level")).select("frame", "x", "y", c("gray").alias("value"))
    shape = pixels.groupBy("frame").agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("all"))
    largest = components(lit).groupBy("frame").agg(F.max_by(F.struct("n", "x0", "y0", "x1", "y1"), F.struct("n", -c("component"))).alias("b"))
    w, h = c("b.x1") - c("b.x0") + 1, c("b.y1") - c("b.y0") + 1
    return largest.join(shape, "frame").select("frame", (c("b.n") / (w * h)).alias("fill"), (w * h / c("all")).alias("area"), c("b.x0").cast("int").alias("x"), c("b.y0").cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))


# Text boxes of a map of probabilities.
LIT, SURE, UNCLIP, LEAST_SIDE = 0.3, 0.6, 1.5, 5


def text_boxes(probabilities: DataFrame, sizes: DataFrame) -> DataFrame:
    """(frame, x, y, width, height, score) of the text in maps of probabilities (frame, x, y, value), in the pixels of the original.

    sizes (frame, width, height, map_width, map_height) says how large the original and the map are. Small and
    unsure parts go; a box grows on all sides by its area times UNCLIP over its perimeter, and is cut at the edge.
    """
    c = F.col
    w, h = c("x1") - c("x0") + 1, c("y1") - c("y0") + 1
    rows = components(probabilities.filter(c("value") > LIT)).withColumn("score", c("total") / c("n")).filter((F.least(w, h) >= LEAST_SIDE) & (c("score") >= SURE))
    grown = rows.withColumn("by", w * h * UNCLIP / (2 * (w + h))).join(sizes, "frame")
    sx, sy = c("width") / c("map_width"), c("height") / c("map_height")
    low = lambda v, s: F.greatest(F.lit(0.0), (c(v) - c("by")) * s)
    high = lambda v, s, most: F.least(c(most).cast("double"), (c(v) + 1 + c("by")) * s)
    out = grown.select("frame", "component", low("x0", sx).alias("x"), low("y0", sy).alias("y"), high("x1", sx, "width").alias("r"), high("y1", sy, "height").alias("b"), "score")
    return out.select("frame", "x", "y", (c("r") - c("x")).alias("width"), (c("b") - c("y")).alias("height"), "score").filter("width >= 1 and height >= 1")


def reading_order(boxes: DataFrame, frame: str, *ties: str) -> DataFrame:
    """Adds line and place, both from 1: boxes in lines from top to bottom, and in each from left to right.

    A line is a run of boxes whose middle halves overlap, one with any before it: the furthest
    that those before reach says where the next line begins.
    """
    c = F.col
    first, last = c("y") + c("height") / 4, c("y") + c("height") * 3 / 4
    down = Window.partitionBy(frame).orderBy(first, "x", *ties)
    begins = F.coalesce(first >= F.max(last).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    lines = boxes.withColumn("line", begins.cast("int")).withColumn("line", F.sum("line").over(down).cast("int"))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(frame).orderBy("line", "x", "y", *ties)))


def overlays(pixels: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(frame, has_overlay, confidence, contrast_gap, perimeter_drop, spread, pooled_variance): a bright centre or block over an even, dark rim.

    With the frame before, a rim that went darker on all sides makes it certain.
    """
    rows = perimeter(pixels)
    sides = ["top", "bottom", "left", "right"]
    if before is not None:
        rows = rows.join(perimeter(before).select("frame", F.col("w").alias("pw"), F.col("h").alias("ph"), F.col("pooled_mean").alias("p_mean"), *(F.col(s).alias(f"p_{s}") for s in sides)), "frame", "left")
        same = (F.col("pw") == F.col("w")) & (F.col("ph") == F.col("h"))
        drop = F.when(F.coalesce(same, F.lit(False)), F.col("p_mean") - F.col("pooled_mean"))
        darker = F.lit(True)
        for s in sides:
            darker = darker & (F.col(f"p_{s}") - F.col(s) >= PERIMETER_DROP / 2)
    else:
        drop, darker = F.lit(None).cast("double"), F.lit(False)
    gap = F.col("centre") - F.col("pooled_mean")
    even = (F.col("spread") <= BAND_SPREAD) & (F.col("pooled_variance") <= PERIMETER_VARIANCE)
    in_time = F.coalesce((drop >= PERIMETER_DROP) & darker & (gap >= GAP), F.lit(False))
    bright = F.coalesce((gap >= GAP) & even, F.lit(False))
    # a block counts only where the rim is even and nothing else has settled it
    level = F.col("pooled_mean") + F.greatest(F.lit(BLOCK_LIFT), BLOCK_RANGE * F.greatest(F.lit(0.0), F.col("brightest") - F.col("pooled_mean")))
    rows = checkpointed(rows.withColumns({"gap": gap, "drop": drop, "in_time": in_time, "bright": bright, "even": F.coalesce(even, F.lit(False)), "level": level}))
    block = brightest_block(pixels, rows.filter("even and not in_time and not bright").select("frame", "level")).select("frame", "fill", "area")
    rows = rows.join(block, "frame", "left")
    in_block = F.coalesce((F.col("fill") >= BLOCK_FILL) & F.col("area").between(BLOCK_LEAST, BLOCK_MOST), F.lit(False))
    in_time, single = F.col("in_time"), F.col("bright") | in_block
    return rows.select("frame", (in_time | single).alias("has_overlay"), F.when(in_time, "high").when(single, "moderate").otherwise("none").alias("confidence"), F.col("gap").alias("contrast_gap"), F.coalesce("drop", F.lit(0.0)).alias("perimeter_drop"), "spread", "pooled_variance")


def painted(stats: DataFrame) -> DataFrame:
    """Adds painted, and confident: false for boxes under 3 by 3 pixels (n is unknown then), which pass. stats has width and height beside region_stats."""
    sure = (F.col("width") >= 3) & (F.col("height") >= 3)
    return stats.withColumn("confident", sure).withColumn("painted", ~sure | (F.col("variance") >= PAINT_VARIANCE) | (F.col("edge_density") >= PAINT_EDGES))


def looks_like_icon(edge_density: Column, variance: Column) -> Column:
    return (edge_density >= ICON_EDGES) & (variance >= ICON_VARIANCE)


def visual_decision(analyzed: Column, is_loading: Column, last_action: Column, frame_verdict: Column, has_overlay: Column) -> Column:
    """wait, flag_ineffective_action, constrain_to_dialog, or null."""
    idle = last_action.isin("click", "type", "select") & (frame_verdict == "no_change")
    return F.when(~F.coalesce(analyzed, F.lit(False)), None).when(is_loading, "wait").when(idle, "flag_ineffective_action").when(has_overlay, "constrain_to_dialog")


def blacked_out(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels with gray 0 inside any box of their frame."""
    b = boxes.select("frame", "x", "y", "width", "height").alias("b")
    p = pixels.alias("p")
    inside = (F.col("p.frame") == F.col("b.frame")) & (F.col("p.x") >= F.floor("b.x")) & (F.col("p.x") < F.ceil(F.col("b.x") + F.col("b.width"))) & (F.col("p.y") >= F.floor("b.y")) & (F.col("p.y") < F.ceil(F.col("b.y") + F.col("b.height")))
    hit = p.join(b, inside, "left_semi").select("frame", "x", "y").withColumn("__hit", F.lit(True))
    return pixels.join(hit, ["frame", "x", "y"], "left").withColumn("gray", F.when(F.col("__hit"), F.lit(0.0)).otherwise(F.col("gray").cast("double"))).drop("__hit")


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres at halves, edges repeated."""

    def places(n: int, of: int):
        at = (np.arange(n) + 0.5) * (of / n) - 0.5
        low = np.floor(at)
        return np.clip(low, 0, of - 1).astype(int), np.clip(low + 1, 0, of - 1).astype(int), at - low

    y0, y1, fy = places(height, image.shape[0])
    x0, x1, fx = places(width, image.shape[1])
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    below = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + below * fy[:, None]


def icon_input(image: np.ndarray, size: int = 20, threshold: float = 0.45, trims: int = 3, full: float = 0.85) -> np.ndarray:
    """A gray icon (0 to 1) made light on dark, stretched, without its frame, centred in a square, resized."""
    h, w = image.shape
    if h < 3 or w < 3:
        return np.zeros((size, size))
    g = 1 - image if image.mean() > 0.5 else image.astype(float)
    g = (g - g.min()) / (g.max() - g.min()) if g.max() - g.min() > 1e-6 else np.zeros_like(g)
    mask = g >= threshold
    box = [0, h, 0, w]
    for _ in range(trims):
        part = mask[box[0] : box[1], box[2] : box[3]]
        sides = [(0, 1, part[0], part.shape[0]), (1, -1, part[-1], part.shape[0]), (2, 1, part[:, 0], part.shape[1]), (3, -1, part[:, -1], part.shape[1])]
        hit = next((s for s in sides if s[3] > 4 and s[2].mean() >= full), None)
        if hit is None:
            break
        box[hit[0]] += hit[1]
    ys, xs = np.nonzero(mask[box[0] : box[1], box[2] : box[3]])
    y0, y1, x0, x1 = (box[0] + ys.min(), box[0] + ys.max() + 1, box[2] + xs.min(), box[2] + xs.max() + 1) if len(ys) else (0, h, 0, w)
    side = max(y1 - y0, x1 - x0)
    top, left = (int(np.round((a + b) / 2 - side / 2)) for a, b in ((y0, y1), (x0, x1)))  # halves to even
    square = np.zeros((side, side))
    a, b, c, d = max(0, top), min(h, top + side), max(0, left), min(w, left + side)
    square[a - top : b - top, c - left : d - left] = g[a:b, c:d]
    return resized(square, size, size)
