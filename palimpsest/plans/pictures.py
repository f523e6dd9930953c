"""Queries about screens: frames worked out for every supplier, compared, judged, blacked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as V
from ..storage import checkpointed
from .registry import query, table

C = F.col
W, H = 40, 32
#: What each supplier's second frame shows, by its key modulo 5: the same, a spinner, a dialog over a dark page, another page, a moved block.
SAME, SPINNER, DIALOG, OTHER, MOVED = range(5)


def _before(x, y, k):
    return (x * 7 + y * 13 + k * 5) % 64 + 120


def _after(x, y, k, when):
    base = _before(x, y, k)
    kind = k % 5
    spinner = (kind == SPINNER) & (x >= 16) & (x < 24) & (y >= 16) & (y < 24)
    centre = (x >= 12) & (x < 28) & (y >= 10) & (y < 22)
    moved = (kind == MOVED) & (x < 16)
    return when([(spinner, 255 * ((x + y) % 2)), ((kind == DIALOG) & centre, base * 0 + 240), (kind == DIALOG, base * 0 + 40), (kind == OTHER, (x * 11 + y * 3 + k) % 200), (moved, base + 30)], base)


def _case(rows: list, otherwise: Column) -> Column:
    out = None
    for c, v in rows:
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(otherwise)


def pixels(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    at = spark.range(W * H).select((C("id") % W).alias("x"), F.floor(C("id") / W).alias("y"))
    rows = table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("long").alias("frame")).join(F.broadcast(at))
    x, y, k = C("x"), C("y"), C("frame")
    gray = _after(x, y, k, _case) if second else _before(x, y, k)
    return rows.select("frame", "x", "y", gray.cast("double").alias("gray"))


_B = "((x * 7 + y * 13 + k * 5) % 64 + 120)"
_A = f"CASE WHEN k % 5 = 1 AND x >= 16 AND x < 24 AND y >= 16 AND y < 24 THEN 255 * ((x + y) % 2) WHEN k % 5 = 2 AND x >= 12 AND x < 28 AND y >= 10 AND y < 22 THEN 240 WHEN k % 5 = 2 THEN 40 WHEN k % 5 = 3 THEN (x * 11 + y * 3 + k) % 200 WHEN k % 5 = 4 AND x < 16 THEN {_B} + 30 ELSE {_B} END"
PIXELS = f"px AS (SELECT k, x, y, ({_B})::DOUBLE AS a, ({_A})::DOUBLE AS b FROM (SELECT s_suppkey AS k FROM supplier), range({W}) p(x), range({H}) q(y))"
TILES = "tl AS (SELECT k, x // 16 AS tx, y // 16 AS ty, avg(abs(a - b)) >= 8 AS c FROM px GROUP BY ALL)"
VERDICT = "CASE WHEN r <= 0.0008 THEN 'no_change' WHEN r >= 0.35 THEN 'major_change' WHEN r <= 0.06 THEN 'localized_change' ELSE 'partial_change' END"


@query(f"WITH {PIXELS}, {TILES} SELECT k AS frame, n AS changed_tiles, t AS total_tiles, round(r, 6) AS change_ratio, {VERDICT} AS verdict, x0 * 16 AS x, y0 * 16 AS y, least({W}, (x1 + 1) * 16) - x0 * 16 AS width, least({H}, (y1 + 1) * 16) - y0 * 16 AS height FROM (SELECT k, count(*) FILTER (c) AS n, count(*) AS t, count(*) FILTER (c) / count(*) AS r, min(tx) FILTER (c) AS x0, min(ty) FILTER (c) AS y0, max(tx) FILTER (c) AS x1, max(ty) FILTER (c) AS y1 FROM tl GROUP BY k)")
def frame_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each supplier's frame changed, where, and what that is called."""
    out = V.compared(pixels(spark, sf_dir, False), pixels(spark, sf_dir, True))
    return out.select("frame", "changed_tiles", "total_tiles", F.round("change_ratio", 6).alias("change_ratio"), "verdict", "x", "y", "width", "height")


_EDGES = f"eg AS (SELECT *, CASE WHEN x BETWEEN 1 AND {W - 2} AND y BETWEEN 1 AND {H - 2} THEN sqrt(pow(lead(b) OVER r - lag(b) OVER r, 2) + pow(lead(b) OVER d - lag(b) OVER d, 2)) >= 24 END AS e FROM px WINDOW r AS (PARTITION BY k, y ORDER BY x), d AS (PARTITION BY k, x ORDER BY y))"


@query(f"WITH {PIXELS}, {_EDGES} SELECT k AS frame, box_id, count(*) AS n, round(avg(b), 6) AS mean, round(var_pop(b), 4) AS variance, round(coalesce(avg(e::INT), 0), 6) AS edge_density FROM eg JOIN (VALUES (0, 0, 0, 40, 32), (1, 16, 16, 24, 24), (2, 3, 5, 30, 9)) v(box_id, x0, y0, x1, y1) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, variance and edge density of three boxes of each frame."""
    p = pixels(spark, sf_dir, True)
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 40.0, 32.0), (1, 16.0, 16.0, 8.0, 8.0), (2, 3.4, 5.2, 26.3, 3.1)], "box_id int, x double, y double, width double, height double")
    out = V.region_stats(V.with_edges(p), p.select("frame").distinct().join(F.broadcast(boxes)))
    return out.select("frame", "box_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("edge_density", 6).alias("edge_density"))


_RIM = ["t", "b", "l", "r"]
_MEANS = ", ".join(f"avg({p}) FILTER (band = '{n}') AS {p}_{n}" for p in "ab" for n in [*_RIM, "c"])
OVERLAY = (
    f"ov AS (SELECT *, CASE WHEN drop >= 18 AND gap >= 22 AND {' AND '.join(f'a_{n} - b_{n} >= 9' for n in _RIM)} THEN 'high' WHEN gap >= 22 AND spread <= 26 AND v <= 2200 THEN 'moderate' ELSE 'none' END AS confidence FROM (SELECT *, b_c - m AS gap, am - m AS drop, greatest(b_t, b_b, b_l, b_r) - least(b_t, b_b, b_l, b_r) AS spread FROM "
    f"(SELECT k, {_MEANS}, avg(b) FILTER (band <> 'c') AS m, avg(a) FILTER (band <> 'c') AS am, var_pop(b) FILTER (band <> 'c') AS v FROM (SELECT *, CASE WHEN y < 3 THEN 't' WHEN y >= {H - 3} THEN 'b' WHEN x < 4 THEN 'l' WHEN x >= {W - 4} THEN 'r' ELSE 'c' END AS band FROM px) GROUP BY k)))"
)


@query(f"WITH {PIXELS}, {OVERLAY} SELECT k AS frame, confidence, round(gap, 6) AS contrast_gap, round(drop, 6) AS perimeter_drop, round(spread, 6) AS spread, round(v, 4) AS pooled_variance FROM ov")
def overlay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a dialog darkens the page around it."""
    out = V.overlays(pixels(spark, sf_dir, True), pixels(spark, sf_dir, False))
    return out.filter("frame is not null").select("frame", "confidence", F.round("contrast_gap", 6).alias("contrast_gap"), F.round("perimeter_drop", 6).alias("perimeter_drop"), F.round("spread", 6).alias("spread"), F.round("pooled_variance", 4).alias("pooled_variance"))


@query(f"WITH {PIXELS}, {OVERLAY} SELECT k AS frame, CASE k % 5 WHEN 0 THEN 'no_animation' ELSE 'change_too_large' END AS reason, CASE WHEN k % 5 = 0 THEN 'flag_ineffective_action' WHEN confidence <> 'none' THEN 'constrain_to_dialog' END AS decision FROM ov")
def screen_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen after a click asks for. With 6 tiles to a frame any change is too large for a spinner."""
    before, after = pixels(spark, sf_dir, False), pixels(spark, sf_dir, True)
    changes = checkpointed(V.compared(before, after))
    rows = changes.join(V.loading(changes, after), "frame").join(V.overlays(after, before).select("frame", "has_overlay"), "frame")
    return rows.select("frame", "reason", V.visual_decision(F.lit(True), C("is_loading"), F.lit("click"), C("verdict"), C("has_overlay")).alias("decision"))


@query(f"WITH {PIXELS} SELECT k AS frame, sum(CASE WHEN (x >= k % 20 AND x < k % 20 + 10 AND y >= 4 AND y < 12) OR (x >= 30 AND y >= 20) THEN 0 ELSE b END) AS total FROM px GROUP BY k")
def blacked_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's light after two boxes are blacked out."""
    p = pixels(spark, sf_dir, True)
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    boxes = p.select("frame").distinct().select("frame", F.explode(F.array(box(C("frame") % 20, 4.0, 10.0, 8.0), box(F.lit(30), 20.0, 10.0, 12.0))).alias("b")).select("frame", "b.*")
    return V.blacked_out(p, boxes).groupBy("frame").agg(F.sum("gray").alias("total"))
