"""Queries about places: frames in frames, what lies on top, selectors through shadow roots, reading order, connected regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..operators import boundary, boxes, frames, grid, images, layout, proofs, reports
from ..sources import elements as parsed
from ..storage import checkpointed, spread
from .catalog import _CHUNKS, _tree, merkle_root
from .made import ELEMENTS, elements
from .registry import query, table

C = F.col
S = lambda x: x.cast("string")

_FRAMES = "f AS (SELECT page_id, i AS frame_id, CASE WHEN i = 0 THEN NULL WHEN page_id % 2 = 0 THEN i - 1 ELSE (i - 1) // 2 END AS parent_id, CASE WHEN (page_id + i * 3) % 17 <> 0 THEN (page_id * 7 + i * 13) % 300 + (i % 2) * 0.5 END AS x, ((page_id + i * 11) % 200)::DOUBLE AS y FROM (SELECT page_id, unnest(range(0, page_id % 12 + 1)) AS i FROM pages))"


@query(
    f"WITH RECURSIVE {_FRAMES}, c AS (SELECT page_id, frame_id, x AS dx, y AS dy FROM f WHERE parent_id IS NULL UNION ALL SELECT f.page_id, f.frame_id, c.dx + f.x, c.dy + f.y FROM f JOIN c ON c.page_id = f.page_id AND c.frame_id = f.parent_id) "
    "SELECT page_id, frame_id, CAST(CASE WHEN dx IS NOT NULL THEN floor(dx + 0.5) END AS BIGINT) AS dx, CAST(CASE WHEN dx IS NOT NULL THEN floor(dy + 0.5) END AS BIGINT) AS dy, dx IS NOT NULL AS known FROM c"
)
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the frames of every page are, up to twelve of them in chains or trees, some of another origin."""
    i, p = C("frame_id"), C("page_id")
    rows = table(spark, sf_dir, "pages").select(p, F.explode(F.sequence(F.lit(0).cast("bigint"), p % 12)).alias("frame_id"))
    parent = F.when(i == 0, None).when(p % 2 == 0, i - 1).otherwise(F.floor((i - 1) / 2))
    return layout.frame_offsets(rows.select(p, i, parent.alias("parent_id"), F.when((p + i * 3) % 17 != 0, (p * 7 + i * 13) % 300 + (i % 2) * 0.5).alias("x"), ((p + i * 11) % 200).alias("y")))


#: Boxes over each other in a positioned one, each with a small one inside; some hidden, some on a layer of their own.
_STACK = 8


def _stack(p):
    """HTML of the boxes of page p."""
    out = [F.lit('<div id="stack" style="position: relative; left: 10px; top: 20px; width: 800px; height: 600px">')]
    for i in range(_STACK):
        z = F.lit("") if i % 3 == 0 else F.concat(F.lit("; z-index: "), S((p * 3 + i * 7) % 5 - 1))
        hidden = F.when((p + i) % 6 == 0, "; display: none").otherwise("")
        place = [F.lit(f'<div id="b{i}" style="position: absolute; left: '), S((p * 7 + i * 37) % 200), F.lit("px; top: "), S((p * 11 + i * 53) % 150), F.lit("px; width: "), S(F.lit(40) + (p + i * 17) % 160), F.lit("px; height: "), S(F.lit(30) + (p * 3 + i * 5) % 90), F.lit("px")]
        out += [*place, z, hidden, F.lit(f'"><span id="c{i}" style="position: absolute; left: 5px; top: 5px; width: 20px; height: 10px"></span></div>')]
    return F.concat(*out, F.lit("</div>"))


_NODES = (
    f"b AS (SELECT page_id, i, (page_id * 7 + i * 37) % 200 + 10 AS x, (page_id * 11 + i * 53) % 150 + 20 AS y, 40 + (page_id + i * 17) % 160 AS w, 30 + (page_id * 3 + i * 5) % 90 AS h, CASE WHEN i % 3 <> 0 THEN (page_id * 3 + i * 7) % 5 - 1 END AS z, (page_id + i) % 6 <> 0 AS shown FROM (SELECT page_id, unnest(range(0, {_STACK})) AS i FROM pages)), "
    f"n AS (SELECT page_id, 1 AS ord, {2 * _STACK + 1} AS last, 10 AS x, 20 AS y, 800 AS w, 600 AS h, true AS shown, [[0, 1]] AS layer FROM pages UNION ALL SELECT page_id, 2 + 2 * i, 3 + 2 * i, x, y, w, h, shown, [[coalesce(z, 0), 2 + 2 * i]] FROM b "
    "UNION ALL SELECT page_id, 3 + 2 * i, 3 + 2 * i, x + 5, y + 5, 20, 10, shown, CASE WHEN z IS NULL THEN [[0, 3 + 2 * i]] ELSE [[z, 2 + 2 * i], [0, 3 + 2 * i]] END FROM b)"
)


@query(
    f"WITH {_NODES}, t AS (SELECT a.page_id, a.ord, arg_max(o.ord, o.layer) AS top_ord, arg_max(o.last, o.layer) AS top_last FROM n a JOIN n o ON o.page_id = a.page_id AND o.shown AND a.x + a.w / 2 >= o.x AND a.x + a.w / 2 < o.x + o.w AND a.y + a.h / 2 >= o.y AND a.y + a.h / 2 < o.y + o.h WHERE a.shown GROUP BY ALL) "
    "SELECT n.page_id, CAST(n.ord AS INTEGER) AS ord, CAST(t.top_ord AS INTEGER) AS top_ord, coalesce(t.top_ord BETWEEN n.ord AND n.last OR n.ord BETWEEN t.top_ord AND t.top_last, false) AS visible FROM n LEFT JOIN t USING (page_id, ord)"
)
def hit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on top of each of the boxes put before every page, and which of them are to be seen."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(_stack(C("page_id")), F.coalesce("html", F.lit(""))).alias("html"))
    nodes = layout.placed(parsed.page_boxes(p).select("page_id", "ord", "last", "up", "shown", "left", "top", "width", "height", "z"))
    return layout.hit_tested(nodes, 1024, 768).filter(C("ord") <= 2 * _STACK + 1).select("page_id", "ord", "top_ord", "visible")


_PATHS = "array_to_string(list_transform(range(1, {0} + 1), lambda i: '#h' || i), ' >>> ')"


@query(
    f"WITH d AS (SELECT page_id, page_id % 7 + 1 AS d FROM pages) SELECT page_id, {_PATHS.format('k')} AS selector, CAST(2 * k - 1 AS INTEGER) AS ord FROM (SELECT page_id, unnest(range(1, d + 1)) AS k FROM d) "
    f"UNION ALL SELECT page_id, {_PATHS.format('d')} || ' >>> #go', CAST(2 * d + 1 AS INTEGER) FROM d UNION ALL SELECT page_id, '#h2', NULL FROM d"
)
def pierced_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors through up to seven shadow roots put before every page, and one that does not step into its root."""
    p, d = C("page_id"), C("page_id") % 7 + 1
    one = F.lit(1).cast("bigint")
    opened = F.array_join(F.transform(F.sequence(one, d), lambda i: F.concat(F.lit('<x-box id="h'), S(i), F.lit('"><template shadowrootmode="open">'))), "")
    html = F.concat(opened, F.lit('<button id="go">go</button>'), F.repeat(F.lit("</template></x-box>"), d.cast("int")), F.coalesce("html", F.lit("")))
    pages = table(spark, sf_dir, "pages")
    path = lambda n: F.array_join(F.transform(F.sequence(one, n), lambda i: F.concat(F.lit("#h"), S(i))), " >>> ")
    wanted = pages.select(p, F.explode(F.concat(F.transform(F.sequence(one, d), path), F.array(F.concat(path(d), F.lit(" >>> #go")), F.lit("#h2")))).alias("selector"))
    return layout.named(wanted, layout.pierced(parsed.page_boxes(pages.select(p, html.alias("html"))).select("page_id", "ord", "host", "selector"))).select("page_id", "selector", "ord")


# Pictures ----------------------------------------------------------------------------------------

#: Three by two cells of 20 pixels for each supplier, each with a patch of its own size and probability, over the edges of tiles.
_ACROSS, _DOWN, _CELL = 3, 2, 20
_PATCHES = f"(SELECT s_suppkey AS k, i, j, 3 + (s_suppkey + i) % 12 AS w, 4 + (s_suppkey + j * 5) % 9 AS h, (s_suppkey * 3 + i * 5 + j * 7) % 5 AS a, (s_suppkey + i + j) % 4 AS b, 0.45 + (s_suppkey + i * 2 + j) % 5 * 0.1 AS p FROM supplier, range({_ACROSS}) r(i), range({_DOWN}) q(j))"


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i, j = C("k"), C("i"), C("j")
    rows = table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(_ACROSS - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(_DOWN - 1))))
    return rows.select(k, i, j, (3 + (k + i) % 12).alias("w"), (4 + (k + j * 5) % 9).alias("h"), ((k * 3 + i * 5 + j * 7) % 5).alias("a"), ((k + i + j) % 4).alias("b"), (0.45 + (k + i * 2 + j) % 5 * 0.1).alias("p"))


def _text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("bigint")
    at = _patches(spark, sf_dir).withColumn("dx", F.explode(F.sequence(one * 0, C("w") - 1))).withColumn("dy", F.explode(F.sequence(one * 0, C("h") - 1)))
    lit = at.select(C("k").alias("frame"), (C("i") * _CELL + C("a") + C("dx")).alias("x"), (C("j") * _CELL + C("b") + C("dy")).alias("y"), C("p").alias("value"))
    # the map is padded to a multiple of 32 and a third as large again as the picture
    sizes = table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("long").alias("frame"), *(F.lit(n).alias(c) for c, n in (("width", 48), ("height", 48), ("map_width", 64), ("map_height", 64))))
    return frames.text_boxes(lit, sizes)


_BOXES = (
    f"(SELECT k AS frame, greatest(0, (x0 - d) * 0.75) AS x, greatest(0, (y0 - d) * 0.75) AS y, least(48, (x0 + w + d) * 0.75) - greatest(0, (x0 - d) * 0.75) AS width, least(48, (y0 + h + d) * 0.75) - greatest(0, (y0 - d) * 0.75) AS height, p AS score FROM "
    f"(SELECT k, w, h, p, i * {_CELL} + a AS x0, j * {_CELL} + b AS y0, w * h * 1.5 / (2 * (w + h)) AS d FROM {_PATCHES} WHERE least(w, h) >= 5 AND p >= 0.6 - 1e-9))"
)
_SIDES = ("x", "y", "width", "height")


@query(f"SELECT frame, {', '.join(f'round({c}, 4)::DOUBLE AS {c}' for c in _SIDES)}, round(score, 4)::DOUBLE AS score FROM {_BOXES} WHERE width >= 1 AND height >= 1")
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of what a map of probabilities for each supplier holds as text, grown and mapped back."""
    return _text_boxes(spark, sf_dir).select("frame", *(F.round(c, 4).alias(c) for c in (*_SIDES, "score")))


@query(
    f"WITH b AS (SELECT * FROM {_BOXES} WHERE width >= 1 AND height >= 1), m AS (SELECT *, max(y + height * 0.75) OVER (PARTITION BY frame ORDER BY y + height / 4, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b), "
    "l AS (SELECT *, CAST(sum(CASE WHEN far IS NULL OR y + height / 4 >= far THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY y + height / 4, x) AS INTEGER) AS line FROM m) "
    "SELECT frame, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, line, CAST(row_number() OVER (PARTITION BY frame ORDER BY line, x, y) AS INTEGER) AS place FROM l"
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that those boxes are read in."""
    return frames.reading_order(_text_boxes(spark, sf_dir), "frame").select("frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "line", "place")


# Proofs, detectors, questions --------------------------------------------------------------------

_KEY = "a session's key"


def _pads(key: str) -> tuple[str, str]:
    return tuple(bytes(b ^ x for b in key.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


_IN, _OUT = _pads(_KEY)


@query(f"WITH {_tree(6)} SELECT doc_id, h[1] AS root, sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || unhex(h[1])))) AS signature, true AS genuine, false AS forged FROM l6")
def signed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of every document signed under a key; a root that was changed isn't the signed one."""
    key = F.lit(_KEY)
    rows = proofs.signed(merkle_root(spark, sf_dir), key)
    other = F.translate("root", "0123456789abcdef", "123456789abcdef0")
    return rows.select("doc_id", "root", "signature", proofs.genuine(C("root"), C("signature"), key).alias("genuine"), proofs.genuine(other, C("signature"), key).alias("forged"))


#: Detectors of a user: words in -ing, and those of seven letters that none of the former has taken.
OWN_DETECTORS = [
    {"order": 1.0, "type": "ENDING", "pattern": "(?<![A-Za-z])[A-Za-z]*ing(?![A-Za-z])", "guard": "ing", "gate": "claims", "validator": None, "confidence": 0.7},
    {"order": 2.0, "type": "SEVEN", "pattern": "(?<![A-Za-z])[A-Za-z]{7}(?![A-Za-z])", "guard": None, "gate": "gated", "validator": None, "confidence": None},
]


@query("SELECT doc_id, CAST(len(list_filter(w, lambda x: ends_with(x, 'ing'))) AS INTEGER) AS endings, CAST(len(list_filter(w, lambda x: len(x) = 7 AND NOT ends_with(x, 'ing'))) AS INTEGER) AS sevens FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents)")
def own_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors of a registry find in every document: the second only what the first has not claimed."""
    found = detect.entities(C("text"), detectors=detect.registered(OWN_DETECTORS))
    n = lambda kind: F.size(F.filter("e", lambda x: x["type"] == kind))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("e")).select("doc_id", n("ENDING").alias("endings"), n("SEVEN").alias("sevens"))


_ASKED = ["the", "and", "order"]


@query(
    "WITH l AS (SELECT doc_id, k - 1 AS line_no, CASE WHEN contains(t, '@') THEN '[REDACTED LINE]' ELSE left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 200) END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)), "
    f"s AS (SELECT *, len(list_filter({_ASKED}, lambda w: contains(lower(line), w))) AS hits FROM l WHERE line <> ''), r AS (SELECT *, row_number() OVER w AS k, sum(length(line) + 1) OVER w AS upto FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, line_no)) "
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, string_agg(line, chr(10) ORDER BY line_no) AS said FROM r WHERE k <= 60 AND upto <= 4000 GROUP BY doc_id"
)
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that a question about it may be answered from: shown as redacted, the likeliest first within a budget."""
    lines = boundary.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    shown = lines.withColumn("line", F.when(F.contains("line", F.lit("@")), "[REDACTED LINE]").otherwise(C("line")))
    return reports.question_lines(shown, "doc_id", "line_no", "line", _ASKED, budget=4000).select("doc_id", "n_lines", "chars", "said")


# Images as bytes ---------------------------------------------------------------------------------

_W, _H = "(16 + k % 25)", "(8 + k % 17)"
_BYTE = "((x * 7 + y * 13 + k * 5 + b * 31) % 256)"


def _images(spark: SparkSession, sf_dir: str, bands: int) -> DataFrame:
    """A small picture for each supplier, its bytes worked out from its key."""
    rows = spread(table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("long").alias("k")), "k").select("k", F.expr(_W).cast("int").alias("width"), F.expr(_H).cast("int").alias("height"))
    byte = F.expr(f"array_join(transform(sequence(0L, cast(width * height * {bands} - 1 as bigint)), i -> lpad(hex((((i div {bands}) % width) * 7 + ((i div {bands}) div width) * 13 + k * 5 + (i % {bands}) * 31) % 256), 2, '0')), '')")
    return rows.select(C("k").alias("image_id"), "width", "height", F.unhex(byte).alias("pixels"))


_TILE_ROWS = f"range(y0, least(y0 + 16, {_H}))"
_TILES = (
    f"tl AS (SELECT k AS doc_id, index, sha256(unhex(array_to_string(list_transform({_TILE_ROWS}, lambda y: array_to_string(list_transform(range(x0 * 4, least(x0 + 16, {_W}) * 4), lambda i: printf('%02x', (((i // 4) * 7 + y * 13 + k * 5 + (i % 4) * 31) % 256)::INTEGER)), '')), ''))) AS h "
    f"FROM (SELECT k, i AS index, (i % ceil({_W} / 16)::BIGINT) * 16 AS x0, (i // ceil({_W} / 16)::BIGINT) * 16 AS y0 FROM (SELECT k, unnest(range(0, ceil({_W} / 16)::BIGINT * ceil({_H} / 16)::BIGINT)) AS i FROM (SELECT s_suppkey AS k FROM supplier))))"
)


@query(f"WITH {_TILES}, {_tree(3).replace(_CHUNKS, 'SELECT doc_id, index, h FROM tl')} SELECT doc_id AS image_id, h[1] AS root, true AS verified FROM l3")
def image_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over the tiles of each supplier's picture, and whether the proofs of all its tiles lead there."""
    tree = proofs.levels(images.tile_leaves(_images(spark, sf_dir, 4), 16), "image_id")
    leaves = tree.filter("level = 0").select("image_id", "index", "hash")
    roots = proofs.roots(tree, "image_id")
    found = proofs.proofs(tree, leaves.select("image_id", "index"), "image_id").join(leaves, ["image_id", "index"]).join(roots, "image_id")
    return found.groupBy("image_id", "root").agg(F.bool_and(proofs.recomputed(C("hash"), C("path")) == C("root")).alias("verified"))


def _axis(n: int, of: str, i: str) -> str:
    return f"(({i} + 0.5) * ({of}::DOUBLE / {n}) - 0.5)"


def _clip(at: str, of: str) -> str:
    return f"least(greatest({at}, 0), {of} - 1)"


_AY, _AX = _axis(6, _H, "j"), _axis(8, _W, "i")
_LIGHT = "((({x}) * 7 + ({y}) * 13 + k * 5) % 256)"
_AT = lambda dx, dy: _LIGHT.format(x=_clip(f"floor({_AX}) + {dx}", _W), y=_clip(f"floor({_AY}) + {dy}", _H))
_FX, _FY = f"({_AX} - floor({_AX}))", f"({_AY} - floor({_AY}))"


@query(
    f"SELECT k AS image_id, CAST(j * 8 + i AS INTEGER) AS place, round(({_AT(0, 0)} * (1 - {_FX}) + {_AT(1, 0)} * {_FX}) * (1 - {_FY}) + ({_AT(0, 1)} * (1 - {_FX}) + {_AT(1, 1)} * {_FX}) * {_FY}, 2)::DOUBLE AS light FROM (SELECT s_suppkey AS k FROM supplier), range(8) p(i), range(6) q(j)"
)
def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's gray picture as eight by six pixels."""
    out = images.resized_to(_images(spark, sf_dir, 1), 8, 6, bands=1)
    return out.select("image_id", F.posexplode("values").alias("place", "light")).select("image_id", "place", F.round("light", 2).alias("light"))


# Boxes of pages ----------------------------------------------------------------------------------

_BX = f"WITH {ELEMENTS}, bx AS (SELECT page_id AS image, ord AS box_id, x / 4 AS x, y / 4 AS y, width, height, 1 - (ord * 7 % 40) / 50 AS score FROM el)"
_OW, _OH = "greatest(0, least({0}.x + {0}.width, {1}.x + {1}.width) - greatest({0}.x, {1}.x))", "greatest(0, least({0}.y + {0}.height, {1}.y + {1}.height) - greatest({0}.y, {1}.y))"


def _iou(a: str, b: str) -> str:
    both = f"({_OW} * {_OH})".format(a, b)
    return f"({both} / ({a}.width * {a}.height + {b}.width * {b}.height - {both}))"


def _element_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(1.0) - (C("ord") * 7 % 40) / 50
    return elements(spark, sf_dir).select(C("page_id").alias("image"), C("ord").alias("box_id"), (C("x") / 4).alias("x"), (C("y") / 4).alias("y"), "width", "height", score.alias("score"))


@query(f"{_BX} SELECT a.image, a.box_id AS a, b.box_id AS b, round({_iou('a', 'b')}, 6) AS iou FROM bx a JOIN bx b ON a.image = b.image AND a.box_id < b.box_id AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two elements of a page, drawn closer together, that share some area, and how much of both that is."""
    box = lambda p: tuple(f"{p}_{n}" for n in ("x", "y", "width", "height"))
    return grid.overlapping(_element_boxes(spark, sf_dir), "box_id", "image").select("image", "a", "b", F.round(boxes.iou(box("a"), box("b")), 6).alias("iou"))


@query(f"{_BX} SELECT image, box_id, r * 12 + c AS tile FROM bx, range(12) p(c), range(10) q(r) WHERE x < (c + 1) * 100 AND x + width > c * 100 AND y < (r + 1) * 100 AND y + height > r * 100")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a page's first 1200 by 1000 pixels that each element touches."""
    return boxes.tiles(_element_boxes(spark, sf_dir), 100, 12, 10).select("image", "box_id", C("tile").cast("long").alias("tile"))


@query(
    f"{_BX}, g AS (SELECT image, list(struct_pack(box_id := box_id, x := x, y := y, width := width, height := height) ORDER BY score DESC, box_id) AS l FROM bx GROUP BY image), "
    f"k AS (SELECT image, list_reduce(list_transform(l, lambda b: [b]), lambda acc, n: CASE WHEN len(list_filter(acc, lambda k: {_iou('k', 'n[1]')} >= 0.3)) > 0 THEN acc ELSE list_concat(acc, n) END) AS l FROM g) SELECT image, unnest(list_transform(l, lambda b: b.box_id)) AS box_id FROM k"
)
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page's elements those that no better one covers by three tenths."""
    return boxes.suppressed(_element_boxes(spark, sf_dir), "image").select("image", "box_id")


# Loading -----------------------------------------------------------------------------------------

#: Frames of five by four tiles, so that one tile is few enough to be a spinner. What the second shows, by the key modulo 5: the same, a spinner, a flat patch, two patches far apart, another page.
_LW, _LH = 80, 64
_LA = "((x * 3 + y * 5 + k) % 16 + 100)"
_LB = f"CASE WHEN k % 5 = 1 AND x >= 32 AND x < 48 AND y >= 16 AND y < 32 THEN 255 * ((x // 2 + y // 2) % 2) WHEN k % 5 = 2 AND x >= 16 AND x < 32 AND y >= 16 AND y < 32 THEN 200 WHEN k % 5 = 3 AND ((x < 4 AND y < 4) OR (x >= 76 AND y < 4)) THEN 255 WHEN k % 5 = 4 THEN (x * 11 + y * 3 + k) % 200 ELSE {_LA} END"
_LPX = f"px AS (SELECT k, x, y, ({_LA})::DOUBLE AS a, ({_LB})::DOUBLE AS b FROM (SELECT s_suppkey AS k FROM supplier), range({_LW}) p(x), range({_LH}) q(y))"


@query(
    f"WITH {_LPX}, tl AS (SELECT k, x // 16 AS tx, y // 16 AS ty, avg(abs(a - b)) >= 8 AS c FROM px GROUP BY ALL), v AS (SELECT k, count(*) FILTER (c) / count(*) AS r, min(tx) FILTER (c) * 16 AS x0, min(ty) FILTER (c) * 16 AS y0, (max(tx) FILTER (c) + 1) * 16 AS x1, (max(ty) FILTER (c) + 1) * 16 AS y1 FROM tl GROUP BY k), "
    f"eg AS (SELECT *, CASE WHEN x BETWEEN 1 AND {_LW - 2} AND y BETWEEN 1 AND {_LH - 2} THEN sqrt(pow(lead(b) OVER r - lag(b) OVER r, 2) + pow(lead(b) OVER d - lag(b) OVER d, 2)) >= 24 END AS e FROM px WINDOW r AS (PARTITION BY k, y ORDER BY x), d AS (PARTITION BY k, x ORDER BY y)), "
    "n AS (SELECT v.k, avg(e::INT) AS edges FROM v JOIN eg ON eg.k = v.k AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY v.k), "
    f"o AS (SELECT v.k, CASE WHEN x0 IS NULL OR r <= 0.0008 THEN 'no_animation' WHEN r > 0.06 THEN 'change_too_large' WHEN greatest(x1 - x0, y1 - y0) / {_LH} > 0.28 THEN 'change_not_compact' WHEN edges < 0.05 THEN 'region_unstructured' ELSE 'compact_structured_animation' END AS reason FROM v LEFT JOIN n USING (k)) "
    "SELECT k AS frame, reason, reason = 'compact_structured_animation' AS is_loading, CASE WHEN reason = 'compact_structured_animation' THEN 'wait' WHEN k % 5 = 0 THEN 'flag_ineffective_action' END AS decision FROM o"
)
def loading_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of each supplier's screens is still loading, and what that asks for after a click."""
    x, y, k = C("x"), C("y"), C("frame")
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_LW * _LH - 1).cast("bigint")))
    grid_ = table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("long").alias("frame"), at.alias("i")).select("frame", (C("i") % _LW).alias("x"), F.floor(C("i") / _LW).alias("y"))
    a = (x * 3 + y * 5 + k) % 16 + 100
    spinner, flat = (k % 5 == 1) & x.between(32, 47) & y.between(16, 31), (k % 5 == 2) & x.between(16, 31) & y.between(16, 31)
    apart = (k % 5 == 3) & (y < 4) & ((x < 4) | (x >= 76))
    b = F.when(spinner, 255 * ((F.floor(x / 2) + F.floor(y / 2)) % 2)).when(flat, 200).when(apart, 255).when(k % 5 == 4, (x * 11 + y * 3 + k) % 200).otherwise(a)
    frame = lambda g: grid_.select("frame", "x", "y", g.cast("double").alias("gray"))
    before, after = frame(a), frame(b)
    changes = checkpointed(frames.compared(before, after))
    rows = changes.join(frames.loading(changes, after), "frame")
    return rows.select("frame", "reason", "is_loading", frames.visual_decision(F.lit(True), C("is_loading"), F.lit("click"), C("verdict"), F.lit(False)).alias("decision"))
