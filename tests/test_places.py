"""Layout, connected parts, joins by keys, signatures, detectors and scrubbing against brute force and published vectors."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import detect
from palimpsest.operators import boxes, decisions, frames, grid, layout, linking, proofs, reports, stores
from palimpsest.sources import elements as parsed


def test_points_boxes_and_centres(spark):
    r = random.Random(1)
    points = [(p, i, r.uniform(-50, 900), r.uniform(-50, 900)) for p in (1, 2) for i in range(60)] + [(1, 90, 100.0, 100.0), (3, 91, 5.0, 5.0), (1, 92, None, 4.0)]
    made = [(p, i, r.uniform(-40, 800), r.uniform(-40, 800), r.choice((0.0, 3.0, 31.9, 32.0, 200.0, 3000.0)), r.choice((1.0, 64.0, 500.0))) for p in (1, 2) for i in range(80)] + [(1, 90, 100.0, 100.0, 0.0, 0.0), (1, 91, None, 1.0, 2.0, 3.0), (1, 92, float("nan"), 1.0, 2.0, 3.0)]
    pdf = spark.createDataFrame(points, "page long, pid long, px double, py double")
    bdf = spark.createDataFrame(made, "page long, bid long, x double, y double, width double, height double")
    want = sorted((pid, bid) for p, pid, px, py in points for q, bid, x, y, w, h in made if p == q and px is not None and x is not None and x <= px <= x + w and y <= py <= y + h)
    assert sorted((a["pid"], a["bid"]) for a in grid.containing(pdf, bdf, "page").select("pid", "bid").collect()) == want
    cdf = bdf.filter("not isnan(x)").select("page", "bid", F.col("x").alias("cx"), F.col("y").alias("cy"))
    want = sorted((pid, bid) for p, pid, px, py in points for q, bid, x, y, w, h in made if p == q and px is not None and x is not None and x == x and ((px - x) ** 2 + (py - y) ** 2) ** 0.5 <= 45)
    assert sorted((a["pid"], a["bid"]) for a in grid.near(pdf, cdf, 45.0, "page").select("pid", "bid").collect()) == want


def test_overlaps_and_suppression(spark):
    r = random.Random(7)
    made = [(p, i, r.uniform(-60, 500), r.uniform(-60, 500), r.choice((0.0, 5.0, 32.0, 64.0, 300.0, 2000.0)), r.choice((8.0, 32.0, 90.0, 700.0)), r.choice((0.1, 0.5, 0.9))) for p in (1, 2) for i in range(70)]
    df = spark.createDataFrame(made, "image long, box_id long, x double, y double, width double, height double, score double")
    shared = lambda a, b: max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    want = sorted((a[0], a[1], b[1]) for a in made for b in made if a[0] == b[0] and a[1] < b[1] and shared(a, b) > 0)
    assert sorted((x["image"], x["a"], x["b"]) for x in grid.overlapping(df, "box_id", "image").collect()) == want
    for threshold in (0.05, 0.3):
        kept = []
        for a in sorted(made, key=lambda a: (a[0], -a[6], a[1])):
            if all(k[0] != a[0] or not (u := a[4] * a[5] + k[4] * k[5] - shared(a, k)) > 0 or shared(a, k) / u < threshold for k in kept):
                kept.append(a)
        assert sorted((x["image"], x["box_id"]) for x in boxes.suppressed(df, "image", threshold).collect()) == sorted(k[:2] for k in kept)


def test_a_page_of_many_elements_has_no_quadratic_step(spark):
    """Thousands of elements and points on one page: pairs stay near the number of points."""
    n = 20_000
    el = spark.range(n).select(F.lit(1).alias("page_id"), F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("ord"), (F.col("id") % 200 * 50).cast("double").alias("x"), (F.floor(F.col("id") / 200) * 50).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(40.0).alias("height"))
    pts = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").alias("point_id"), (F.col("id") % 200 * 50 + 5).cast("double").alias("px"), (F.floor(F.col("id") / 200) * 50 + 45).cast("double").alias("py"))
    assert grid.containing(pts, el, "page_id").count() == 0
    full = el.withColumns({"tag": F.lit("a"), "type": F.lit("link"), "text": F.lit("t"), "aria_label": F.lit(None).cast("string"), "in_modal": F.lit(False), "enabled": F.lit(True), "visible": F.lit(True)})
    got = boxes.grounded(pts, full)
    assert got.filter("element_id = concat('e', point_id) and method = 'APPROXIMATE_PROXIMITY'").count() == n


def test_targets_by_endings(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("#ab1[") for _ in range(r.randint(1, 5)))
    els = [(p, f"e{i}", r.choice((None, "", word() + word(), word())), i) for p in (1, 2) for i in range(40)]
    asked = [(p, r.choice((None, " ", word(), word().upper(), "#" + word(), f"#e{i}", f"e{i}", word() + (els[i % 40][2] or "")))) for p in (1, 2) for i in range(120)]
    got = decisions.resolved(spark.createDataFrame(asked, "page_id long, target string"), spark.createDataFrame(els, "page_id long, id string, selector string, ord long"))

    def tier(t, sel, i):
        if t == sel:
            return 1
        if t == "#" + i:
            return 2
        if t == i:
            return 3
        if sel and t.startswith("#") and t in sel:
            return 4
        if sel and (sel.lower().endswith(t.lower()) or t.lower().endswith(sel.lower())):
            return 5
        return None

    want = []
    for p, t in asked:
        t = (t or "").strip()
        best = min(((k, o, i) for q, i, s, o in els if q == p and t and (k := tier(t, (s or "").strip() or None, i))), default=(None, None, None))
        want.append((p, t, best[2], best[0]))
    assert sorted(map(repr, want)) == sorted(repr((x["page_id"], (x["target"] or "").strip(), x["element_id"], x["tier"])) for x in got.collect())


def test_frames_in_frames(spark):
    deep = [(1, i, None if i == 0 else i - 1, 1.5, 2.0) for i in range(70)]
    odd = [(2, 0, None, 3.0, None), (2, 1, 0, 1.0, 1.0), (2, 2, 99, 1.0, 1.0), (2, 3, 2, 1.0, 1.0), (2, 4, 5, 1.0, 1.0), (2, 5, 4, 1.0, 1.0), (2, 6, 6, 0.0, 0.0), (3, 0, None, -2.5, 0.4)]
    df = spark.createDataFrame(deep + odd, "page_id long, frame_id long, parent_id long, x double, y double")
    got = {(r["page_id"], r["frame_id"]): (r["dx"], r["dy"], r["known"]) for r in layout.frame_offsets(df).collect()}
    assert len(got) == len(deep) + len(odd)
    assert got[1, 69] == (105, 140, True) and got[1, 0] == (2, 2, True) and got[3, 0] == (-2, 0, True)
    assert all(got[2, i] == (None, None, False) for i in range(7))
    assert layout.frame_offsets(df.limit(0)).count() == 0


def test_hit_test(spark):
    """A dialog over a button hides it; contexts of a lower layer stay below whatever they hold; shadow content belongs to its host."""
    html = """<div id=low style="position:absolute;left:0;top:0;width:100px;height:100px;z-index:1"><b id=deep style="position:absolute;left:10px;top:10px;width:50px;height:50px;z-index:999"></b></div>
    <div id=high style="position:absolute;left:0;top:0;width:80px;height:80px;z-index:2"></div><x-a id=host style="position:fixed;left:200px;top:0;width:40px;height:40px"><template shadowrootmode=open><i id=in style="position:absolute;left:0;top:0;width:40px;height:40px"></i></template></x-a>
    <p id=gone style="position:absolute;left:300px;top:0;width:9px;height:9px;display:none"></p><p id=off style="position:absolute;left:-50px;top:0;width:9px;height:9px"></p><p id=flow></p>"""
    nodes = layout.placed(parsed.page_boxes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")))
    got = {r["id"]: r for r in layout.hit_tested(nodes, 1024, 768).collect()}
    assert {k: r["visible"] for k, r in got.items() if k} == {"low": False, "deep": False, "high": True, "host": True, "in": True, "gone": False, "off": False, "flow": False}
    assert got["deep"]["top_ord"] == got["high"]["ord"] and (got["in"]["x"], got["deep"]["x"]) == (200.0, 10.0)


def test_selectors_through_hosts(spark):
    html = "<x-a id=a><template shadowrootmode=open><x-b id=b><template shadowrootmode=open><button id=go>x</button></template></x-b></template></x-a><button name=n>y</button>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    nodes = layout.pierced(parsed.page_boxes(pages))
    whole = {r["ord"]: r["selector"] for r in parsed.page_items(pages).filter("kind = 'element'").collect()}
    assert {r["ord"]: r["path"] for r in nodes.filter("tag = 'button'").collect()} == whole
    asked = spark.createDataFrame([(1, "#a>>>#b  >>> #go"), (1, "#go"), (1, None), (2, "#a")], "page_id long, selector string")
    got = {r["selector"]: r["ord"] for r in layout.named(asked, nodes).filter("page_id = 1").collect()}
    assert got == {"#a>>>#b  >>> #go": 5, "#go": None, None: None}


def flooded(lit):
    left, out = set(lit), []
    while left:
        part, open_ = set(), [left.pop()]
        while open_:
            x, y = open_.pop()
            part.add((x, y))
            for at in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if at in left:
                    left.remove(at)
                    open_.append(at)
        out.append((len(part), min(x for x, _ in part), min(y for _, y in part), max(x for x, _ in part), max(y for _, y in part)))
    return sorted(out)


@pytest.mark.parametrize("size", [4, 64])
def test_connected_parts(spark, size):
    r = random.Random(size)
    spiral = {(x, 0) for x in range(20)} | {(19, y) for y in range(20)} | {(x, 19) for x in range(20)} | {(0, y) for y in range(3, 20)} | {(x, 3) for x in range(16)}
    shots = {1: {(x, y) for x in range(30) for y in range(23) if r.random() < 0.55}, 2: spiral, 3: {(0, 0), (1, 1)}}
    df = spark.createDataFrame([(f, x, y, 0.5) for f, s in shots.items() for x, y in s], "frame long, x long, y long, value double")
    got = frames.components(df, size).collect()
    for f, s in shots.items():
        assert sorted((g["n"], g["x0"], g["y0"], g["x1"], g["y1"]) for g in got if g["frame"] == f) == flooded(s)
    assert frames.components(df.limit(0), size).count() == 0


def test_linked(spark):
    edges = [("a", i, i + 1) for i in range(100)] + [("b", 5, i) for i in range(6, 40)] + [("a", 300, 300), ("b", None, 3), ("a", 7, 500)]
    got = {(r["s"], r["node"]): r["root"] for r in linking.linked(spark.createDataFrame(edges, "s string, a long, b long"), "s").collect()}
    assert got == {("a", i): 0 for i in range(101)} | {("a", 500): 0, ("a", 300): 300, ("b", 3): 3} | {("b", i): 5 for i in range(5, 40)}


def test_reading_order(spark):
    rows = [(1, i, *b) for i, b in enumerate([(50.0, 0.0, 30.0, 10.0), (5.0, 2.0, 30.0, 10.0), (5.0, 20.0, 10.0, 10.0), (60.0, 18.0, 10.0, 30.0), (30.0, 40.0, 10.0, 10.0)])]
    got = frames.reading_order(spark.createDataFrame(rows, "frame long, i long, x double, y double, width double, height double"), "frame", "i")
    assert [(r["i"], r["line"]) for r in got.orderBy("place").collect()] == [(1, 1), (0, 1), (2, 2), (3, 2), (4, 3)]


def test_signatures(spark):
    # published test vectors of HMAC-SHA-256 (RFC 4231), and what the standard library gives
    cases = [(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 20, b"\xdd" * 50), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"), (b"", b""), (b"k" * 64, b"m"), (b"k" * 65, b"m")]
    df = spark.createDataFrame([(i, bytearray(k), bytearray(m)) for i, (k, m) in enumerate(cases)], "i int, k binary, m binary")
    got = {r["i"]: r["h"] for r in df.select("i", proofs.hmac(F.col("k"), F.col("m")).alias("h")).collect()}
    assert got == {i: hmac.new(k, m, hashlib.sha256).hexdigest() for i, (k, m) in enumerate(cases)}
    assert got[0] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    root = hashlib.sha256(b"x").hexdigest()
    key = F.lit("secret")
    sig = hmac.new(b"secret", bytes.fromhex(root), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(1, root, sig), (2, root, sig.upper()), (3, root[::-1], sig), (4, None, sig), (5, "no hex", sig), (6, root, None)], "i int, root string, s string")
    assert {r["i"]: r["ok"] for r in rows.select("i", proofs.genuine(F.col("root"), F.col("s"), key).alias("ok")).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_registered_detectors(spark):
    """A user's detector takes part in the claims of the built-in ones, wherever its order puts it."""
    mine = {"order": 0.5, "type": "ORDER_NO", "pattern": r"(?<!\d)4111[ -]?1111[ -]?\d{4}[ -]?\d{4}(?!\d)", "guard": "4111", "gate": "claims", "validator": "luhn", "confidence": 0.9}
    dash = {"order": 99.0, "type": "TICKET", "pattern": "[A-Z]{2}-[0-9@.a-z]+", "guard": None, "gate": "gated", "validator": None, "confidence": None}
    built_in = [dict(zip([c.split()[0] for c in detect.ROW.split(", ")], r, strict=True)) for r in detect.detector_rows()]
    assert detect.registered(built_in)[0].pattern == detect.DETECTORS[0].pattern and len(detect.registered(built_in)) == 21
    chosen = detect.registered([*built_in, mine, dash])
    text = "AB-joe@example.org and 4111 1111 1111 1111 and XY-77"
    own = spark.createDataFrame([(text,), (None,)], "t string")
    found = [[(e["type"], e["text"]) for e in r["e"]] for r in own.select(detect.entities(F.col("t"), detectors=chosen).alias("e")).collect()]
    assert found[1] == [] and ("ORDER_NO", "4111 1111 1111 1111") in found[0] and ("TICKET", "XY-77") in found[0]
    # the address is claimed first, so the gated ticket that overlaps it is not
    assert not any(t == "TICKET" and "joe" in x for t, x in found[0])
    same = spark.createDataFrame([(text,)], "t string").select(detect.entities(F.col("t")).alias("a"), detect.entities(F.col("t"), detectors=detect.registered(built_in)).alias("b")).first()
    assert same["a"] == same["b"]
    assert [d.type for d in detect.registered([{"order": 2, "type": "PAN"}, {"order": 1, "type": "EMAIL"}])] == ["EMAIL", "PAN"]
    for bad in ({"type": "X", "order": 1, "pattern": "x", "gate": "sometimes"}, {"type": "X", "order": 1, "pattern": "x", "validator": "guess"}, {"type": None, "order": 1, "pattern": "x"}, {"type": "X", "order": 1}):
        with pytest.raises(ValueError):
            detect.registered([bad])


def scrub(x):
    if isinstance(x, dict):
        return {k: stores.OMITTED if k in stores.SCRUBBED else scrub(v) for k, v in x.items()}
    return [scrub(v) for v in x] if isinstance(x, list) else x


def test_scrubbed_json(spark):
    names = list(stores.SCRUBBED)
    records = [
        {names[0]: {"dataBase64": "…", "more": [1, {"a": "}"}]}, "ok": 1}, {"a": {names[1]: [1, [2, 3], {"x": "y"}], "b": [{"c": {names[2]: {}}}]}}, {"v": names[3], names[4]: [], "w": 'say "hi" \\ {'},
        {}, [], [names[0], {"z": None}], {"n": -1.5e3, names[5]: None, "t": True}, "text", 7,
    ]
    df = spark.createDataFrame([(i, json.dumps(r, indent=i % 3 or None)) for i, r in enumerate(records)] + [(99, None)], "i int, j string")
    got = {r["i"]: r["s"] for r in df.select("i", stores.scrubbed_json(F.col("j")).alias("s")).collect()}
    assert got.pop(99) is None
    assert {i: json.loads(s) for i, s in got.items()} == {i: scrub(r) for i, r in enumerate(records)}


def test_question_lines_and_debates(spark):
    rows = [(1, i, x) for i, x in enumerate(["  the   cat ", "", "dog", "the dog", "x" * 300, None])] + [(2, 0, " ")]
    out = reports.question_lines(spark.createDataFrame(rows, "p long, o long, l string"), "p", "o", "l", ["dog", "THE"], most=3, budget=1000)
    assert [(r["p"], r["n_lines"], r["said"]) for r in out.collect()] == [(1, 3, "the cat\ndog\nthe dog")]
    side = "struct<action:string,target:string,confidence:double>"
    df = spark.createDataFrame([(("click", "#a", 0.9), ("wait", None, 0.5), "local", "surer"), (None, ("wait", None, 0.5), None, None)], f"l {side}, c {side}, w string, y string")
    said = [r[0] for r in df.select(reports.debate_summary(F.col("l"), F.col("c"), F.col("w"), F.col("y"))).collect()]
    assert said == ["local would click #a (0.90); cloud would wait (0.50); taken: local, surer", "local gave nothing; cloud would wait (0.50); taken: none"]
