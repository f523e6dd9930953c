"""Elements parsed from HTML, labels, selectors, and the tables around them."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import boxes, frames
from palimpsest.operators import elements as E
from palimpsest.sources import elements as parsed

HTML = """<html><head><title>Shop  checkout</title><script>var x = "<a href='/no'>";</script></head><body>
<nav aria-label="pagination"><a href="/1">1</a><a href="/2">more</a></nav>
<main aria-labelledby="t"><h1 id="t">Pay here</h1>
<form id="pay"><label for="mail">Your e-mail</label><input id="mail" type="email" value="a@b.c">
<label>City <input name="home_city" placeholder="where"></label>
<input type="password" value="hunter2" name="pw"><input type="checkbox" name="ok" checked>
<select name="land"><option value="">choose</option><option value="fr" selected>France</option></select>
<input type="hidden" name="h" value="z"><button disabled>Pay now</button></form>
<table><tr><th>Item</th><th>Price</th></tr><tr><td>a<td>1</tr></table>
<div role="dialog" aria-modal="true"><h2>Sure?</h2><button class="x">Yes</button></div>
<p class="form-error">Card number is wrong</p><div role="status">Saved</div><div class="spinner"></div>
<pre>code</pre><iframe src="https://ads.example.com"></iframe><img alt="passport scan" width="200" height="140">
<div hidden><button>never</button></div>
<my-box><template shadowrootmode="open"><button id="in">inside</button></template></my-box>
</main></body></html>"""


def items(spark, html=HTML):
    return parsed.page_items(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))


def test_elements(spark):
    rows = {r["selector"]: r for r in parsed.interactive(items(spark)).collect()}
    assert rows["#mail"]["type"] == "input:email" and rows["#mail"]["text"] == "Your e-mail" and rows["#mail"]["label"] == "Your e-mail" and rows["#mail"]["form_id"] == "pay"
    city = rows['input[name="home_city"]']
    assert city["label"] == "City" and city["has_value"] is False
    assert rows['input[name="pw"]']["value"] is None and rows['input[name="ok"]']["value"] == "checked" and rows['select[name="land"]']["value"] == "fr"
    assert not any(r["name"] == "h" for r in rows.values())
    pay = next(r for r in rows.values() if r["text"] == "Pay now")
    assert pay["enabled"] is False and pay["form_id"] == "pay"
    assert next(r for r in rows.values() if r["text"] == "never")["visible"] is False
    assert next(r for r in rows.values() if r["text"] == "Yes")["in_modal"]
    assert next(r for r in rows.values() if r["text"] == "inside")["selector"].endswith(" >>> #in")
    pages = [r for r in rows.values() if r["tag"] == "a"]
    assert len(pages) == 2 and all(r["is_pagination"] and r["in_nav"] for r in pages)


def test_page_parts(spark):
    got = {}
    for r in items(spark).filter("kind <> 'element'").collect():
        got.setdefault(r["kind"], []).append(r)
    assert [r["text"] for r in got["title"]] == ["Shop checkout"]
    assert [(r["n"], r["text"]) for r in got["table"]] == [(1, "Item|Price")]
    assert [(r["level"], r["text"]) for r in got["heading"]] == [(1, "Pay here"), (2, "Sure?")]
    assert [r["text"] for r in got["modal"]] == ["Sure?"]
    assert [(r["type"], r["text"]) for r in got["alert"]] == [("error", "Card number is wrong"), ("success", "Saved")]
    assert {k: len(got[k]) for k in ("loading", "frame", "code", "image")} == {"loading": 1, "frame": 1, "code": 1, "image": 1}
    assert sorted((r["type"], r["text"]) for r in got["landmark"]) == [("dialog", "Sure?"), ("form", None), ("main", "Pay here"), ("navigation", "pagination")]
    images = items(spark).filter("kind = 'image'").select(E.id_document(F.col("nearby"), F.col("width"), F.col("height")).alias("why")).collect()
    assert [r["why"] for r in images] == ["id_keyword_match"]


def test_deep_nesting(spark):
    deep = "<div>" * 3000 + "<button>x</button>" + "</div>" * 3000
    assert parsed.interactive(items(spark, deep)).count() == 1


def test_labels_and_radio(spark):
    fields = spark.createDataFrame([(1, "a"), (1, "b")], "page_id int, id string")
    labels = spark.createDataFrame([(1, 2, "a", "two"), (1, 1, "a", "one")], "page_id int, ord int, target string, text string")
    assert {r["id"]: r["label"] for r in E.label_for(fields, labels).collect()} == {"a": "one two", "b": None}
    radio = spark.createDataFrame([(1, 2, "input:radio", "g", "y", None, True), (1, 1, "input:radio", "g", "x", "Ex", False), (1, 3, "input:text", "g", "z", None, None)], "page_id int, ord int, type string, name string, value string, aria_label string, checked boolean")
    assert [[(o["value"], o["label"], o["checked"]) for o in r["options"]] for r in E.radio_groups(radio).collect()] == [[("x", "Ex", False), ("y", "y", True)]]


def test_summary_sentence(spark):
    none = F.array().cast("array<string>")
    got = spark.range(1).select(E.context_sentence(F.lit("form"), F.lit(3), F.lit(1), F.array(F.lit("main(2)")), F.lit(""), F.lit(1)), E.context_sentence(F.lit("odd"), F.lit(0), F.lit(0), none, F.lit(None).cast("string"), F.lit(0))).first()
    assert list(got) == ['Form page. with 3 form fields (1 filled, 2 empty). Regions: main(2). Modal open: "Dialog". 1 alert(s) visible.', "Page."]


def test_grounding_rules(spark):
    rows = [("big", 0, "div", None, None, None, False, True, True, 0.0, 0.0, 100.0, 100.0), ("small", 1, "div", None, "t", None, False, True, True, 10.0, 10.0, 20.0, 20.0), ("button", 2, "button", "button", "t", None, False, True, True, 10.0, 10.0, 30.0, 30.0), ("off", 3, "button", "button", "t", None, True, False, True, 10.0, 10.0, 5.0, 5.0), ("far", 4, "div", None, "t", None, False, True, True, 300.0, 0.0, 10.0, 10.0), ("link", 5, "a", "link", "t", None, False, True, True, 300.0, 30.0, 10.0, 10.0)]
    own = spark.createDataFrame([(1, *r) for r in rows], "page_id int, id string, ord int, tag string, type string, text string, aria_label string, in_modal boolean, enabled boolean, visible boolean, x double, y double, width double, height double")
    points = spark.createDataFrame([(1, 1, 12.0, 12.0), (1, 2, 90.0, 90.0), (1, 3, 305.0, 19.0), (1, 4, 700.0, 700.0)], "page_id int, point_id int, px double, py double")
    got = {r["point_id"]: (r["element_id"], r["method"]) for r in boxes.grounded(points, own).collect()}
    # the specific one, the only one around, the active one though it is farther, none
    assert got == {1: ("button", "EXACT_CONTAINMENT"), 2: ("big", "EXACT_CONTAINMENT"), 3: ("link", "APPROXIMATE_PROXIMITY")}


def test_suppression_matches_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(int(i % 3), int(i), *map(float, r.integers(0, 80, 2)), *map(float, r.integers(5, 40, 2)), float(r.random())) for i in range(150)]
    got = {x["box_id"] for x in boxes.suppressed(spark.createDataFrame(rows, "image int, box_id int, x double, y double, width double, height double, score double"), "image").collect()}
    want = set()
    for image in range(3):
        kept = []
        for b in sorted((b for b in rows if b[0] == image), key=lambda b: -b[6]):
            def over(k, b=b):
                w, h = max(0, min(b[2] + b[4], k[2] + k[4]) - max(b[2], k[2])), max(0, min(b[3] + b[5], k[3] + k[5]) - max(b[3], k[3]))
                return w * h >= 0.3 * (b[4] * b[5] + k[4] * k[5] - w * h)
            if not any(over(k) for k in kept):
                kept.append(b)
        want |= {b[1] for b in kept}
    assert got == want


def test_block_and_sizes(spark):
    picture = np.zeros((20, 30))
    picture[2:10, 3:15] = 200
    picture[12:18, 20:24] = 200
    picture[5, 3:15] = 0
    rows = [(1, x, y, float(picture[y, x])) for y in range(20) for x in range(30)]
    px = spark.createDataFrame(rows, "frame int, x int, y int, gray double")
    got = frames.brightest_block(px, spark.createDataFrame([(1, 100.0)], "frame int, level double")).first()
    assert (got["x"], got["y"], got["width"], got["height"], got["fill"]) == (3, 6, 12, 4, 1.0)
    other = px.filter("x < 20")
    r = frames.compared(px, other).first()
    assert (r["comparable"], r["verdict"], r["change_ratio"]) == (False, "major_change", 0.0)
    spinner = [(1, x, y, float(255 * ((x + y) % 2) if x < 8 and y < 8 else picture[y % 20, x % 30])) for y in range(160) for x in range(160)]
    still = [(1, x, y, float(picture[y % 20, x % 30])) for y in range(160) for x in range(160)]
    a, b = (spark.createDataFrame(s, "frame int, x int, y int, gray double") for s in (still, spinner))
    change = frames.compared(a, b)
    assert frames.loading(change, frames.with_edges(b)).first()["is_loading"]
    assert frames.overlays(px.withColumn("gray", F.when((F.col("x").between(8, 21)) & F.col("y").between(5, 14), 230.0).otherwise(60.0))).first()["confidence"] == "moderate"


def test_icon_input():
    icon = np.ones((24, 30))
    icon[8:16, 10:20] = 0.1
    got = frames.icon_input(icon)
    assert got.shape == (20, 20) and got.max() <= 1 and got[10, 10] > 0.9
    flat = frames.resized(np.full((7, 5), 3.0), 9, 4)
    assert flat.shape == (9, 4) and np.allclose(flat, 3.0)
    assert not frames.icon_input(np.zeros((2, 2))).any()


def test_rectangles(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(boxes.on_screenshot(boxes.rect(*n(990, 10, 50, 20)), *n(1000, 500, 2000, 1000)).alias("a"), boxes.on_page(*n(100, 50), *n(1000, 500, 2000, 1000)).alias("b"), boxes.on_page(*n(1, 1), *n(0, 1, 1, 1)).alias("c")).first()
    assert tuple(r["a"]) == (1972.0, 12.0, 28.0, 56.0) and tuple(r["b"]) == (50.0, 25.0) and r["c"] is None
