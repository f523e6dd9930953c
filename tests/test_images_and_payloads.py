"""Images as bytes against NumPy, payloads by schema, options of lists, with odd input."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import frames, images, proofs, stores
from palimpsest.sources import elements as parsed

SCHEMA = "image_id long, width int, height int, pixels binary"


def pictures():
    r = np.random.default_rng(3)
    return {i: r.integers(0, 256, (h, w, 4), dtype=np.uint8) for i, (w, h) in enumerate([(1, 1), (16, 16), (17, 33), (40, 5)])}


def test_tiles_and_roots(spark):
    made = pictures()
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in made.items()] + [(90, 2, 2, bytearray(b"short")), (91, 2, 2, None), (92, None, 2, bytearray(b"x" * 16)), (93, 0, 0, bytearray())]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for i, p in made.items():
        cut = [p[y : y + 16, x : x + 16].tobytes() for y in range(0, p.shape[0], 16) for x in range(0, p.shape[1], 16)]
        want |= {(i, k): t for k, t in enumerate(cut)}
    got = images.tiles(df, 16).collect()
    assert {(t["image_id"], t["index"]): bytes(t["pixels"]) for t in got} == want
    roots = {r["image_id"]: r["root"] for r in proofs.roots(proofs.levels(images.tile_leaves(df, 16), "image_id"), "image_id").collect()}
    level = [hashlib.sha256(want[2, k]).digest() for k in range(6)]
    level += [level[-1]] * 2
    while len(level) > 1:
        level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
    assert roots[2] == level[0].hex() and set(roots) == set(made)
    assert images.tiles(df.limit(0)).count() == 0


def test_sizes_and_icons(spark):
    made = pictures()
    df = spark.createDataFrame([(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in made.items()] + [(90, 2, 2, None)], SCHEMA)
    light = {i: p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114 for i, p in made.items()}
    for of, want in ((images.gray(df), light), (images.resized_to(df, 7, 4), {i: frames.resized(x, 4, 7) for i, x in light.items()}), (images.icon_inputs(df), {i: frames.icon_input(x / 255) for i, x in light.items()})):
        got = {r["image_id"]: r["values"] for r in of.collect()}
        assert got.pop(90) is None
        for i, x in want.items():
            assert np.allclose(got[i], x.ravel(), atol=1e-3)


def test_outbound_payloads(spark):
    box = {"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}
    payload = {"sessionId": "s", "cookie": "c", "domSkeleton": [{"id": "a", "value": "secret", "box": box | {"z": 1}, "options": ["x", "y"], "hasValue": True}, {}], "actionHistory": [{"action": "fill", "value": "secret", "password": {"a": 1}}, {"value": "[REDACTED]"}, {"value": None}], "visualState": {"isLoading": False, "dialogRegion": box, "loadingRegion": {"x": 1.0}, "pixels": [1]}}
    want = {"sessionId": "s", "domSkeleton": [{"id": "a", "box": box, "hasValue": True, "options": ["x", "y"]}, {}], "actionHistory": [{"action": "fill", "value": "[REDACTED]"}, {"value": "[REDACTED]"}, {}], "visualState": {"isLoading": False, "dialogRegion": box}}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "{}"), (3, "no json"), (4, None), (5, "[1]"), (6, '{"sessionId": "x", "domSkeleton": null}')], "i int, j string")
    got = {r["i"]: r["s"] for r in df.select("i", stores.outbound_payload(F.col("j")).alias("s")).collect()}
    assert json.loads(got[1]) == want
    assert got[2] == "{}" and got[3] is got[4] is got[5] is None and json.loads(got[6]) == {"sessionId": "x"}


def test_options(spark):
    html = "<select id=s><option value=1>one<option selected>two</option><optgroup label=g disabled><option value=3>three</optgroup></select><option>stray</option><select></select>"
    [r] = parsed.select_options(parsed.page_items(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")), 2).collect()
    assert r["n_options"] == 3 and [(o["label"], o["value"], o["group"], o["selected"], o["enabled"]) for o in r["options"]] == [("one", "1", None, False, True), ("two", "two", None, True, True)]
