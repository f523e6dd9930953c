"""Properties of detectors, masks, rules and sequences."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checks, detect, mask
from palimpsest.operators import boundary, boxes, fields, proofs, risk, sequences
from palimpsest.sources import pages


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, good",
    [(checks.luhn, "4111111111111111"), (checks.verhoeff, "234123412346"), (checks.iban, "DE89370400440532013000"), (checks.german_vat, "DE136695976"), (checks.china_id, "11010519491231002X"), (checks.business_number, "51824753556")],
)
def test_one_wrong_digit_is_rejected(spark, f, good):
    bad = []
    for at, c in enumerate(good):
        if c.isdigit() and not (f is checks.iban and at < 4):
            bad.append(good[:at] + str((int(c) + random.Random(at).randint(1, 9)) % 10) + good[at + 1 :])
    assert column(spark, [good, *bad], f) == [True] + [False] * len(bad)


def test_boundaries_are_ascii(spark):
    # a letter outside ASCII is no word character, so the number beside it is found
    found = column(spark, ["é234123412346", "x234123412346", None, ""], lambda v: F.transform(detect.entities(v), lambda e: e["type"]))
    assert found == [["AADHAAR"], ["PHONE"], [], []]


def test_claims_and_offsets(spark):
    text = "mail a.b@example.org, card 4111 1111 1111 1111, call +91 98765 43210"
    [found] = column(spark, [text], detect.entities)
    assert [e["type"] for e in found] == ["EMAIL", "CARD", "PHONE"]
    for e in found:
        assert text[e["start"] : e["end"]] == e["text"]


def test_masks_hide(spark):
    shown = column(spark, ["4111 1111 1111 1111", "a@b.cc", "DE89370400440532013000"], lambda v: mask.masked(F.lit("CARD"), v))
    assert shown[0] == "**** **** **** 1111"
    assert column(spark, ["abcdef@x.yz", "ab@x.yz"], lambda v: mask.masked(F.lit("EMAIL"), v)) == ["a****f@x.yz", "**@x.yz"]
    assert column(spark, ["10.20.30.40"], lambda v: mask.masked(F.lit("IP_ADDRESS"), v)) == ["**.**.30.40"]
    assert column(spark, ["x", None], lambda v: mask.masked(F.lit("OTHER"), v)) == ["[REDACTED]", None]


def test_redacted_lines_have_no_entities(spark):
    rows = spark.createDataFrame([(1, "fine\nwrite to a@b.org\n4111111111111111 here"), (2, None), (3, "")], "id int, text string")
    out = boundary.redacted_lines(boundary.lines(rows, "id", "text"), "line")
    shown = [r["shown"] for r in out.select("shown").collect()]
    assert not any(column(spark, shown, detect.entities))
    assert out.filter("id = 1 and shown = '[REDACTED LINE]'").count() == 2


def test_field_rules(spark):
    assert column(spark, ["PIN Code", "PIN", "Enter your name", None], lambda v: fields.field_key(F.lit("input:text"), v)) == ["zip", None, "name", None]


def test_confidence_of_nothing_is_a_half(spark):
    none = F.lit(None).cast("double")
    assert column(spark, ["x"], lambda v: risk.confidence(none, none)) == [0.5]
    assert column(spark, ["x"], lambda v: risk.confidence(F.lit(0.9), none, F.lit(0.4))) == [0.6]


def test_urls(spark):
    assert column(spark, ["https://a.b/c?token=1&x=2#h", "https://a.b", None], boundary.sanitized_url) == ["https://a.b/c?token=[REDACTED]&x=2#h", "https://a.b", None]


def test_loops_and_islands(spark):
    acts = ["click", "click", "click", "scroll", "scroll", "a", "b", "a", "b", "wait", "b"]
    rows = spark.createDataFrame([("s", i, a) for i, a in enumerate(acts)], "s string, i int, a string")
    got = [r["loop"] for r in sequences.loops(rows, "s", ["i"], "a").orderBy("i").collect()]
    assert got == [None, None, "REPEAT", None, "STAGNANT_SCROLL", None, None, None, "OSCILLATION", None]
    runs = sequences.failure_runs(rows, "s", ["i"], F.col("a") == "click").orderBy("i").collect()
    assert [r["failures"] for r in runs[:4]] == [1, 2, 3, 0] and runs[2]["halted"]


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 5, i, "abc"[i * 7 % 3]) for i in range(200)], "s int, i int, a string")
    one, many = (sequences.loops(rows.repartition(n), "s", ["i"], "a").orderBy("s", "i").collect() for n in (1, 8))
    assert one == many


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle_proofs(spark, n):
    leaves = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("index"), proofs.leaf(F.col("id").cast("string")).alias("hash"))
    tree = proofs.levels(leaves, "k")
    root = proofs.roots(tree, "k").first()["root"]
    found = proofs.proofs(tree, leaves.select("k", "index"), "k").join(leaves, ["k", "index"])
    assert found.filter(proofs.recomputed(F.col("hash"), F.col("path")) != root).count() == 0
    assert found.filter(proofs.recomputed(proofs.leaf(F.lit("tampered")), F.col("path")) == root).count() == 0
    assert found.count() == n


def test_suppression_keeps_the_best(spark):
    rows = spark.createDataFrame([("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 1.0, 10.0, 10.0, 0.8), ("i", 3, 50.0, 50.0, 10.0, 10.0, 0.1)], "image string, box_id int, x double, y double, width double, height double, score double")
    assert sorted(r["box_id"] for r in boxes.suppressed(rows, "image").collect()) == [1, 3]


def test_page_lines(spark):
    rows = spark.createDataFrame([(1, "<html><script>x</script><p>A &amp; b</p><p>A &amp; b</p><ul><li>c<li>d</ul>"), (2, None)], "page_id int, html string")
    assert [r["line"] for r in pages.page_lines(rows).orderBy("line_no").collect()] == ["A & b", "c", "d"]

