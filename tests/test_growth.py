"""Steps whose work has to grow no faster than the input: how they are planned, and that they find the same."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import frames, grid, images, layout, proofs, risk
from palimpsest.plans import rules


def grown(spark, gray):
    """Frames of 96 by 64 pixels from a few rows: more pixels than their source lets expect."""
    at = F.explode(F.sequence(F.lit(0), F.lit(96 * 64 - 1)))
    px = spark.range(4).select(F.col("id").alias("frame"), at.alias("i")).select("frame", (F.col("i") % 96).alias("x"), F.floor(F.col("i") / 96).cast("int").alias("y"))
    return px.withColumn("gray", gray.cast("double"))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_never_sent_to_all_tasks(spark):
    x, y = F.col("x"), F.col("y")
    before = grown(spark, (x + y) % 7)
    after = grown(spark, F.when((F.col("frame") == 1) & (x < 16) & (y < 16), 255 * ((x + y) % 2)).when((F.col("frame") == 2) & (x == 0), 90).otherwise((x + y) % 7))
    changes = frames.compared(before, after.filter("frame < 3 or x < 50"))
    assert "Broadcast" not in planned(changes)
    got = {r["frame"]: r for r in changes.collect()}
    assert [(got[k]["comparable"], got[k]["changed_tiles"], got[k]["total_tiles"], got[k]["x"], got[k]["width"]) for k in range(4)] == [(True, 0, 24, None, None), (True, 1, 24, 0, 16), (True, 0, 24, None, None), (False, 0, 0, None, None)]


def test_edges_of_small_changes_alone(spark):
    """Pixels without edges get them where they count, and the reasons are those of all edges."""
    x, y, k = F.col("x"), F.col("y"), F.col("frame")
    before = grown(spark, (x * 3 + y * 5 + k) % 16 + 100)
    inside = x.between(16, 31) & y.between(16, 31)
    after = grown(spark, F.when((k == 1) & inside, 255 * (F.floor(x / 2) + F.floor(y / 2)) % 510).when((k == 2) & inside, 200).when((k == 3) & ((x < 40) | (y < 20)), 0).otherwise((x * 3 + y * 5 + k) % 16 + 100))
    changes = frames.compared(before, after)
    want = {r["frame"]: r["reason"] for r in frames.loading(changes, frames.with_edges(after)).collect()}
    assert {r["frame"]: r["reason"] for r in frames.loading(changes, after).collect()} == want
    assert want == {0: "no_animation", 1: "compact_structured_animation", 2: "compact_structured_animation", 3: "change_too_large"}


def test_sizes_keep_all_digits(spark):
    made = np.random.default_rng(5).integers(0, 256, (9, 14), dtype=np.uint8)
    df = spark.createDataFrame([(1, 14, 9, bytearray(made.tobytes()))], "image_id long, width int, height int, pixels binary")
    got = images.resized_to(df, 8, 6, bands=1).first()["values"]
    assert np.abs(np.array(got) - frames.resized(made.astype(float), 6, 8).ravel()).max() < 1e-12


def test_payloads_are_parsed_once_by_all_cores(spark):
    sent = rules.outbound_payloads(spark, "/root/testdata/sf0.001")
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sent.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_leaves_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(n):
        made.add(1)
        return f"{n:064x}"

    leaves = spark.range(10).select((F.col("id") % 2).alias("doc"), F.floor(F.col("id") / 2).alias("index")).withColumn("hash", hashed("index"))
    tree = proofs.levels(leaves, "doc")
    assert proofs.roots(tree, "doc").count() == 2 and proofs.proofs(tree, tree.filter("level = 0").select("doc", "index"), "doc").count() == 10
    assert made.value == 10


def counted(spark, rows, column):
    """rows, with one column from a function that counts its calls."""
    made = spark.sparkContext.accumulator(0)

    @F.udf(dict(rows.dtypes)[column])
    def same(v):
        made.add(1)
        return v

    return rows.withColumn(column, same(column)), made


def test_nodes_are_worked_out_once_and_placed(spark):
    schema = "page_id long, ord int, last int, up int, shown boolean, left double, top double, width double, height double, z int"
    rows = [(1, 1, 4, None, True, 10.0, 20.0, 100.0, 100.0, None), (1, 2, 3, 1, True, 5.0, 5.0, 50.0, 50.0, 2), (1, 3, 3, 2, True, 1.0, 1.0, 10.0, 10.0, None), (1, 4, 4, 1, True, 5.0, 5.0, 50.0, 50.0, 1), (2, 1, 1, None, True, None, None, 5.0, 5.0, None), (2, 2, 2, 9, True, 1.0, 1.0, 5.0, 5.0, None)]
    nodes, made = counted(spark, spark.createDataFrame(rows, schema), "width")
    got = {(r["page_id"], r["ord"]): (r["x"], r["y"], r["top_ord"], r["visible"]) for r in layout.hit_tested(layout.placed(nodes), 1024, 768).collect()}
    assert made.value == len(rows)
    assert got == {(1, 1): (10.0, 20.0, 2, True), (1, 2): (15.0, 25.0, 2, True), (1, 3): (16.0, 26.0, 3, True), (1, 4): (15.0, 25.0, 2, False), (2, 1): (None, None, None, False), (2, 2): (None, None, None, False)}


def test_selectors_are_worked_out_once(spark):
    rows = [(1, 1, None, "#a"), (1, 2, 1, "#b"), (1, 3, 2, "#c"), (2, 1, None, "#a"), (2, 2, 7, "#lost")]
    nodes, made = counted(spark, spark.createDataFrame(rows, "page_id long, ord int, host int, selector string"), "selector")
    got = {(r["page_id"], r["ord"]): r["path"] for r in layout.pierced(nodes).collect()}
    assert made.value == len(rows)
    assert got == {(1, 1): "#a", (1, 2): "#a >>> #b", (1, 3): "#a >>> #b >>> #c", (2, 1): "#a", (2, 2): None}


def test_signals_are_looked_for_once(spark):
    df = spark.createDataFrame([("a prescription for you", "http://x.example", ["SSN"])], "text string, url string, types array<string>")
    got = df.withColumn("c", risk.compliance(F.col("text"), F.col("url"), F.col("types"))).select("c.score", "c.findings")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("immunization") == 1
    assert got.first()["score"] == 100 - 15 - 15 - 5 - 5 - 25 - 15


def test_points_look_into_few_cells(spark):
    points = spark.range(4000).select((F.col("id") * 31 % 1200).cast("double").alias("px"), (F.col("id") * 47 % 1500).cast("double").alias("py")).union(spark.sql("select null, 1.0"))
    assert 4000 <= grid.reached(points, 56.25).count() <= 2.5 * 4000
