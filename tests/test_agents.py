"""Decisions, stores, sessions, models and feeds: what the queries' SQL doesn't show."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest import models
from palimpsest.functions import numbers as N
from palimpsest.operators import decisions as D
from palimpsest.operators import memory, sequences, stores
from palimpsest.sources import feeds


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_answers(spark):
    f = lambda t: D.first_object(F.lit(t))
    assert list(one(spark, f('x {"a": {"b": 1}} y {z}'), f("```json\n{}\n```"), f("none"), f("{open"), f(""))) == ['{"a": {"b": 1}}', "{}", "none", "{open", ""]
    raw = '{"a": "line\nnext\ttab \\" q",\n "b": 1}'
    assert json.loads(one(spark, D.repaired(F.lit(raw)))[0]) == {"a": 'line\nnext\ttab " q', "b": 1}
    long = '{"a": "' + "word \\n " * 20_000 + '"}'
    assert json.loads(one(spark, D.repaired(D.first_object(F.lit(long))))[0])["a"].startswith("word")
    p = one(spark, D.parsed(F.lit('{"action": "click", "reasoning": 3}')).alias("p"))["p"]
    assert p["valid"] and not p["typed"]
    assert not one(spark, D.parsed(F.lit(None).cast("string")).alias("p"))["p"]["valid"]


def test_ask_and_arguments(spark):
    none = F.lit(None).cast("string")
    a = one(spark, D.ask_user((none, none, F.lit("Your password")), F.lit("#p"), F.lit("input:text")).alias("a"), D.ask_user((F.lit("Mail"), none, none), none, none).alias("b"))
    assert a["a"]["kind"] == "password" and a["a"]["key"] == "#p" and a["b"]["key"] == "field_0" and a["b"]["label"] == "Mail"
    arguments = lambda x: D.action_arguments(F.lit(x), F.lit(3), F.lit("#t"), F.lit("v"))
    assert list(one(spark, arguments("scroll"), arguments("back"), arguments("fill"))) == [["down", "400", "#t"], [], ["3", "v", "#t"]]


def test_stores(spark):
    f = lambda x: stores.scrubbed_json(F.lit(x))
    assert json.loads(one(spark, f('{"a":{"email":"x\\"y","n":1},"card":12,"ok":null,"text":null}'))[0]) == {"a": {"email": stores.OMITTED, "n": 1}, "card": stores.OMITTED, "ok": None, "text": stores.OMITTED}
    m = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.lit(None).cast("map<string,string>")
    r = one(spark, stores.merged(m({"a": "1", "b": "2"}), m({"b": "3"})).alias("m"), stores.merged(m({}), m({"x": "1"})).alias("n"), stores.scrubbed(m({"name": "x", "id": "1"})).alias("s"), stores.request_fields(m({"sessionId": "1", "cookie": "2"})).alias("q"), stores.visual_state(m({"isLoading": "true", "raw": "x"})).alias("v"), stores.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")).alias("c"))
    assert (r["m"], r["n"], r["s"], r["q"], r["v"], r["c"]) == ({"a": "1", "b": "3"}, {"x": "1"}, {"name": stores.OMITTED, "id": "1"}, {"sessionId": "1"}, {"isLoading": "true"}, '{"a":null,"b":1}')
    box = lambda w: F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(w).alias("width"), F.lit(1.0).alias("height"))
    assert one(spark, stores.visual_box(box(float("inf"))), stores.visual_box(box(2.0)))[0] is None
    p = one(spark, stores.preview(F.sequence(F.lit(1), F.lit(9)), F.repeat(F.lit("x"), 5000)).alias("p"))["p"]
    assert (len(p["shown"]), p["omitted"], len(p["text"])) == (6, 3, 4014)
    assert list(one(spark, stores.chosen_history(F.array().cast("array<int>"), F.array(F.lit(1))), stores.chosen_history(F.array(F.lit(2)), F.array(F.lit(1))))) == [[1], [2]]


def times(spark, n=400):
    r = random.Random(7)
    rows, at = [], {}
    for i in range(n):
        u = r.randrange(5)
        at[u] = at.get(u, datetime(2024, 1, 1)) + timedelta(milliseconds=r.choice([0, 50, 150, 300, 600, 601, 900, 5000]))
        rows.append((u, i, at[u], r.random() < 0.3))
    return rows, spark.createDataFrame(rows, "u int, i int, ts timestamp_ntz, bad boolean").repartition(4)


def test_throttle_and_breaker(spark):
    rows, df = times(spark)
    kept, last = set(), {}
    for u, i, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if u not in last or t - last[u] > timedelta(milliseconds=600):
            kept.add(i)
            last[u] = t
    assert {r["i"] for r in memory.throttled(df, "u", "ts", ["i"]).collect()} == kept
    until, want = {}, {}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by_user.setdefault(r[0], []).append(r)
    for u, mine in by_user.items():
        for _, i, t, bad in mine:
            want[i] = u in until and until[u] - timedelta(milliseconds=700) < t < until[u]
            if bad and (u not in until or t >= until[u]):
                until[u] = t + timedelta(milliseconds=700)
    got = {r["i"]: r["open"] for r in memory.cooled_down(df, "u", "ts", ["i"], F.col("bad"), 700).collect()}
    assert got == want


def test_latency_against_sorting(spark):
    r = random.Random(3)
    rows = [(k, r.choice([r.uniform(-5, 5), 10.0 ** r.randint(-3, 6), 2.5, 0.0])) for k in ("a", "b") for _ in range(501)] + [("c", 1.5), ("d", None)]
    got = {x["k"]: x for x in sequences.latency(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    for k in "abc":
        v = sorted(x for kk, x in rows if kk == k)
        assert (got[k]["n"], got[k]["least"], got[k]["median"], got[k]["p95"], got[k]["most"]) == (len(v), v[0], v[int(0.5 * (len(v) - 1))], v[int(0.95 * (len(v) - 1))], v[-1])
    assert "d" not in got


def test_decoders(spark):
    t = one(spark, N.tag_parts(F.lit("b-name")).alias("a"), N.tag_parts(F.lit(None).cast("string")).alias("b"), N.tag_parts(F.lit("CITY")).alias("c"), N.entity_name(F.lit("phone_number")).alias("d"))
    assert (tuple(t["a"]), tuple(t["b"]), tuple(t["c"]), t["d"]) == (("B", "NAME"), ("O", "O"), ("B", "CITY"), "PHONE")
    rows = [(1, 0, "B-PER", 0.95, 0, 3), (1, 1, "I-PER", 0.9, 4, 8), (1, 2, "B-PER", 0.99, 9, 12), (1, 3, "O", 0.99, 13, 14), (1, 4, "I-PER", 0.5, 15, 18), (1, 5, "I-EMAIL", 0.9, 19, 25)]
    got = sorted((r["start"], r["end"], r["type"]) for r in N.spans(spark.createDataFrame(rows, "text_id int, ord int, label string, confidence double, start int, end int")).collect())
    assert got == [(0, 8, "PER"), (9, 12, "PER"), (19, 25, "EMAIL")]
    letters = F.array(*map(F.lit, ["", "a", "b", "c"]))
    assert one(spark, N.read_line(F.array(*map(F.lit, [1, 1, 0, 1, 2, 2, 3, 9])), letters))[0] == "aabc"
    pieces = N.word_pieces(["un", "##able", "able", "!", "to"])
    assert [(p["piece"], p["start"], p["end"]) for p in one(spark, pieces(F.lit("unable to!x")).alias("p"))["p"]] == [("un", 0, 2), ("##able", 2, 6), ("to", 7, 9), ("!", 9, 10), ("[UNK]", 10, 11)]
    cells = spark.createDataFrame([(1, 8, 2, 3, 0.9, 0.9, 0.5, 0.5, 0.0, 0.0), (1, 8, 2, 3, 0.1, 0.9, 0.0, 0.0, 0.0, 0.0)], "image int, stride int, row int, col int, cls double, obj double, dx double, dy double, dw double, dh double")
    f = N.faces(cells).collect()
    assert [(r["x"], r["y"], r["width"]) for r in f] == [(24.0, 16.0, 8.0)]
    assert one(spark, N.document_types(F.lit("PASSPORT no 7, D.O.B 01/02/1990 ABCPT1234F")))[0] == ["PAN", "PASSPORT_LIKE", "DOB"]
    b = one(spark, N.best_class(F.array(F.lit(0.0), F.lit(3.0), F.lit(3.0))).alias("b"))["b"]
    assert b["index"] == 1


def test_models_fail_closed(spark):
    rows = spark.createDataFrame([(1, "local"), (2, "cloud"), (3, None)], "decision_id long, mode string")
    assert models.results("none", "reason", rows).count() == 0
    models.register("echo", "reason", lambda df: df.select("decision_id", F.lit("{}").alias("raw")))
    models.register("wrong", "reason", lambda df: df.select("mode"))
    try:
        assert sorted(r["decision_id"] for r in models.results("echo", "reason", rows, F.col("mode")).collect()) == [2, 3]
        assert models.results("wrong", "reason", rows).count() == 0 and models.results("echo", "names", rows).count() == 0
    finally:
        models.unregister("echo")
        models.unregister("wrong")


def test_feeds(spark, tmp_path):
    for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>c</p>"]):
        (tmp_path / f"{i}.html").write_text(t)
    (tmp_path / "x.txt").write_text("no")
    spark.dataSource.register(feeds.PageFolder)
    spark.dataSource.register(feeds.ReceiptLines)
    got = spark.read.format("page_folder").option("filesPerPartition", 2).load(str(tmp_path)).orderBy("page_id").collect()
    assert [(r["page_id"], r["html"]) for r in got] == [(0, "<p>a</p>"), (1, "<p>b</p>"), (2, "<p>c</p>")]
    spark.createDataFrame([(1, "me@x.org")], "id int, email string").write.format("receipt_lines").mode("append").save(str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.jsonl") for x in p.read_text().splitlines()]
    assert lines == [{"email": stores.OMITTED, "id": 1}]
