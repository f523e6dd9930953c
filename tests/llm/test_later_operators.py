"""Infilling, language identification and hard negatives against brute force and SQL, with odd input."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives, infilling, language_id, multiset_hash, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, prefix string, x long"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_hard_negatives"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def infilled(doc_id, t):
    n, h = len(t), sha(f"1:{doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or doc_id is None or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infilling(spark):
    r = random.Random(3)
    made = ["".join(r.choice("ab \n\tÄß😀𝒳é") for _ in range(r.choice((1, 2, 511, 512, 513, 3000)))) for _ in range(120)]
    texts = [None, "", "x", "a <P> b", "a<S>", "<M>", "<" * 600 + "P>", "y" * 510 + "<P>" + "y" * 600, "long " * 60_000, *made]
    rows = [(i, t, None, "clash", "p", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (3, "again", "en", None, None, None), (3, "again", "en", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = sorted((repr((d, *infilled(d, t or "")[:4], sha(infilled(d, t or "")[4]), sha(t or ""))) for d, t, *_ in rows))
    assert sorted(repr(tuple(x)) for x in infilling.digests(df).collect()) == want
    for grammar in infilling.GRAMMARS:
        out = infilling.fill_in_middle(df, grammar)
        bad = out.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).join(df.filter("doc_id <> 3 and text is not null").select("doc_id", "text"), "doc_id").filter("back <> text")
        assert bad.count() == 0 and out.count() == len(rows)
    assert infilling.fill_in_middle(df.limit(0)).count() == 0


def test_unit_grammars(spark):
    """Pieces of any block size are the text again, and units are what a plain scan gives."""
    t = "One two,\n\n three 44 fünf\tsix  \nend."
    want = {"chars": list(t), "words": ["One ", "two,\n\n ", "three ", "44 ", "fünf\t", "six  \n", "end."], "lines": ["One two,\n", "\n", " three 44 fünf\tsix  \n", "end."]}
    want["runs"] = ["One", " ", "two", ",", "\n\n ", "three", " ", "44", " ", "fünf", "\t", "six", "  \n", "end", "."]
    for grammar, units in want.items():
        for size in (1, 7, 100):
            [x] = spark.range(1).select(F.flatten(F.transform(infilling.blocks(F.lit(t), grammar, size), lambda b: infilling.units(b, grammar))).alias("u")).collect()  # noqa: B023
            assert x["u"] == units, (grammar, size)


def dual(train, lang, wanted, ridge):
    """Kernel ridge regression over exact n-gram sets, every training row a landmark, languages weighing alike."""

    def grams(t):
        t = " ".join("".join(c.lower() if c.isalpha() else " " for c in f" {t} ").split())
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}

    sets, asked = [grams(t) for t in train], [grams(t) for t in wanted]
    k = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    gram, cross = np.array([[k(a, b) for b in sets] for a in sets]), np.array([[k(a, b) for b in sets] for a in asked])
    names = sorted(set(lang))
    y = (np.array(lang)[:, None] == np.array(names)).astype(float)
    w = np.diag((y @ (len(lang) / y.sum(0))) / len(names))
    return names, cross @ np.linalg.solve(w @ gram + ridge * len(lang) * np.eye(len(lang)), w @ y)


def test_language_model_against_the_dual_form():
    r = random.Random(1)
    syllables = {"a": "tha ing the ou".split(), "b": "ung sch ber ein".split(), "c": "que los mente ido".split()}
    say = lambda s: " ".join("".join(r.choice(syllables[s]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 30)))
    lang = [r.choice("aabc") for _ in range(60)]
    train, asked = [say(x) for x in lang], [say(x) for x in "abcabc"]
    bits, _ = language_id.presence(pa.array(train), width=1 << 18)
    model = language_id.fit(np.packbits(bits, axis=1), lang, np.ones(60, bool), width=1 << 18)
    names, want = dual(train, lang, asked, 1e-3)
    got, _ = model.outputs(pa.array(asked), model.marks())
    assert model.languages == tuple(names)
    assert np.abs(got - np.clip(want, 0, 1)).max() < 1e-3


def test_pieces_of_long_texts(monkeypatch):
    t = "Ab, c!!!  déf " * 30 + "x"
    whole, _ = language_id.presence(pa.array([t]))
    for piece in (1, 2, 5, 17):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert (language_id.presence(pa.array([t]))[0] == whole).all()


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out_languages(docs)
    said = out.join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = said[said.held_out & said.lang.notna() & said.text.notna()]
    assert out.count() == docs.count() and len(held) > 100
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert said.score.between(0, 1).all()
    # language, source and id of the judged rows change nothing
    model = language_id.train(docs, language_id.fold() != 0)
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    a = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(docs, model).collect()}
    assert a == {x["doc_id"] - 7: (x["lang_pred"], x["score"]) for x in language_id.predict(other, model).collect()}
    again = language_id.train(docs.repartition(5), language_id.fold() != 0)
    assert np.array_equal(model.packed, again.packed) and np.allclose(model.coefficients, again.coefficients)


def test_odd_texts_have_a_language_or_und(spark):
    rows = [(1, None, "en", None, None, 1), (2, "", "en", None, None, 1), (3, "12 34 !?", None, None, None, 1), (None, "the other thing", "en", None, None, 1), (4, "the thing", "en", "s", "p", 1), (4, "the thing", "en", "s", "p", 1), (5, "der Ding ist", "de", None, None, 1), (6, "中文", "zh", None, None, 1), (7, "x" * 3_000_000, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((x["doc_id"] or 0, x["lang_pred"], x["score"]) for x in language_id.predict(df, language_id.train(df)).collect())
    assert [g[:2] for g in got[1:]] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "zh"), (7, got[-1][1])] and got[0][1] == "en"
    assert all(s == 0 for _, lang, s in got if lang == "und")
    blank = language_id.train(df.limit(0))
    assert blank.languages == () and {x["lang_pred"] for x in language_id.predict(df, blank).collect()} == {"und"}
    assert language_id.held_out_languages(df.limit(0)).count() == 0
    # a language that a third and more of all rows repeat is one text of the sample
    hot = spark.range(3000).select("id", F.lit("same text").alias("text"), F.lit("en").alias("lang")).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(9000 + i, f"ein satz {i}", "de") for i in range(50)], "doc_id long, text string, lang string"))
    assert language_id.training_rows(hot, F.lit(True), "doc_id", "text", "lang", 100, 20, 9).groupBy("lang").count().collect() and language_id.train(hot).languages == ("de", "en")


def mined(rows, every=4, k_pos=3, k_neg=2):
    ok = [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in ok]
    out = []
    for n, (i, v, lab) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, lw) for m, (j, w, lw) in enumerate(ok) if m != n and len(w) == len(v))
        for ps, p, _, _ in [x for x in scored if x[3] == lab][:k_pos]:
            hard = [(s, j) for s, j, _, lw in scored if lw != lab and 80 * -ps <= 100 * -s <= 100 * -ps][:k_neg]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    r = random.Random(4)
    few = lambda: [r.choice((0.5, 0.25, -0.25, 1.0, 0.1)) for _ in range(3)]  # noqa: E731  few values, many ties
    rows = [(i, few(), r.randrange(3)) for i in range(160)] + [(200, None, 1), (204, [0.1, None, 0.2], 1), (208, [0.1, float("nan"), 0.2], 1), (212, [float("inf"), 0.0, 0.0], 1), (216, few(), None), (220, [0.5, 0.5], 1), (221, [0.5, 0.25], 1), (222, [0.5, 0.4], 2), (224, [], 1), (225, [], 2), (None, few(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1)).repartition(5)
    want = mined([(i, None if v is None else [None if x is None else np.float32(x) for x in v], lab) for i, v, lab in rows])
    for chunk, block, scores in ((1 << 20, 1 << 20, 1 << 20), (40, 30, 64)):
        monkeypatch.setattr(hard_negatives, "SCORES", scores)
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        got = hard_negatives.hard_negatives(df, anchor_every=4, shift_every=7, n_positives=3, n_negatives=2, chunk=chunk)
        assert sorted(tuple(x) for x in got.collect()) == want
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_hard_negatives_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [0.9, 0.1], 2), (2, [1.0, 0.5], 1)]
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect())
    one = [(0, p, rank, 1, 65536, s) for p in (0, 2) for rank, s in ((1, 65536), (2, 230 * 256))]
    assert got == sorted(one + one)


def test_large_scores_stay_exact():
    a, b = np.array([[2**30, 1], [3, 5]], np.int64), np.array([[2**30, -1], [7, 2]], np.int64)
    assert hard_negatives.products(a, b).tolist() == [[2**60 - 1, 7 * 2**30 + 2], [3 * 2**30 - 5, 31]]


def test_fingerprint_laws(spark):
    """Repeated paragraphs are added and removed like others; order doesn't matter, the words of a paragraph do."""
    f = lambda t: multiset_hash.fingerprint(F.lit(t))
    line, spam, han = "the quick brown fox jumps over it", "no " * 300, "文字文字漢"
    laws = {
        "twice": multiset_hash.added(f(line), f(line)) == f(f"{line}\n{line}"), "spam": multiset_hash.added(f(spam), f(spam)) == f(f"{spam}\n\n{spam}"), "order": f(f"{line}\n{spam}\n{han}") == f(f"{han}\n{line}\n{spam}"),
        "remove": multiset_hash.removed(f(f"{line}\n{spam}\n{line}"), f(line)) == f(f"{spam}\n{line}"), "words": f(line) != f("fox quick brown the jumps over it"), "count": f(line) != f(f"{line}\n{line}"), "none": multiset_hash.removed(f(line), f(line)) == f(""),
    }
    [r] = spark.range(1).select(*(v.alias(k) for k, v in laws.items())).collect()
    assert all(r.asDict().values()), r
    # the form for tables gives the same
    texts = [line, spam, han, f"{line}\n\n{spam}\n{line}", "", None, "\x01\x01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["f"] for x in multiset_hash.fingerprints(df).collect()} == {x["doc_id"]: x["f"] for x in df.select("doc_id", multiset_hash.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    # the 300 equal pieces count for their first, second, fourth ... time
    [r] = spark.range(1).select(multiset_hash.damped(F.array_repeat(F.lit(5).cast("bigint"), 300)).alias("d")).collect()
    assert len(set(r["d"])) == len(r["d"]) == 9


def test_likeness_against_brute_force(spark):
    """The estimate is near the cosine of the texts' pieces, of which the edited text has about three quarters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    edited = [(i, texts[i], texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[ids[(k + 1) % len(ids)]][: len(texts[i]) // 4]) for k, i in enumerate(ids)]
    own = lambda c: F.flatten(F.transform(multiset_hash.paragraphs(F.col(c)), lambda p: multiset_hash.damped(F.transform(multiset_hash.pieces(p), lambda x: F.xxhash64(x)))))
    found = spark.createDataFrame(edited, "doc_id long, a string, b string").select("doc_id", F.length("a").alias("n"), own("a").alias("a"), own("b").alias("b")).collect()
    near = {r["doc_id"]: r["near_edited"] for r in multiset_hash.edited_fingerprints(docs).collect()}
    off, said = [], []
    for r in found:
        if r["n"] > 300:
            a, b = Counter(r["a"]), Counter(r["b"])
            true = sum(a[x] * b[x] for x in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            off.append(abs(near[r["doc_id"]] - true))
            said.append(near[r["doc_id"]])
    assert np.mean(off) < 0.05 and np.max(off) < 0.3
    assert np.mean(np.array(said) >= 0.5) >= 0.99
