"""The pipeline's stages on the smallest tables: what each keeps, held against the stage's own rule."""

import re

from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
            assert set(kept[-1]) <= set(kept[-2])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    clean, exact, near, cut = kept[1:]
    assert len({norm(t) for t in clean.values()}) == len(exact) == len({norm(t) for t in exact.values()})
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.translate({c: c + 32 for c in range(65, 91)}).split()) for i, t in near.items())}
    for i, a in sets.items():
        assert not any(j < i and a and b and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items())
    seen = set()
    for i in sorted(cut):
        w = cut[i].split()
        if cut[i] == near[i]:
            assert not any(tuple(w[k : k + 50]) in seen for k in range(len(w) - 49))
        v = near[i].split()
        seen |= {tuple(v[k : k + 50]) for k in range(len(v) - 49)}
    packed = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == set(cut) and all(r["n"] == r["m"] for r in packed)


def test_repeated_and_null_ids(spark):
    """Rows are judged one by one: a clean text stays though its id repeats, and copies go with any id or none."""
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    one, two, nobody = words("a", 90), words("b", 90), words("c", 90)
    near_one = one.replace("a89", "x")
    data = [(1, one), (5, one), (5, two), (None, one), (7, words("d", 90)), (7, words("d", 90)), (None, nobody), (None, nobody), (9, near_one), (9, words("e", 90)), (None, near_one)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    shown = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    exact = corpus_pipeline.exact(spark, docs, DATA)
    assert exact.columns == docs.columns
    assert shown(exact) == sorted([(1, one), (5, two), (7, words("d", 90)), (0, nobody), (9, near_one), (9, words("e", 90))])
    want = sorted([(1, one), (5, two), (7, words("d", 90)), (0, nobody), (9, words("e", 90))])
    assert shown(corpus_pipeline.near(spark, docs, DATA)) == want
    assert shown(corpus_pipeline.substrings(spark, exact, DATA)) == sorted([*want, (9, "x")])
