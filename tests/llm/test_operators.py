"""Edge cases and brute force for the corpus operators, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import automaton, components, exact_dedup, huffman, multiset_hash, near_dedup, packing, substring_dedup, suffix_dedup, tokens, toxicity, url_filters
from palimpsest.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, items string, key long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, long and empty ones, white space of all kinds."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = say(70), say(120)
    texts = [None, "", "  \t\n", "one", "Two words", say(30), base, base.replace(" ", "\n", 3), base + " tail", " ".join(base.split()[:-2]), say(40) + " " + passage + " " + say(40), passage + " " + say(25), say(20) + "\n" + passage]
    texts += [say(3000), "a " * 300, "naïve café ÅNGSTRÖM 'tis <|endoftext|> x", "tail  spaces   and more \n\n end ", base.upper(), say(60), say(61)]
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows."""
    return spark.createDataFrame([(None, "x y z", None, None, None), (None, None, None, None, None), (1, "p q r", "en", "", 0), (1, "p q r", "en", "", 0)], SCHEMA)


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(docs, empty, odd):
    got = rows(exact_dedup.exact_dedup(docs, hot_rows=2), "keep_id", "group_size", "kept", "text_sha256")
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in corpus()}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert got[i] == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(odd).count() == 4


def test_url_filters(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x/y?q", "2024-02-01"), (2, "http://b.com", "2024-01-01"), (3, None, "2024-02-01"), (4, "nonsense", None), (5, "http://ok.b.com/x", "2024-02-01"), (6, "HTTP://B.COM/", "2024-03-01")], "page_id long, url string, fetched string")
    entries = spark.createDataFrame([("b.com", "block", "2024-01-15"), ("b.com", "remove", "2024-03-01"), ("ok.b.com", "allow", "2024-01-01"), (None, "block", "2024-01-01")], "entry string, action string, effective string")
    for limit in (0, 100):
        got = {r["page_id"]: r["blocked"] for r in url_filters.url_filter(pages, entries, broadcast_rows=limit).collect()}
        assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert url_filters.url_filter(pages.limit(0), entries).count() == 0


def test_url_filters_case_and_repeats(spark):
    """Paths keep their case, and captures that share an id, or have none, are judged one by one."""
    data = [(1, "http://Example.com/Ads/x", "2024-02-01"), (2, "http://example.com/ads/x", "2024-02-01"), (3, "http://bad.com/a", "2024-02-01"), (3, "http://good.org/a", "2024-02-01"), (None, "http://bad.com", "2024-02-01"), (None, "http://good.org", "2024-02-01"), (4, "http://bad.com/b", "2024-02-01"), (4, "http://bad.com/b", "2024-02-01"), (5, None, None), (5, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, fetched string")
    entries = spark.createDataFrame([("EXAMPLE.com/Ads", "block", "2024-01-01"), ("Bad.com", "block", "2024-01-01")], "entry string, action string, effective string")
    for limit in (0, 100):
        got = sorted((r["page_id"] or 0, r["blocked"], r["n_active"]) for r in url_filters.url_filter(pages, entries, broadcast_rows=limit).collect())
        assert got == [(0, False, 0), (0, True, 1), (1, True, 1), (2, False, 0), (3, False, 0), (3, True, 1), (4, True, 1), (4, True, 1), (5, False, 0), (5, False, 0)]


def test_multiset_hash(spark, docs, empty, odd):
    f = lambda t: multiset_hash.fingerprint(F.lit(t))
    [r] = spark.range(1).select(
        (f("a\nb\nb") == f("b\na\nb")).alias("order"), (f("a\nb") == f("a\nb\nb")).alias("multi"), (multiset_hash.added(f("a\nb"), f("c")) == f("c\nb\na")).alias("insert"), (multiset_hash.removed(f("a\nb\nc"), f("b")) == f("c\na")).alias("delete")
    ).collect()
    assert (r["order"], r["multi"], r["insert"], r["delete"]) == (True, False, True, True)
    texts = {i: t or "" for i, t, *_ in corpus()}
    got = rows(multiset_hash.edited_fingerprints(docs), "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint")
    for i, t in texts.items():
        nxt, m = texts[(i + 1) % len(texts)], len(t) // 4
        assert got[i][:2] == (len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest())
    assert got[13][2] > 0.5 > got[13][3]
    assert multiset_hash.edited_fingerprints(empty).count() == 0
    alone = multiset_hash.edited_fingerprints(odd)
    assert alone.count() == 4 and alone.filter("doc_id is null and fingerprint is not null and near_next is null").count() == 2


def test_fingerprints_of_repeated_ids_and_shifted_texts(spark):
    line = "it was a long road and the old dog would not go on, so we all stood still and held the cold lead.\n"
    rows_ = [(1, "b"), (1, "a"), (1, "a"), (2, line * 8), (3, "x" + line * 8), (None, "z")]
    out = multiset_hash.edited_fingerprints(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    texts = ["b", "a", "a", line * 8, "x" + line * 8]  # of one id by digest
    want = sorted((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + texts[(k + 1) % 5][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(zip((1, 1, 1, 2, 3), texts, strict=True)))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out if r["doc_id"]) == want
    assert next(r["near_next"] for r in out if r["doc_id"] == 2) > 0.9


def test_repeated_ids(spark):
    """Rows that repeat a doc_id with other texts are judged one by one."""
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    a, b = say(120), say(120)
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (3, say(80)), (None, a)], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]
    removed = sorted((x["doc_id"] or 0, x["n_removed"]) for x in substring_dedup.remove_repeats(df).collect())
    assert removed == [(0, 0), (1, 0), (1, 0), (2, 120), (3, 0), (3, 120)]
    gone = sorted((x["doc_id"] or 0, x["n_removed"] == x["n_bytes"]) for x in suffix_dedup.remove_long_matches(df).collect())
    assert gone == [(0, False), (1, True), (1, True), (2, True), (3, False), (3, True)]


def test_automaton(docs, empty, odd):
    path = vocabulary("word_bpe_49k.json")
    library = tokens.library_tokenizer(path)
    got = rows(automaton.encode_decode(docs, path, digests=False), "ids", "decoded")
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False)), i
    assert automaton.encode_decode(empty, path).count() == 0
    assert automaton.encode_decode(odd, path).count() == 4


def test_byte_level_ids():
    path = vocabulary("byte_bpe_50k.json")
    library = tokens.library_tokenizer(path)
    texts = [t or "" for _, t, *_ in corpus()] + ["a\n b", "a \n\n  b", " lead", "x<|endoftext|> y", "don't  stop 've", "　 wide 　", "tab\t end "]
    at, ids = tokens.spaced_ids(pa.array(texts, pa.large_string()), tokens.library_encoder(path))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, empty, odd):
    path = vocabulary("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, capacity=64, group_docs=8, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    library = tokens.library_tokenizer(path)
    for i, t, *_ in corpus():
        assert [x for _, ids in sorted(by_doc[i]) for x in ids] == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(odd, path).count() == 4


def test_first_fit_decreasing():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 101, 500)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for size in sorted(lengths.tolist(), reverse=True):
        k = next((i for i, room in enumerate(rooms) if room >= size), None)
        if k is None:
            rooms.append(100)
            k = len(rooms) - 1
        rooms[k] -= size
    assert len(set(bins.tolist())) == len(rooms)


def test_huffman(spark, docs, empty, odd, tmp_path):
    counts = np.array([0, 1, 1, 2, 5, 1000, 10**6, 3])
    lengths = huffman.code_lengths(counts, 5)
    assert lengths[0] == 0 and lengths.max() <= 5 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    ids = np.random.default_rng(0).integers(1, 8, 5000)
    bits, marks = huffman.pack_bits(ids, huffman.canonical_codes(lengths), lengths)
    assert (huffman.Decoder(lengths).decode(bits, len(ids), marks.view("<u8")) == ids).all()
    path = vocabulary("word_bpe_49k.json")
    library = tokens.library_tokenizer(path)
    huffman.write_tokens(docs, str(tmp_path / "t"), path)
    got, start = rows(huffman.read_tokens(spark, str(tmp_path / "t"), with_ids=True), "start", "n_tokens", "ids"), 0
    for i, t, *_ in corpus():
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(want), want)
        start += len(want)
    huffman.write_tokens(empty, str(tmp_path / "e"), path)
    assert huffman.read_tokens(spark, str(tmp_path / "e")).count() == 0
    huffman.write_tokens(odd, str(tmp_path / "o"), path)
    assert huffman.read_tokens(spark, str(tmp_path / "o")).count() == 2


def test_substring_dedup(spark, docs, empty, odd):
    got = rows(substring_dedup.remove_repeats(docs, with_text=True), "n_words", "n_removed", "kept")
    first = {}
    split = {i: WORDS.findall(t or "") for i, t, *_ in corpus()}
    for i, w in split.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert got[i] == (len(w), sum(gone), " ".join(kept)), i
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(odd).count() == 4
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len([w for i, w in split.items() if not w or got[i][1] < len(w)])


def test_suffix_dedup(docs, empty, odd):
    got = rows(suffix_dedup.remove_long_matches(docs, with_text=True), "n_bytes", "n_removed", "n_spans", "kept")
    data = {i: (t or "").encode() for i, t, *_ in corpus()}
    seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i] == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept), i
    assert suffix_dedup.remove_long_matches(empty).count() == 0
    assert suffix_dedup.remove_long_matches(odd).count() == 4


def test_crowded_keys(spark, monkeypatch):
    """A passage longer than a gram in many documents, in full and cut short, some of its keys with more spans than an index takes."""
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, phrase = noise(320), noise(130)
    texts = [noise(r.randrange(400)) + passage[r.randrange(90) : 320 - r.randrange(60)] + noise(r.randrange(400)) for _ in range(60)]
    texts += [noise(150) + phrase + r.choice("xyz") * 30 + r.choice([noise(200), "q" * 60 + noise(90)]) for _ in range(40)] + texts[:5]
    data = {i: t.encode() for i, t in enumerate(texts)}
    seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    got = rows(suffix_dedup.remove_long_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), with_text=True), "n_removed", "kept")
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert got[i] == (sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)), i


def test_run_length_index():
    r = random.Random(3)
    spans = ["".join(r.choice("ab") for _ in range(r.randint(5, 60))).encode() for _ in range(12)]
    spans[3] = spans[7][:30] + b"x"
    got = suffix_dedup.RunLengthIndex(spans).repeated_starts(8)
    seen = Counter(s[k : k + 8] for s in spans for k in range(len(s) - 7))
    for s, starts in zip(spans, got, strict=True):
        assert starts.tolist() == [k for k in range(len(s) - 7) if seen[s[k : k + 8]] > 1]


def test_near_dedup(docs, empty, odd):
    for width, percent in ((3, 85), (5, 80)):
        got = rows(near_dedup.near_duplicates(docs, width, percent), "n_shingles", "component_id", "kept")
        sets = {}
        for i, t, *_ in corpus():
            w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
            sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        part = {i: i for i in sets}
        for _ in sets:
            for i, a in sets.items():
                for j, b in sets.items():
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        part[i] = part[j] = min(part[i], part[j])
        for i, s in sets.items():
            assert got[i] == (len(s), part[i], part[i] == i), i
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(odd).count() == 4


def test_dense_groups_stay_whole(spark, monkeypatch):
    """More near copies than a leaf holds: blocks, central members and visits must join them all."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    texts = []
    for i in range(60):
        w = list(words)
        for _ in range(4):
            w[r.randrange(300)] = f"v{i}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(50))) for i in range(40)]
    out = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts)}
    part = {i: i for i in sets}
    for _ in range(60):
        for i in sets:
            for j in sets:
                if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
        if all(part[i] == part[part[i]] for i in part):
            break
    assert {r_["doc_id"]: r_["component_id"] for r_ in out} == part


def test_recall_at_full_depth(spark, monkeypatch):
    """Pairs exactly at the threshold, every one of which has to come down to the last level."""
    monkeypatch.setattr(near_dedup, "LEAF", 1)
    for percent in (80, 85):
        texts, n = [], 4000
        for i in range(n):
            own = (100 - percent) // 2
            for k, (a, b) in enumerate(((0, percent + own), (0, percent))):
                words = [f"{i}w{x}" for x in range(a, b)] + [f"{i}v{x}" for x in range(100 - percent - own if k else 0)]
                texts.append((2 * i + k, " ".join(words)))
        out = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 1, percent)
        missed = out.filter("doc_id % 2 = 1 and component_id = doc_id").count()
        assert out.filter("component_id <> doc_id - doc_id % 2 and component_id <> doc_id").count() == 0
        assert missed <= n * 0.001, (percent, missed)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in up if any(x in ab and ab[0] != ab[1] for ab in links)}


def test_toxicity(spark, empty, odd):
    docs_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs_, labels.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    said = toxicity.score(docs_, model).select("doc_id", F.col("toxic").alias("said"), "severity").join(labels.filter(held), "doc_id").toPandas()
    good = said[said.quality == 1]
    assert (good.said & (good.toxic == 1)).sum() >= 0.9 * (good.toxic == 1).sum()
    assert (said.said & (said.toxic == 0)).sum() <= 0.01 * (said.toxic == 0).sum()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, model).count() == 4
    assert toxicity.clean_rows(odd, model).columns == odd.columns
    toxic = said[said.toxic == 1]
    assert toxic.severity.mean() > said[said.toxic == 0].severity.mean() + 0.5
    # more of a toxic text's words never make it milder than none of them; a repeated text has one severity, however long
    text = docs_.join(labels.filter("toxic = 1 and quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    steps = spark.createDataFrame([(0, ""), (1, text), (2, text), (3, (text + " ") * 200)], "doc_id long, text string")
    by_id = {r["doc_id"]: r["severity"] for r in toxicity.score(steps, model).collect()}
    assert by_id[0] < by_id[1] == by_id[2] == by_id[3]
    blank = toxicity.train(docs_.limit(0), labels)
    assert toxicity.score(odd, blank).filter("toxic").count() == 0
