"""Numbers of models: sigmoid, softmax, confidence, rounding; and what decodes their outputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of entity types that models use, and ours.
ENTITY_NAMES = {
    "NAME": "NAME", "PERSON": "NAME", "GIVENNAME": "NAME", "FIRSTNAME": "NAME", "LASTNAME": "NAME", "SURNAME": "NAME", "MIDDLENAME": "NAME", "EMAIL": "EMAIL",
    "TEL": "PHONE", "PHONE": "PHONE", "PHONENUMBER": "PHONE", "PHONEIMEI": "PHONE", "CREDITCARDNUMBER": "CARD", "CREDITCARDCVV": "CARD", "CREDITCARD": "CARD", "IP": "IP_ADDRESS", "IPV4": "IP_ADDRESS", "IPV6": "IP_ADDRESS",
}
#: How sure a span of a model must be.
SPAN_THRESHOLD = 0.85


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Shares of an array of numbers; null of an empty one."""
    high = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - high))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(xs) > 0, F.transform(e, lambda x: x / total))


def best_class(xs: Column) -> Column:
    """struct<index, confidence> of the largest of an array of logits, the first of equals."""
    p = softmax(xs)
    top = F.array_max(p)
    return F.struct((F.array_position(p, top) - 1).cast("int").alias("index"), top.alias("confidence"))


def half_even(x: Column) -> Column:
    return F.rint(x)


def entity_name(raw: Column) -> Column:
    key = F.regexp_replace(F.upper(raw), r"[\s_-]", "")
    names = F.create_map(*(F.lit(v) for kv in ENTITY_NAMES.items() for v in kv))
    return F.coalesce(F.try_element_at(names, key), F.upper(raw))


def tag_parts(label: Column) -> Column:
    """struct<prefix, type> of a label such as B-NAME; O stands for none, a label without a prefix begins a span."""
    up = F.upper(F.trim(F.coalesce(label, F.lit("O"))))
    prefix, kind = F.regexp_extract(up, "^([BI])[-_](.+)$", 1), F.regexp_extract(up, "^([BI])[-_](.+)$", 2)
    none = up.isin("", "O", "0")
    return F.struct(F.when(none, "O").when(prefix != "", prefix).otherwise("B").alias("prefix"), F.when(none, "O").when(prefix != "", kind).otherwise(up).alias("type"))


def spans(tokens: DataFrame, threshold: float = SPAN_THRESHOLD) -> DataFrame:
    """tokens (text_id, ord, label, confidence, start, end) -> (text_id, type, start, end, confidence).

    Tokens of one type in a row are a span, which a B or another type ends; its confidence is
    the mean. Tokens under the threshold, and O, belong to none and end one.
    """
    rows = tokens.withColumn("t", tag_parts(F.col("label"))).withColumn("type", F.when((F.col("confidence") >= threshold) & (F.col("t.type") != "O"), entity_name(F.col("t.type"))))
    w = Window.partitionBy("text_id").orderBy("ord")
    new = F.col("type").isNotNull() & ((F.col("t.prefix") == "B") | ~F.lag("type").over(w).eqNullSafe(F.col("type")))
    part = rows.withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(w)).filter("type is not null")
    return part.groupBy("text_id", "part", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence")).drop("part")


def read_line(best: Column, letters: Column) -> Column:
    """Greedy reading of a line: best classes by time, repeats once, class 0 nothing, class i letter i of an array of letters from 0."""
    kept = F.filter(F.transform(best, lambda c, i: F.when((i == 0) | (F.get(best, i - 1) != c), c).otherwise(0)), lambda c: (c > 0) & (c < F.size(letters)))
    return F.array_join(F.transform(kept, lambda c: F.get(letters, c)), "")


def faces(cells: DataFrame, least: float = 0.6) -> DataFrame:
    """Cells (image, stride, row, col, cls, obj, dx, dy, dw, dh) of a face detector -> boxes (image, score, x, y, width, height) of those sure enough."""
    score = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cls"))) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("obj"))))
    s = F.col("stride")
    w, h = F.exp("dw") * s, F.exp("dh") * s
    return cells.withColumn("score", score).filter(F.col("score") >= least).select("image", "score", ((F.col("col") + F.col("dx")) * s - w / 2).alias("x"), ((F.col("row") + F.col("dy")) * s - h / 2).alias("y"), w.alias("width"), h.alias("height"))


def document_types(text: Column) -> Column:
    """Types of what a text read from a picture shows, each once: AADHAAR, PAN, MRZ_PASSPORT or else PASSPORT_LIKE, IBAN, DOB."""
    from . import checks as K
    from . import patterns as P

    text = F.coalesce(text, F.lit(""))
    found = lambda p: F.regexp_extract_all(text, F.lit(P.java(p)), F.lit(0))
    mrz = F.concat(found("[A-Z0-9<]{44}"), F.regexp_extract_all(F.regexp_replace(text, P.java(r"\s+"), ""), F.lit("[A-Z0-9<]{44}"), F.lit(0)))
    passport = F.when(F.exists(mrz, K.mrz_line2), "MRZ_PASSPORT").when(text.rlike("(?i)passport"), "PASSPORT_LIKE")
    born = text.rlike(P.java(r"(?i)\bd\.?o\.?b\b")) & text.rlike(P.java(r"\b\d{2}[- /]\d{2}[- /]\d{4}\b"))
    return F.array_compact(F.array(
        F.when(F.exists(found(r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b"), lambda m: K.verhoeff(K.digits(m))), "AADHAAR"), F.when(text.rlike(P.java(P.PATTERNS["PAN"])), "PAN"), passport,
        F.when(F.exists(found(P.PATTERNS["IBAN"]), K.iban), "IBAN"), F.when(born, "DOB"),
    ))


def word_pieces(vocabulary: list[str], unknown: str = "[UNK]", most: int = 100):
    """A pandas UDF: text -> array<struct<piece, start, end>>, words and punctuation cut greedily into the longest pieces of a vocabulary, ## before those inside a word."""
    import re

    known = frozenset(vocabulary)
    schema = "array<struct<piece:string,start:int,end:int>>"

    def cut(word: str, at: int) -> list[tuple]:
        out, lo = [], 0
        if len(word) > most:
            return [(unknown, at, at + len(word))]
        while lo < len(word):
            hi = next((h for h in range(len(word), lo, -1) if ("##" if lo else "") + word[lo:h] in known), None)
            if hi is None:
                return [(unknown, at, at + len(word))]
            out.append((("##" if lo else "") + word[lo:hi], at + lo, at + hi))
            lo = hi
        return out

    def run(texts: pd.Series) -> pd.Series:
        words = lambda t: [p for m in re.finditer(r"\w+|[^\w\s]", t) for p in cut(m[0], m.start())]
        return texts.map(lambda t: [{"piece": p, "start": a, "end": b} for p, a, b in words(t or "")])

    return F.pandas_udf(run, schema)
