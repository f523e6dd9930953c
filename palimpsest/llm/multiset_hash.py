"""Homomorphic multiset hash of documents, in DataFrame functions only.

A document is the multiset of its paragraphs, the lines that aren't empty. Each hashes to a wide
vector: four lanes of 32 random bits of the whole paragraph, and 126 lanes that count one
random bit of each of its pieces. A fingerprint is the sum of the paragraphs' vectors, the first
lanes modulo 2**32, the others, three in a number, modulo 2**64, so it does not
depend on order, and paragraphs are inserted or deleted by adding
or subtracting their fingerprints. The one-bit lanes, read as signs, also estimate how many
pieces two documents share. A piece that a paragraph has n times counts 1 + log2(n) times, so
that a word said over and over does not outweigh all else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import by_row, checkpointed, shared_folder

#: Packed words of a hash: bits k, k + 21 and k + 42 of it are counted in three lanes of one number. The lanes stay apart up to 2**21
#: pieces of a text; beyond that likeness suffers, not equality, insertion or deletion.
WORDS, LANE = 21, 21
UNITS, HALF, FULL = 1 | 1 << 21 | 1 << 42, (1 << 32) - 1, (1 << 21) - 1
#: One word in so many ends a piece, and the most code points of a piece.
PIECE_WORDS, LONGEST = 4, 80
#: Stands after a word that ends a piece.
CUT = "\x01"
#: Times that a repeated piece of a paragraph counts at, after the first.
POWERS = [1 << k for k in range(1, 31)]


def paragraphs(text: Column) -> Column:
    """The lines of a text. Empty ones don't count."""
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def pieces(paragraph: Column, words: int = PIECE_WORDS) -> Column:
    """A paragraph, cut after words whose hash says so, about every `words` words: what comes before or after doesn't move the cuts.

    A letter of a script without case, which may have no spaces, is a word. A piece has LONGEST code points at most.
    """
    spaced = F.when(paragraph.rlike("\\p{Lo}"), F.regexp_replace(paragraph, "(\\p{Lo})", "$1 ")).otherwise(paragraph)
    marked = F.transform(F.split(spaced, " "), lambda w: F.when(F.xxhash64(w) % words == 0, F.concat(w, F.lit(CUT))).otherwise(w))
    return F.regexp_extract_all(F.array_join(marked, " "), F.lit("[^%s]{1,%d}" % (CUT, LONGEST)), F.lit(0))


def damped(hashes: Column) -> Column:
    """Hashes of pieces, each once for its first, second, fourth, eighth ... time, with another hash every time."""

    def times(s: Column) -> Column:
        """s is sorted, so the n-th equal element at i has its first at i - n + 1."""
        said = lambda i, x: F.get(s, i).eqNullSafe(x)
        again = lambda x, i: F.transform(F.filter(F.array(*map(F.lit, POWERS)), lambda n: said(i - n + 1, x) & ~said(i - n, x)), lambda n: F.xxhash64(x, n))
        return F.flatten(F.transform(s, lambda x, i: F.when(said(i - 1, x), again(x, i)).otherwise(F.array(x))))

    return let(F.sort_array(hashes), times)


def hashes_of(lines: Column, words: int = PIECE_WORDS) -> Column:
    """array<bigint>: the hashes of the pieces of paragraphs that count."""
    return F.flatten(F.transform(lines, lambda p: damped(F.transform(pieces(p, words), lambda x: F.xxhash64(x)))))


def wide_of(lines: Column) -> Column:
    """array<bigint>: the four sums of the halves of two hashes of each paragraph."""
    total = lambda hs, f: F.aggregate(hs, F.lit(0).cast("bigint"), lambda acc, h: acc + f(h))
    both = F.array(F.transform(lines, lambda p: F.xxhash64(p)), F.transform(lines, lambda p: F.xxhash64(p, F.lit(1))))
    return let(both, lambda hs: F.array(*(total(hs[i], f) for i in (0, 1) for f in (lambda h: h.bitwiseAND(F.lit(HALF)), lambda h: F.shiftrightunsigned(h, 32)))))


def lanes_of(h: Column, g: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, k).bitwiseAND(F.lit(UNITS)) for x in (h, g) for k in range(WORDS)]


def summed(rows: DataFrame, text: str, *keys: str, words: int = PIECE_WORDS) -> DataFrame:
    """(keys..., f): the fingerprint of each row's text. keys tell rows apart. The pieces are summed by Spark's own aggregation, before any exchange."""
    c, wide = F.col, [f"__w{i}" for i in range(4)]
    # what stands beside an explode would be worked out again for every piece
    found = rows.select(*keys, paragraphs(c(text)).alias("__lines")).select(*keys, wide_of(c("__lines")).alias("__w"), hashes_of(c("__lines"), words).alias("__h"))
    flat = found.select(*keys, *(c("__w")[i].alias(n) for i, n in enumerate(wide)), "__h")
    each = flat.select(*keys, *wide, F.explode_outer("__h").alias("h")).withColumn("g", F.when(c("h").isNotNull(), F.xxhash64("h")))
    lanes = [F.coalesce(F.sum(x), F.lit(0).cast("bigint")) for x in lanes_of(c("h"), c("g"))]
    names = [f"__{i}" for i in range(1 + len(lanes))]
    out = each.groupBy(*keys, *wide).agg(*(x.alias(n) for x, n in zip([F.count("h"), *lanes], names, strict=True)))
    return out.select(*keys, masked(F.array(names[0], *wide, *names[1:])).alias("f"))


def fingerprint(text: Column, words: int = PIECE_WORDS) -> Column:
    """Of one text, array<bigint>: count of pieces, four wide lanes, 2 * WORDS packed words of three lanes each. `summed` is the form for tables."""

    def sums(hs: Column, wide: Column) -> Column:
        zero = F.array_repeat(F.lit(0).cast("bigint"), 2 * WORDS)
        lanes = F.aggregate(hs, zero, lambda acc, h: F.zip_with(acc, F.array(*lanes_of(h, F.xxhash64(h))), lambda x, y: x + y))
        return masked(F.concat(F.array(F.size(hs).cast("bigint")), wide, lanes))

    return let(paragraphs(text), lambda lines: let(hashes_of(lines, words), lambda hs: sums(hs, wide_of(lines))))


def masked(f: Column) -> Column:
    """Wide lanes modulo 2**32. The lanes of a packed word stay below that, as no text has so many pieces."""
    return F.transform(f, lambda x, i: F.when(i.between(1, 4), x.bitwiseAND(F.lit(HALF))).otherwise(x))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return masked(F.zip_with(a, b, lambda x, y: x + y))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of multiset a without b's paragraphs, which it has."""
    return masked(F.zip_with(a, b, lambda x, y: x - y))


def as_text(f: Column) -> Column:
    return F.concat_ws("", F.transform(f, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the sign lanes of two fingerprints, 0 to 1: about the share of pieces in common. Both empty: 1."""
    lanes = lambda w: [F.shiftrightunsigned(w, LANE * j).bitwiseAND(F.lit(FULL)).cast("double") for j in range(3)]
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        def one(p: Column, q: Column) -> Column:
            a0, a1, a2, b0, b1, b2 = *lanes(p), *lanes(q)
            return a0 * b0 + a1 * b1 + a2 * b2

        return F.aggregate(F.zip_with(x, y, one), zero, lambda s, v: s + v)

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda s, w: s + lanes(w)[0] + lanes(w)[1] + lanes(w)[2])

    def of(v: Column) -> Column:
        """A lane's sign sum is twice its count less the number of pieces, so dot products follow from those of the counts."""
        n, m = v["n"].cast("double"), v["m"].cast("double")
        signed = lambda d, x, sx, y, sy: 4 * d - 2 * x * sy - 2 * y * sx + 6 * WORDS * x * y
        norm = F.sqrt(signed(v["aa"], n, v["sa"], n, v["sa"])) * F.sqrt(signed(v["bb"], m, v["sb"], m, v["sb"]))
        cosine = F.least(F.lit(1.0), F.greatest(zero, signed(v["ab"], n, v["sa"], m, v["sb"]) / norm))
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).when(norm > 0, cosine).otherwise(0.0)

    def parts(xy: Column) -> Column:
        x, y = xy[0], xy[1]
        return let(F.struct(a[0].alias("n"), b[0].alias("m"), dot(x, x).alias("aa"), dot(y, y).alias("bb"), dot(x, y).alias("ab"), total(x).alias("sa"), total(y).alias("sb")), of)

    return F.when(a == b, 1.0).otherwise(let(F.array(F.slice(a, 6, 2 * WORDS), F.slice(b, 6, 2 * WORDS)), parts))


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, n) -> (doc_id, prev_id, prev_n): the row before in ascending doc_id; before the first comes the last.

    Sorted by range partitions; only each partition's last row meets in one place.
    """
    ranged = checkpointed(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "n")).alias("end"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(order), F.last("end").over(everything)).alias("before"))
    own = Window.partitionBy("part").orderBy("doc_id")
    linked = ranged.withColumn("prev", F.lag(F.struct("doc_id", "n")).over(own)).join(F.broadcast(ends), "part")
    prev = F.coalesce("prev", "before")
    return linked.select("doc_id", prev["doc_id"].alias("prev_id"), prev["n"].alias("prev_n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PIECE_WORDS) -> DataFrame:
    """(doc_id, n, f): code points and fingerprint of each text, whose id is its own; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.length(text).cast("bigint").alias("n"))
    return summed(sized, "text", "doc_id", "n", words=words)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PIECE_WORDS) -> DataFrame:
    """Fingerprints of every text, of the text with its last quarter replaced by the next one's start, and their likeness.

    Null text counts as empty; an only document is its own next. Rows that repeat a doc_id are
    documents in the order of their texts' digests. Rows with a null doc_id have a fingerprint, but no
    neighbour and nothing edited. Two empty texts have likeness 1, an empty and another 0. Texts
    of any length are read whole.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = by_row(given.filter(F.col("doc_id").isNotNull()), lambda rows: with_neighbours(rows, words))
    if given.filter(F.col("doc_id").isNull()).isEmpty():
        return found  # by itself, as Spark does not share the exchange of texts inside a union
    none = lambda t: F.lit(None).cast(t)
    alone = given.filter(F.col("doc_id").isNull()).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), none("string").alias("edited_sha256"), as_text(fingerprint(F.col("text"), words)).alias("fingerprint"),
        none("string").alias("edited_fingerprint"), none("double").alias("near_edited"), none("double").alias("near_next"),
    )
    return found.unionByName(alone)


def with_neighbours(rows: DataFrame, words: int) -> DataFrame:
    """edited_fingerprints of (doc_id, text) without nulls and repeated ids.

    Every text is hashed once, and what comes of it written. Texts are exchanged once: the join
    that takes their starts and the one that edits them read the same exchange.
    """
    c, one = F.col, F.lit(1)
    folder = shared_folder(rows.sparkSession, "fingerprints")
    fingerprints(rows, words=words).write.parquet(folder)
    hashed = rows.sparkSession.read.parquet(folder)
    near = neighbours(hashed.select("doc_id", "n")).hint("shuffle_hash")
    starts = rows.join(near, "doc_id").select(c("prev_id").alias("doc_id"), F.substring("text", one, F.floor(c("prev_n") / 4).cast("int")).alias("start"))
    n = F.length("text")
    kept = F.substring("text", one, n - F.floor(n / 4).cast("int"))
    cut = rows.join(starts.hint("shuffle_hash"), "doc_id").select("doc_id", n.cast("bigint").alias("n_chars"), F.concat(kept, F.col("start")).alias("edited"))
    now = summed(cut.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "doc_id", "n_chars", "edited_sha256", words=words).withColumnRenamed("f", "e")
    own, following = hashed.select("doc_id", "f"), hashed.select("doc_id", c("f").alias("next_f")).join(near, "doc_id").select(c("prev_id").alias("doc_id"), "next_f")
    both = now.join(own.hint("shuffle_hash"), "doc_id").join(following.hint("shuffle_hash"), "doc_id")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(c("f")).alias("fingerprint"), as_text(c("e")).alias("edited_fingerprint"), likeness(c("f"), c("e")).alias("near_edited"), likeness(c("f"), c("next_f")).alias("near_next"))
