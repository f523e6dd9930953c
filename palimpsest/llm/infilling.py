"""Fill-in-middle transformation by lookaround splitting, in DataFrame functions only.

A unit grammar names pairs of neighbouring classes. It is translated to a regex that matches
the empty place between a character of the left class and one of the right class; Spark's split
at such places loses nothing, so the pieces of a text are its units. A text is first cut into
blocks, each of whole units, and only the blocks are split: units of a long text never stand in
one array. The empty text has no place to split at, and no units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: (class before, class after) of the places where a unit ends and the next begins.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "chars": [("", "")],
    "words": [("[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]")],
    "lines": [("\\n", "[^\\n]|\\n")],
    "runs": [(c, f"[^{c[1:-1]}]") for c in ("[\\p{L}\\p{M}]", "[\\p{N}]", "[\\x20\\x09-\\x0D]")] + [("[^\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]", "[\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]")],
}
#: Code points that a block has at least, unless it is the last.
BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(grammar: str) -> str:
    """The zero-width regex of a grammar's boundaries. A class that holds all characters asks for no look, so that of code points is the empty regex."""
    around = ["".join(("(?<=" + left + ")" if left else "", "(?=" + right + ")" if right else "")) for left, right in GRAMMARS[grammar]]
    return "(?:" + "|".join(around) + ")" if all(around) else ""


def blocks(text: Column, grammar: str, size: int = BLOCK) -> Column:
    """Pieces of at least `size` code points that end at boundaries; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{size},}}?{boundary(grammar)}|.+"), F.lit(0))


def units(block: Column, grammar: str) -> Column:
    """The units of a block that isn't empty."""
    return F.split(block, boundary(grammar), -1)


def measured(text: Column, grammar: str) -> Column:
    """The blocks of a text as array<struct<block, n, chars>>: with how many units and code points each has."""
    return F.transform(blocks(text, grammar), lambda b: F.struct(b.alias("block"), F.size(units(b, grammar)).cast("bigint").alias("n"), F.length(b).cast("bigint").alias("chars")))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"])


def place(parts: Column, k: Column, grammar: str) -> Column:
    """How many code points the first k units have. Only the block that unit k ends in is split."""
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, b: Column) -> Column:
        inside = F.length(F.concat_ws("", F.slice(units(b["block"], grammar), F.lit(1), (k - acc["units"]).cast("int"))))
        found = F.when(k <= acc["units"], acc["found"]).when(k >= acc["units"] + b["n"], acc["chars"] + b["chars"]).otherwise(acc["chars"] + inside)
        return F.struct((acc["units"] + b["n"]).alias("units"), (acc["chars"] + b["chars"]).alias("chars"), found.alias("found"))

    return F.aggregate(parts, F.struct(zero.alias("units"), zero.alias("chars"), zero.alias("found")), step, lambda acc: acc["found"])


def drawn(seed: int, id_col: Column) -> Column:
    """The first four groups of eight hex digits of sha256 of `seed:id`, as numbers; null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def fill_in_middle(docs: DataFrame, grammar: str = "chars", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix, middle, suffix, output.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger.
    Form is plain for `plain_percent` of the ids, and where the text is empty or null, holds a
    sentinel, or has no id to draw from; else spm for `spm_percent`, psm for the rest. Draws
    depend on seed and id alone, so rows that repeat an id are cut alike, in their own texts. A plain
    row has null parts. Whole texts of any length are cut; other columns are not read.
    """
    c = F.col
    given = docs.select(c(id_col).alias("doc_id"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    cut = let(F.struct(measured(c("text"), grammar).alias("parts"), drawn(seed, c("doc_id")).alias("h")), lambda x: cuts(x["parts"], x["h"], c("text"), grammar, plain_percent, spm_percent))
    t, a, b = c("text"), c("x.a").cast("int"), c("x.b").cast("int")
    piece = lambda x: F.when(c("x.form") != "plain", x)
    parts = given.select("doc_id", "text", cut.alias("x")).select(
        "doc_id", "text", "x.n", "x.form", piece(F.substr(t, F.lit(1), a)).alias("prefix"), piece(F.substr(t, a + 1, b - a)).alias("middle"), piece(F.substr(t, b + 1)).alias("suffix")
    )
    p, m, s = c("prefix"), c("middle"), c("suffix")
    output = F.when(c("form") == "plain", c("text")).when(c("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def cuts(parts: Column, h: Column, text: Column, grammar: str, plain_percent: int, spm_percent: int) -> Column:
    """struct<n, form, a, b>: units, form, and the code points before the middle and before the suffix."""

    def chosen(n: Column) -> Column:
        plain = (n == 0) | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | h[0].isNull() | (h[2] % 100 >= 100 - plain_percent)
        form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
        at = lambda k: F.when(~plain, place(parts, k, grammar))
        return F.struct(n.alias("n"), form.alias("form"), at(F.least(h[0] % (n + 1), h[1] % (n + 1))).alias("a"), at(F.greatest(h[0] % (n + 1), h[1] % (n + 1))).alias("b"))

    return let(total(parts), chosen)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: split at its sentinels, pieces in their first order."""
    pieces = F.split(output, f"<[{PREFIX[1]}{SUFFIX[1]}{MIDDLE[1]}]>", -1)
    return F.when(form == "plain", output).otherwise(let(pieces, lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1]))))


def digests(docs: DataFrame, grammar: str = "chars", seed: int = 1) -> DataFrame:
    """fill_in_middle as lengths and digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    c = F.col
    out = fill_in_middle(docs, grammar, seed)
    long = lambda x: F.length(x).cast("bigint")
    return out.select("doc_id", "n", "form", long("prefix").alias("prefix_chars"), long("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(c("output"), c("form")), 256).alias("restored_sha256"))
