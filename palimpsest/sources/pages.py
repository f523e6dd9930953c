"""Raw HTML as tables: lines, links, headings, and counts of table rows, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content that is not text, elements that end a line, and the five predefined entities.
SKIPPED = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
BREAKS = r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|nav|article|section|header|footer|title|form|body|head|html)|br|hr)\b[^>]*>"
NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain(html: Column) -> Column:
    """Text of HTML: tags gone, predefined entities replaced, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line_no, line): visible lines in order; empty ones and repeats of the line before are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), SKIPPED, " "), BREAKS, "\n"), "\n")
    lines = F.filter(F.transform(parts, plain), lambda x: x != "")
    fresh = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (s["i"] == 0) | (F.get(lines, s["i"] - 1) != s["x"]))
    return pages.select(key, F.posexplode(fresh).alias("line_no", "l")).select(key, "line_no", F.col("l.x").alias("line"))


def visible_text(html: Column) -> Column:
    return plain(F.regexp_replace(F.coalesce(html, F.lit("")), SKIPPED, " "))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, href, text) of each anchor with a quoted href."""
    pattern = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>.*?</a>'
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    return pages.select(key, F.posexplode(found).alias("ord", "a")).select(key, "ord", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), plain(F.col("a")).alias("text"))


def page_headings(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = 10) -> DataFrame:
    """(key, ord, level, text) of the first `most` headings of a page."""
    found = F.slice(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0)), 1, most)
    return pages.select(key, F.posexplode(found).alias("ord", "h")).select(key, "ord", F.substring("h", 3, 1).cast("int").alias("level"), plain(F.col("h")).alias("text"))


def page_counts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n_links, n_rows, n_inputs, n_headings) by opening tags."""
    count = lambda p: F.regexp_count(F.col(html), F.lit(p))
    return pages.select(key, count(r"(?i)<a\b").alias("n_links"), count(r"(?i)<tr\b").alias("n_rows"), count(r"(?i)<(input|select|textarea)\b").alias("n_inputs"), count(r"(?i)<h[1-6]\b").alias("n_headings"))
