"""URL filters: dated list entries become intervals, and captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of at most so many intervals are broadcast; longer ones are shuffled by key.
BROADCAST_ROWS = 100_000


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, action, effective) rows -> (entry, action, valid_from, valid_to).

    Each row sets the entry's state from its date to the next row of the same entry. Action is
    block, allow or remove. Of rows on one date the last by name wins (remove, then block).
    Rows with a null entry, action or date are ignored; entries are trimmed, and
    their hosts lower-cased; paths keep their case.
    """
    host = F.substring_index(F.trim("entry"), "/", 1)
    named = F.concat(F.lower(host), F.substr(F.trim("entry"), F.length(host) + 1))
    clean = entries.select(named.alias("entry"), F.lower("action").alias("action"), F.col("effective").cast("date").alias("valid_from")).dropna()
    daily = clean.groupBy("entry", "valid_from").agg(F.max("action").alias("action"))
    over = Window.partitionBy("entry").orderBy("valid_from")
    return daily.withColumn("valid_to", F.lead("valid_from").over(over)).filter(F.col("action").isin("block", "allow"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """What a list may name: the host, each parent domain of two labels at least, and host with each path prefix."""
    labels = F.split(host_of(url), "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host_of(url), F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i))))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(parents, prefixes))).otherwise(F.array().cast("array<string>"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per capture: id, fetched, blocked, entry, listed_since, n_active.

    An entry is active for a capture when valid_from <= fetched < valid_to (open end: no
    valid_to). Of the active entries that name the URL the longest decides, so an allowed path
    overrides its blocked domain. Null or malformed URLs and null times match nothing and are
    not blocked. Each capture is judged by its own URL, also where ids repeat or are null.
    """
    rules = intervals(entries)
    small = rules.limit(broadcast_rows + 1).count() <= broadcast_rows
    keyed = captures.select(F.col(id_col).alias("id"), F.col(time_col).cast("date").alias("fetched"), F.col(url_col).alias("url")).select("*", F.posexplode_outer(keys_of(F.col("url"))).alias("pos", "key"))
    rules = F.broadcast(rules) if small else rules
    active = (keyed["key"] == rules["entry"]) & (keyed["fetched"] >= rules["valid_from"]) & (rules["valid_to"].isNull() | (keyed["fetched"] < rules["valid_to"]))
    joined = keyed.join(rules, active, "left")
    best = F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), "entry", "action", "valid_from")))
    # intervals of one entry don't overlap, so each key of each capture is one row here
    captured = F.count_if(F.col("pos").isNull() | (F.col("pos") == 0))
    return (
        joined.groupBy("id", "fetched", "url")
        .agg(best.alias("best"), F.count("entry").alias("n"), captured.alias("captures"))
        .withColumn("n_active", (F.col("n") / F.col("captures")).cast("long"))
        .withColumn("capture", F.explode(F.sequence(F.lit(1).cast("long"), F.col("captures"))))
        .select(F.col("id").alias(id_col), "fetched", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), F.col("best.entry").alias("entry"), F.col("best.valid_from").alias("listed_since"), "n_active")
    )
