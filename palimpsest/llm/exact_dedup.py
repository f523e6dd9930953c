"""Exact dedup with a heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: `[\x20\x09-\x0D]+`, as Java's regex reads it.
SPACES = "[\\x20\\x09-\\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def heavy_hitters(rows: DataFrame, tracked: int = 512, hot_rows: int = 64) -> DataFrame:
    """Digests that are frequent, with their exact counts.

    A Misra-Gries summary of `tracked` counters (approx_top_k) holds every digest that more
    than rows / (0.75 * tracked) rows have; its candidates are then counted exactly. The
    result has `tracked` / 2 rows at most, whatever the input.
    """
    summary = rows.select(F.xxhash64("text_sha256").alias("h")).agg(F.expr(f"approx_top_k(h, {tracked // 2}, {tracked})").alias("top"))
    candidates = summary.select(F.explode("top").alias("c")).select(F.col("c.item").alias("h"))
    return (
        rows.withColumn("h", F.xxhash64("text_sha256"))
        .join(F.broadcast(candidates), "h", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= hot_rows)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 512, hot_rows: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; the
    smallest doc_id of equal texts stays. Null text counts as empty. Rows that repeat a doc_id
    and text count in group_size and share the flag. A null doc_id loses to any other; a group
    of null ids only has keep_id null and is kept. Other columns are not read; an empty table
    gives an empty result.
    """
    rows = checkpointed(digests(docs, id_col, text_col))
    hot = checkpointed(heavy_hitters(rows, tracked, hot_rows))
    removed_at_map = rows.join(F.broadcast(hot), "text_sha256")
    group = Window.partitionBy("text_sha256")
    shuffled = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").select(
        "text_sha256", "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    both = removed_at_map.select(shuffled.columns).unionByName(shuffled)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
