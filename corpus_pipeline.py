"""The corpus pipeline: toxicity, exact dedup, near dedup, substring dedup, packing.

Each stage reads all that the one before it kept, written as Parquet. Documents that a stage
rejects go; all but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import discarded, numbered, shared_folder
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.near_dedup import near_duplicates
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.substring_dedup import without_repeats
from palimpsest.llm.toxicity import clean_rows, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't reject."""
    return clean_rows(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs), which takes doc_id for a key: rows are numbered before if some ids are null or repeat."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        return stage(docs)
    # a number for every row, those without an id last
    given = numbered(docs.withColumn("__given_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1))), F.sha2("text", 256)).drop("__own_id")
    return stage(given).withColumn("doc_id", F.col("__given_id")).select(docs.columns)


def without(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs less the rows that judge says aren't kept, each row judged by itself."""
    return by_row(docs, lambda rows: rows.join(judge(rows).filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(rows.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    return without(docs, lambda rows: near_duplicates(rows, width=5, percent=80))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document has."""
    return by_row(docs, without_repeats)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substrings), ("packing", packing)]

#: Stages that fit models and encode tokens have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            discarded(spark, before)
        docs, before = spark.read.schema(docs.schema).parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
