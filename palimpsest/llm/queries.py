"""Queries over the driver's tables: thin wrappers around the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import encode_decode
from .common import documents, shared_folder
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .huffman import read_tokens, write_tokens
from .infilling import digests
from .language_id import held_out_languages
from .multiset_hash import edited_fingerprints
from .near_dedup import near_duplicates
from .packing import pack_documents
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_long_matches
from .toxicity import score, train
from .url_filters import url_filter



def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A dated block list for the query: (entry, action, effective).
URL_LIST = [
    ("spam-farm.example.org", "block", "2024-01-10"), ("spam-farm.example.org", "remove", "2024-06-01"), ("spam-farm.example.org", "block", "2024-09-15"),
    ("example.net", "block", "2024-03-01"), ("example.net", "remove", "2024-05-01"),
    ("example.com", "block", "2024-11-01"), ("example.com", "remove", "2024-12-01"),
    ("thher.example.org/en", "block", "2024-02-01"), ("m.ththth.example.net", "allow", "2024-04-01"),
    ("blog.ththan.example.net/en", "allow", "2024-01-01"), ("blog.ththan.example.net/en", "remove", "2024-04-10"),
    ("therha.example.com/en", "allow", "2024-10-01"), ("blog.tiontion.example.com", "block", "2024-07-01"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    entries = spark.createDataFrame(URL_LIST, "entry string, action string, effective string")
    return url_filter(pages, entries)


OP1_SQL = """
WITH e(entry, action, effective) AS (VALUES %s),
d AS (SELECT entry, CAST(effective AS DATE) AS valid_from, max(action) AS action FROM e GROUP BY 1, 2),
r AS (SELECT *, lead(valid_from) OVER (PARTITION BY entry ORDER BY valid_from) AS valid_to FROM d),
p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id %% 366 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.page_id, p.fetched, r.entry, r.action, r.valid_from,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.entry) DESC, r.entry DESC) AS k, count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN r ON r.action IN ('block', 'allow') AND p.fetched >= r.valid_from AND (r.valid_to IS NULL OR p.fetched < r.valid_to)
  AND (p.host = r.entry OR ends_with(p.host, '.' || r.entry) OR starts_with(p.host || rtrim(p.path, '/') || '/', r.entry || '/')))
SELECT p.page_id, p.fetched, coalesce(m.action = 'block', false) AS blocked, m.entry AS entry, m.valid_from AS listed_since, coalesce(m.n, 0) AS n_active
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
""" % ", ".join(map(str, URL_LIST))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_long_matches(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h IS NULL OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), shift_every=7)


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_document_fingerprints, op3_bpe_codec, op4_exact_dedup, op5_packing, op6_substring_dedup, op7_toxicity, op8_near_dedup, op9_suffix_dedup, op10_token_files, op11_fill_in_middle, op12_language_id, op13_hard_negatives)}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op13_hard_negatives": OP13_SQL}
