"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlex.llm import bpe, exact_dedup, imatch, language_id, mixing, near_dedup, shards, substring_dedup, token_counts, url_filter
from textlex.llm.tables import folder

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path(WORD_BPE))
    return coded.select(
        "doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(WORD_BPE))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


#: Shares of the tokens of the mixture.
TARGETS = {"high": 0.7, "low": 0.3, "toxic": 0.0}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, mixing.by_quality(table(spark, sf_dir, "labels")))
    return mixing.rates(docs, model, TARGETS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder; the digest is of the records written."""
    path = f"{folder(spark)}/shards-{uuid.uuid4().hex}"
    placed = shards.write_shards(table(spark, sf_dir, "documents"), path, n_shards=40)
    return placed.select("doc_id", *shards.ADDED)


#: The listed entries: host, path, verdict.
URL_ENTRIES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(URL_ENTRIES, "rule_host string, rule_path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), entries, keep=["page_id"])


OP8_SQL = f"""
WITH entries(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_ENTRIES))}),
parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ranked AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM parsed LEFT JOIN entries ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, verdict FROM ranked WHERE k = 1
"""

def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_next(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language_id, op3_token_counts, op4_near_dedup, op5_mixing, op6_exact_dedup, op7_shards, op8_url_filter, op9_imatch, op10_substring_dedup)}
ORACLE: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op8_url_filter": OP8_SQL}
