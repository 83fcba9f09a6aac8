"""A corpus pipeline of five operators: each stage works on all documents that the stage before kept.

Decisions go by row, not by doc_id: a stage numbers its rows by their place in its files, and exactly the rows decided on stay.

Defined cases of all stages: null texts count as empty; repeated ids and rows, and rows without an id, are documents of their own;
an empty table gives an empty result; the first four stages return the columns they got, whatever their names, and further
columns don't matter to them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlex.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from textlex.llm.queries import WORD_BPE, table
from textlex.llm.tables import fresh, row_key, written

#: Texts whose language has a score below this are in none of the languages learned (learned: 0.26 and more, others: 0.15 and less).
MIN_SCORE = 0.17
SEED, DROPPED = 20260101, "toxic"


def _fresh(docs: DataFrame, n: int) -> list[str]:
    return [fresh(docs, f"key{i}") for i in range(n)]


def _only(docs: DataFrame, key: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of docs whose key is in kept (k0, k1, ...)."""
    names = _fresh(docs, len(key))
    keyed = docs.select("*", *[c.alias(n) for n, c in zip(names, key, strict=True)])
    same = [keyed[n] == kept[f"k{i}"] for i, n in enumerate(names)]
    return keyed.join(kept, same, "left_semi").drop(*names)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that was learned from the labelled ones. Texts without a letter go."""
    model = language_id.train(docs)
    label, score = _fresh(docs, 2)
    found = language_id.identify(docs, model, lang_pred=label, score=score, drop_text=False)
    return found.filter((F.col(label) != language_id.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest doc_id."""
    docs, key = row_key(docs)
    return _only(docs, key, exact_dedup.kept_rows(docs, key))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, of the least doc_id."""
    docs, key = row_key(docs)
    return _only(docs, key, near_dedup.kept_rows(docs, key))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes to target totals: those of the documents that are likely not toxic, with room of a twentieth for the other domains.

    A document stays with the probability of its fitted rate, by a seeded hash of its text; over one, it stays once.
    """
    model = mixing.train(docs, mixing.by_quality(table(spark, sf_dir, "labels")))
    if DROPPED not in model.domains:
        return docs
    mixed = mixing.rated_rows(docs, model, mixing.without(model, DROPPED), "text", _fresh(docs, 1)[0])
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.col("text")), F.lit(1_000_000)) / 1_000_000
    return mixed.filter(chance < F.col(mixed.columns[-1])).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and the text decoded from them."""
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(WORD_BPE))
    return coded.withColumn("n_tokens", bpe.n_tokens(F.col("ids"))).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
