"""Next-word prediction with hard backoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlex.operators import ngrams
from textlex.operators.ngrams import top_per_context

FOUND = ["rank", "next", "count", "probability_millionths"]


def by_bigram(contexts: DataFrame, bigrams: DataFrame, limit: int = 5) -> DataFrame:
    """contexts: previous -> previous, rank, next, count, probability_millionths."""
    top = top_per_context(bigrams, 2).filter(F.col("rank") <= limit)
    return contexts.select("previous").distinct().join(top, "previous").select("previous", *FOUND)


def with_backoff(contexts: DataFrame, bigrams: DataFrame, trigrams: DataFrame, limit: int = 5) -> DataFrame:
    """contexts: previous_2, previous_1. A trigram context that exists is used, else the bigrams of previous_1. Each model is read once."""
    keys = ["previous_2", "previous_1"]
    asked = contexts.select(*keys).distinct()
    best = lambda grams, n, to: top_per_context(grams, n).filter(F.col("rank") <= limit).groupBy(*to).agg(F.array_sort(F.collect_list(F.struct(*FOUND))).alias(f"best{n}"))
    both = asked.join(best(trigrams, 3, keys), keys, "left")
    both = both.join(best(bigrams, 2, ["previous"]).withColumnRenamed("previous", "previous_1"), "previous_1", "left")
    source = F.when(F.col("best3").isNotNull(), "trigram").otherwise("bigram-backoff").alias("prediction_source")
    rows = both.select(*keys, source, F.explode(F.coalesce("best3", "best2")).alias("p"))
    return rows.select(*keys, *[F.col(f"p.{c}") for c in FOUND], "prediction_source")


def backoff_of(contexts: DataFrame, docs: DataFrame, limit: int = 5) -> DataFrame:
    """As `with_backoff`, from documents: only the runs of contexts that are asked for are counted."""
    pairs = contexts.select("previous_2", "previous_1").distinct()
    bigrams = ngrams.model(docs, 2, contexts=pairs.select(F.col("previous_1").alias("previous")))
    return with_backoff(pairs, bigrams, ngrams.model(docs, 3, contexts=pairs), limit)


def predict_next(contexts: DataFrame, bigrams: DataFrame, trigrams: DataFrame, limit: int = 5) -> DataFrame:
    """contexts: context (array of words), of any length -> context, rank, next, count, probability_millionths, prediction_source.

    No words: no predictions. One: its bigrams. More: the last two, with backoff.
    """
    n = F.size("context")
    one = contexts.filter(n == 1).select("context", F.element_at("context", 1).alias("previous")).distinct()
    two = contexts.filter(n >= 2).select("context", F.element_at("context", -2).alias("previous_2"), F.element_at("context", -1).alias("previous_1")).distinct()
    of_one = one.join(by_bigram(one, bigrams, limit), "previous").select("context", *FOUND, F.lit("bigram").alias("prediction_source"))
    of_two = two.join(with_backoff(two, bigrams, trigrams, limit), ["previous_2", "previous_1"]).select("context", *FOUND, "prediction_source")
    return of_one.unionByName(of_two)
