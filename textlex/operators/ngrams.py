"""Bigram and trigram models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T
from textlex.operators import runs

TOP = {2: 16, 3: 12}
CONTEXT = {2: ["previous"], 3: ["previous_2", "previous_1"]}


def windows(docs: DataFrame, n: int) -> DataFrame:
    """All runs of n words inside a sentence: the context's columns and `next`, one row each; no shuffle."""
    words = docs.select(F.explode(T.sentences(F.col("text"))).alias("s")).select(T.tokens(F.col("s")).alias("w"))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(*[F.element_at("w", i + k).alias(c) for k, c in enumerate([*CONTEXT[n], "next"])]))
    return words.filter(F.size("w") >= n).select(F.explode(each).alias("r")).select("r.*")


def raw_counts(docs: DataFrame, n: int, contexts: DataFrame | None = None) -> DataFrame:
    """Counts of each run, before pruning; of given contexts only."""
    if contexts is None:
        return runs.counts(docs, [*CONTEXT[n], "next"]).drop("bucket")
    asked = windows(docs, n).join(contexts.select(*CONTEXT[n]).distinct(), CONTEXT[n], "left_semi")
    return asked.groupBy(*CONTEXT[n], "next").agg(F.count(F.lit(1)).alias("count"))


def model(docs: DataFrame, n: int, least: int = 2, contexts: DataFrame | None = None) -> DataFrame:
    """Runs that occur `least` times, with the count of their context and the probability in millionths.

    The runs are shuffled once, packed and by context; a hash comes first in the sort that sums contexts, as it is cheap to compare.
    Of given contexts, the sums come from partial sums of each task and are joined.
    """
    if contexts is None:
        whole = W.partitionBy("hash", "bucket", *CONTEXT[n])
        counts = runs.counts(docs, [*CONTEXT[n], "next"]).withColumn("hash", F.xxhash64(*CONTEXT[n]))
        kept = counts.withColumn("context_count", F.sum("count").over(whole)).filter(F.col("count") >= least).drop("hash", "bucket")
    else:
        counts = raw_counts(docs, n, contexts)
        sums = counts.groupBy(*CONTEXT[n]).agg(F.sum("count").alias("context_count"))
        kept = counts.filter(F.col("count") >= least).join(sums, CONTEXT[n])
    probability = F.expr("cast((count * 1000000 + context_count div 2) div context_count as bigint)")
    return kept.withColumn("probability_millionths", probability)


def top_per_context(grams: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    order = W.partitionBy(*CONTEXT[n]).orderBy(F.desc("probability_millionths"), F.desc("count"), "next")
    return grams.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= (limit or TOP[n]))


def most_frequent(grams: DataFrame, n: int, limit: int = 50) -> DataFrame:
    return grams.orderBy(F.desc("count"), *CONTEXT[n], "next").limit(limit)


def context_distribution(grams: DataFrame, n: int) -> DataFrame:
    per = grams.groupBy(*CONTEXT[n]).agg(F.count(F.lit(1)).alias("predictions"))
    return per.groupBy("predictions").agg(F.count(F.lit(1)).alias("contexts"))


def summary(docs: DataFrame, n: int, least: int = 2) -> DataFrame:
    """One row: sentences, windows, different runs before and after pruning, contexts, and runs over the limit of a context."""
    raw = raw_counts(docs, n)
    over = top_per_context(model(docs, n, least), n, 1 << 30).agg(F.count_if(F.col("rank") > TOP[n]).alias("capacity_pruned"))
    sums = raw.agg(
        F.sum("count").alias("windows"),
        F.count(F.lit(1)).alias("raw_distinct"),
        F.count_if(F.col("count") >= least).alias("pruned_distinct"),
        F.count_if(F.col("count") < least).alias("count_pruned"),
    )
    contexts = raw.filter(F.col("count") >= least).select(*CONTEXT[n]).distinct().agg(F.count(F.lit(1)).alias("contexts"))
    sentences = docs.agg(F.coalesce(F.sum(F.size(T.sentences(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("sentences"))
    return sums.select("*", contexts.scalar().alias("contexts"), over.scalar().alias("capacity_pruned"), sentences.scalar().alias("sentences"))


def eligibility(grams: DataFrame, lexicon: DataFrame, n: int) -> DataFrame:
    """Runs with a flag for each word outside the lexicon (word), and whether all are inside."""
    known = lexicon.select("word").distinct()
    out, flags = grams, []
    for c in [*CONTEXT[n], "next"]:
        out = out.join(known.select(F.col("word").alias(c), F.lit(False).alias(f"oov_{c}")), c, "left").withColumn(f"oov_{c}", F.coalesce(f"oov_{c}", F.lit(True)))
        flags.append(F.col(f"oov_{c}"))
    bad = flags[0]
    for f in flags[1:]:
        bad = bad | f
    return out.withColumn("eligible", ~bad)


def oov_summary(grams: DataFrame, lexicon: DataFrame, n: int) -> DataFrame:
    out = eligibility(grams, lexicon, n)
    return out.agg(*[F.count_if(F.col(f"oov_{c}")).alias(f"oov_{c}") for c in [*CONTEXT[n], "next"]], F.count_if(F.col("eligible")).alias("eligible"), F.count(F.lit(1)).alias("runs"))


def violations(grams: DataFrame, n: int) -> DataFrame:
    """Rows that break a rule of the model; there are none."""
    count, context, p = F.col("count"), F.col("context_count"), F.col("probability_millionths")
    run = [*CONTEXT[n], "next"]
    again = F.count(F.lit(1)).over(W.partitionBy(F.xxhash64(*run), *run))  # sorted by the hash first, which is cheap to compare
    return grams.withColumn("again", again).filter((count <= 0) | (context <= 0) | (p <= 0) | (p > 1_000_000) | (count > context) | (F.col("again") > 1)).drop("again")
