"""Word frequencies and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T

MILESTONES = [50, 80, 90, 95, 99]


def zipf(count: Column, total: Column) -> Column:
    return F.round(F.log10(count / total * 1e9) * 100) / 100


def word_frequencies(docs: DataFrame, doc: str = "document_id") -> DataFrame:
    """word, token_count, document_count, normalized_frequency, zipf.

    Counted by word and document first, so that the shuffle carries each task's different words once for each
    document, and the document count needs no distinct.
    """
    words = docs.select(F.col(doc).alias("d"), F.explode(T.tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word", "d").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("token_count"), F.count(F.lit(1)).alias("document_count"))
    total = counts.agg(F.sum("token_count").alias("total"))
    share = F.col("token_count") / total.scalar()
    return counts.select("word", "token_count", "document_count", F.round(share, 12).alias("normalized_frequency"), zipf(F.col("token_count"), total.scalar()).alias("zipf"))


def ranked(freq: DataFrame, n: int | None = None) -> DataFrame:
    out = freq.orderBy(F.desc("token_count"), "word")
    return out.limit(n) if n else out


def summary(freq: DataFrame) -> DataFrame:
    return freq.agg(
        F.count(F.lit(1)).alias("vocabulary"),
        F.count_if(F.col("token_count") == 1).alias("hapax"),
        F.max("token_count").alias("largest"),
        F.round(F.avg("token_count"), 4).alias("mean"),
        F.percentile("token_count", F.lit(0.5)).alias("median"),
    )


def zipf_buckets(freq: DataFrame) -> DataFrame:
    return freq.groupBy(F.floor("zipf").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("words"))


def length_distribution(freq: DataFrame) -> DataFrame:
    """Tokens by word length, with the token-weighted mean and lower median."""
    lengths = freq.groupBy(F.char_length("word").cast("long").alias("length")).agg(F.sum("token_count").alias("tokens"))
    whole = W.partitionBy(F.lit(0))  # as many rows as there are lengths
    up_to = whole.orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    out = lengths.withColumns({"total": F.sum("tokens").over(whole), "mass": F.sum(F.col("tokens") * F.col("length")).over(whole), "upto": F.sum("tokens").over(up_to)})
    median = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("length"))).over(whole)
    return out.select("length", "tokens", F.round(F.col("mass") / F.col("total"), 4).alias("mean"), median.alias("median"))


def char_analysis(freq: DataFrame) -> DataFrame:
    chars = freq.select("word", "token_count", F.explode(F.split("word", "")).alias("char")).groupBy("char", "word").agg(F.first("token_count").alias("t"), F.count(F.lit(1)).alias("k"))
    out = chars.groupBy("char").agg(F.sum(F.col("t") * F.col("k")).alias("occurrences"), F.count(F.lit(1)).alias("words"))
    return out.select("char", T.code_point(F.col("char")).alias("code_point"), "occurrences", "words")


def coverage_milestones(freq: DataFrame) -> DataFrame:
    """The least rank whose words up to there reach each share of all tokens.

    Words of equal count are counted as a class, so the running sum is over different counts, not words.
    """
    classes = freq.groupBy("token_count").agg(F.count(F.lit(1)).alias("words"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("token_count")).rowsBetween(W.unboundedPreceding, 0)
    run = classes.withColumns({"mass": F.sum(F.col("words") * F.col("token_count")).over(order), "rank": F.sum("words").over(order)})
    run = run.withColumn("total", F.max("mass").over(W.partitionBy(F.lit(0))))
    run = run.withColumn("percent", F.explode(F.array(*map(F.lit, MILESTONES))))
    need = F.col("total") * F.col("percent") - (F.col("mass") - F.col("words") * F.col("token_count")) * 100
    inside = F.col("rank") - F.col("words") + F.greatest(F.lit(1), F.ceil(need / (F.col("token_count") * 100)))
    return run.filter(F.col("mass") * 100 >= F.col("total") * F.col("percent")).groupBy("percent").agg(F.min(inside).cast("long").alias("rank"))
