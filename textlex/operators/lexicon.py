"""Lexicon operators: validation, merging, frequencies, and import of dictionary lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T

FORBIDDEN = r"[<>]|^https?://"


def entry_problem() -> Column:
    """Why an entry (word, normalized, status) isn't valid, or null."""
    blank = lambda c: T.trim_space(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(blank("word"), "EMPTY_WORD")
        .when(blank("normalized"), "EMPTY_NORMALIZED")
        .when(blank("status"), "EMPTY_STATUS")
        .when(~F.char_length("normalized").between(1, 64), "INVALID_LENGTH")
        .when(F.col("word").rlike(FORBIDDEN), "FORBIDDEN_CHARACTERS")
        .when(F.col("normalized").rlike(r"[^\p{IsAlphabetic}'’\- ]"), "INVALID_CHARACTER")
    )


def merge(entries: DataFrame, order: str = "ord") -> DataFrame:
    """One entry for each normalized form: largest frequency, all sources and variants, other fields of the first.

    The display is the first one's, unless it is capitalised and a later entry isn't and is no proper noun.
    """
    small = F.col("word").rlike(r"^\p{IsLowercase}") & (F.col("part_of_speech") != "proper_noun")
    rows = entries.groupBy("normalized").agg(
        F.min_by(F.struct("word", "lemma", "part_of_speech", "status"), order).alias("first"),
        F.min_by(F.when(small, F.col("word")), F.when(small, F.col(order))).alias("plain"),
        F.max("frequency").alias("frequency"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"),
    )
    capital = F.col("first.word").rlike(r"^\p{IsUppercase}")
    return rows.select(
        F.when(capital & F.col("plain").isNotNull(), F.col("plain")).otherwise(F.col("first.word")).alias("word"),
        "first.lemma",
        "normalized",
        "first.part_of_speech",
        "frequency",
        "first.status",
        "sources",
        "variants",
    )


def combined(seed: DataFrame, imported: DataFrame) -> DataFrame:
    """Seed and imported entries, merged; the seed's come first."""
    return merge(seed.withColumn("_side", F.lit(0)).unionByName(imported.withColumn("_side", F.lit(1))).withColumn("ord", F.struct("_side", "ord")).drop("_side"))


def ordered(entries: DataFrame) -> DataFrame:
    """Frequency descending, then normalized form."""
    return entries.orderBy(F.desc("frequency"), "normalized")


def with_frequency(lexicon: DataFrame, freq: DataFrame) -> DataFrame:
    counts = freq.select(F.col("word").alias("normalized"), "token_count", "document_count", F.round(F.col("zipf") * 1000).cast("long").alias("zipf_milli"))
    return lexicon.join(counts, "normalized", "left").fillna(0, ["token_count", "document_count", "zipf_milli"])


def frequency_coverage(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("token_count") > 0).alias("matched"), F.count_if(F.col("token_count") == 0).alias("unmatched"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """line_num, line -> event, declared, word, normalized, flags, morphology, part_of_speech, reason. A first line of digits declares the count."""
    line = T.trim_space(F.col("line"))
    pieces = F.split(line, rf"[{T.WHITE_SPACE}]+")
    head = pieces[0]
    body = F.regexp_extract(head, r"^((?:\\/|[^/])*)", 1)
    out = lines.select("line_num", "line", line.alias("_t"), F.regexp_replace(body, r"\\/", "/").alias("word"), F.substring(head, F.char_length(body) + 2, F.lit(1 << 20)).alias("flags"), F.slice(pieces, 2, 1 << 20).alias("morphology"))
    out = out.withColumn("normalized", T.normalize_text(F.col("word")))
    declared = (F.col("line_num") == 1) & F.col("_t").rlike(r"^[0-9]+$")
    reason = (
        F.when(F.col("_t") == "", "EMPTY_LINE")
        .when(T.trim_space(F.col("word")) == "", "EMPTY_WORD")
        .when(F.col("word").rlike(FORBIDDEN), "FORBIDDEN_CHARACTERS")
        .when(~F.char_length("normalized").between(1, 64), "INVALID_LENGTH")
    )
    out = out.withColumn("reason", F.when(~declared & (F.col("_t") != ""), reason))
    event = F.when(declared, "DeclaredCount").when(F.col("_t") == "", "Blank").when(F.col("reason").isNotNull(), "Rejected").otherwise("Parsed")
    return out.select("line_num", "line", event.alias("event"), F.when(declared, F.col("_t").cast("long")).alias("declared"), "word", "normalized", "flags", "morphology", T.map_part_of_speech(F.col("morphology")).alias("part_of_speech"), "reason")


def import_outcomes(parsed: DataFrame) -> DataFrame:
    """Parsed lines with the first of their normalized form and what they are against it."""
    first = W.partitionBy("normalized").orderBy("line_num").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fields = F.struct("word", "flags", "morphology", "part_of_speech")
    rows = parsed.filter("event = 'Parsed'").withColumns({"_own": fields, "first_line": F.first("line_num").over(first), "_first": F.first(fields).over(first)})
    outcome = F.when(F.col("line_num") == F.col("first_line"), "accepted").when(F.col("_own") == F.col("_first"), "exact_duplicate").otherwise("metadata_conflict")
    return rows.withColumns({"outcome": outcome, "first_word": F.col("_first.word"), "first_flags": F.col("_first.flags")}).drop("_own", "_first")


def import_summary(parsed: DataFrame) -> DataFrame:
    outcomes = import_outcomes(parsed).groupBy().agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "exact_duplicate", "metadata_conflict")])
    events = parsed.agg(F.max("declared").alias("declared"), F.count_if(F.col("event") == "Blank").alias("blank"), F.count_if(F.col("event") == "Rejected").alias("rejected"))
    return events.select("*", *[outcomes.select(c).scalar().alias(c) for c in outcomes.columns])
