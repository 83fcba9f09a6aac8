"""Audit of a lexicon: word, normalized, line_num (and flags, morphology where used)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T

RARE = 5
PERCENTILES = [10, 25, 50, 75, 90, 99]
BUCKETS, PER_BUCKET, PER_CATEGORY = 10, 5, 10


def char_inventory(records: DataFrame) -> DataFrame:
    """char, then occurrences and entries that hold it, of the words and of the normalized forms."""
    side = lambda c: records.select("line_num", F.explode(F.split(c, "")).alias("char")).groupBy("char", "line_num").agg(F.count(F.lit(1)).alias("k")).groupBy("char").agg(F.sum("k").alias(f"{c}_occurrences"), F.count(F.lit(1)).alias(f"{c}_entries"))
    both = side("word").join(side("normalized"), "char", "full")
    return both.fillna(0).select("char", T.code_point(F.col("char")).alias("code_point"), "word_occurrences", "word_entries", "normalized_occurrences", "normalized_entries")


def rare_letters(records: DataFrame) -> DataFrame:
    return char_inventory(records).filter((F.col("normalized_entries") > 0) & (F.col("normalized_entries") < RARE) & F.col("char").rlike(r"\p{L}")).select("char")


def shape_counts(records: DataFrame) -> DataFrame:
    flags = {k: c for k, c in T.shape(F.col("word"), F.col("normalized")).items() if not k.endswith("_length")}
    flags |= {"possible_proper_noun": T.proper_noun(F.col("word")), "total": F.lit(True)}
    counts = records.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return counts.select(F.expr(f"stack({len(flags)}, {', '.join(f"'{k}', {k}" for k in flags)}) as (shape, entries)"))


def script_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(T.script_class(F.col("normalized")).alias("script")).agg(F.count(F.lit(1)).alias("entries"))


def length_percentiles(records: DataFrame) -> DataFrame:
    """Exact percentiles of scalar and grapheme lengths: the element at min(floor(p n / 100), n - 1) of the sorted lengths."""
    out = None
    for name, length in (("scalar", F.char_length("normalized").cast("long")), ("grapheme", T.graphemes(F.col("normalized")))):
        counts = records.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
        everything = W.partitionBy(F.lit(0))  # as many rows as there are lengths
        run = counts.withColumns({"upto": F.sum("n").over(everything.orderBy("length").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(everything)})
        run = run.withColumn("percent", F.explode(F.array(*map(F.lit, PERCENTILES))))
        place = F.least(F.floor(F.col("percent") * F.col("total") / 100), F.col("total") - 1)
        found = run.filter(F.col("upto") > place).groupBy("percent").agg(F.min("length").alias("length")).select(F.lit(name).alias("measure"), "percent", "length")
        out = found if out is None else out.unionByName(found)
    return out


def length_histogram(records: DataFrame) -> DataFrame:
    """Entries of each length, by measure."""
    out = None
    for name, length in (("scalar", F.char_length("normalized").cast("long")), ("grapheme", T.graphemes(F.col("normalized")))):
        counts = records.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("measure"), "length", "entries")
        out = counts if out is None else out.unionByName(counts)
    return out


def length_summary(records: DataFrame) -> DataFrame:
    """By measure: least and largest length, and the mean as a fraction and with four digits."""
    h = length_histogram(records).groupBy("measure")
    return h.agg(F.min("length").alias("least"), F.max("length").alias("largest"), F.sum(F.col("length") * F.col("entries")).alias("mean_numerator"), F.sum("entries").alias("mean_denominator")).withColumn("mean", F.round(F.col("mean_numerator") / F.col("mean_denominator"), 4))


def exact_duplicates(parsed: DataFrame) -> DataFrame:
    """Normalized forms of several lines that are all alike, with their lines."""
    fields = F.struct("word", "flags", "morphology", "part_of_speech")
    groups = parsed.groupBy("normalized").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fields).alias("kinds"), F.min_by(fields, "line_num").alias("e"), F.array_sort(F.collect_list("line_num")).alias("lines"))
    return groups.filter("n > 1 and kinds = 1").select("normalized", "e.word", "e.flags", "e.part_of_speech", F.col("n").alias("occurrences"), "lines")


def rejections(parsed: DataFrame) -> DataFrame:
    return parsed.filter("event = 'Rejected'").groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def cross_check(parsed: DataFrame) -> DataFrame:
    """One row: further lines that repeat or contradict the first of their form, forms with a contradiction, their lines, and different forms."""
    from textlex.operators.lexicon import import_outcomes

    forms = import_outcomes(parsed).groupBy("normalized").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("exact_duplicate", "metadata_conflict")], F.count(F.lit(1)).alias("n"))
    conflict = F.col("metadata_conflict") > 0
    return forms.agg(
        F.sum("exact_duplicate").alias("exact_duplicates"), F.sum("metadata_conflict").alias("conflicting"), F.count_if(conflict).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(conflict, F.col("n") - F.col("exact_duplicate"))), F.lit(0)).alias("conflict_members"), F.count(F.lit(1)).alias("unique_forms"),
    )


def suspicious(records: DataFrame) -> DataFrame:
    """A row for each rule that an entry meets."""
    s = T.shape(F.col("word"), F.col("normalized"))
    script = T.script_class(F.col("normalized"))
    mixed = script.isin("LATIN_ARABIC_MIXED", "LATIN_CYRILLIC_MIXED", "OTHER_MIXED_SCRIPT")
    hit = lambda test, category, code: F.when(test, F.struct(category.alias("category"), F.lit(code).alias("reason_code")))
    letters = F.array_distinct(F.split("normalized", ""))
    rare = records.select("line_num", F.explode(letters).alias("char")).join(rare_letters(records), "char").select("line_num").distinct().withColumn("rare", F.lit(True))
    rules = F.array(
        hit(s["punctuation_only"], F.lit("PUNCTUATION_ONLY"), "PUNCTUATION_ONLY_ACCEPTED"),
        hit(s["symbol_only"], F.lit("SYMBOL_ONLY"), "SYMBOL_ONLY_ACCEPTED"),
        hit(s["digit_only"], F.lit("DIGIT_ONLY"), "DIGIT_ONLY_ACCEPTED"),
        hit(s["no_letters"] & ~s["punctuation_only"] & ~s["symbol_only"] & ~s["digit_only"], F.lit("NO_LETTERS"), "NO_LETTERS_ACCEPTED"),
        hit(mixed, script, "MIXED_SCRIPT_ACCEPTED"),
        hit(s["very_long_25"], F.lit("VERY_LONG"), "VERY_LONG_ENTRY"),
        hit(F.col("rare"), F.lit("RARE_CODEPOINT"), "RARE_LETTER_CODEPOINT"),
    )
    return records.join(rare, "line_num", "left").select("normalized", "word", "line_num", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.category", "r.reason_code", "normalized", "word", "line_num")


def stride_sample(records: DataFrame) -> DataFrame:
    """Five evenly spaced entries from each tenth in the order of (normalized, line_num)."""
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.floor(n / BUCKETS))
    stride = F.greatest(F.lit(1), F.floor(size / PER_BUCKET))
    from textlex.operators.ordering import with_position

    at = with_position(records, ["normalized", "line_num"]).withColumn("bucket", F.floor(F.col("position") / size))
    inside = F.col("position") - F.col("bucket") * size
    return at.filter((F.col("bucket") < BUCKETS) & (inside % stride == 0) & (inside / stride < PER_BUCKET)).select("normalized", "line_num", "bucket")


def category_samples(records: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """The ten shortest and longest entries, and the first ten possible proper nouns, mixed scripts, entries with rare letters and those of a seed."""
    length = T.graphemes(F.col("normalized"))
    pick = lambda name, rows, *order: rows.orderBy(*order, "normalized", "line_num").limit(PER_CATEGORY).select("normalized", "line_num", F.lit(name).alias("category"))
    out = pick("shortest", records, length)
    out = out.unionByName(pick("longest", records, F.desc(length)))
    out = out.unionByName(pick("proper_noun", records.filter(T.proper_noun(F.col("word")))))
    out = out.unionByName(pick("mixed_script", records.filter(T.script_class(F.col("normalized")).rlike("MIXED"))))
    rare = F.broadcast(rare_letters(records))  # letters
    has = records.select("normalized", "line_num", F.explode(F.array_distinct(F.split("normalized", ""))).alias("char")).join(rare, "char").select("normalized", "line_num").distinct()
    out = out.unionByName(pick("rare_character", has))
    if seed is not None:
        out = out.unionByName(pick("seed_overlap", records.join(seed.select("normalized").distinct(), "normalized", "left_semi")))
    return out.groupBy("normalized", "line_num").agg(F.concat_ws(",", F.array_sort(F.collect_list("category"))).alias("categories"))


def suspicious_order() -> list:
    """Sort keys of suspicious entries."""
    return [F.col(c) for c in ("category", "normalized", "line_num")]


def roll_up(records: DataFrame, parsed: DataFrame, seed: DataFrame, items: DataFrame) -> DataFrame:
    """The audit's summary: one row of structs."""
    from textlex.operators.evaluate import benchmark_audit

    imported = parsed.filter("event = 'Parsed'")
    findings, reasons, scripts = raw_line_findings(parsed.select("line")), rejections(parsed), script_counts(records)
    chars = char_inventory(records).filter("normalized_entries > 0")
    shapes = shape_counts(records).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "entries")))).alias("shapes"))
    lengths = length_summary(records).filter("measure = 'scalar'")
    pairs = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m")).scalar()
    one = lambda df: df.select(F.struct(*df.columns).alias("s")).scalar()
    return records.agg(F.count(F.lit(1)).alias("records")).select(
        "records",
        one(cross_check(parsed)).alias("cross_check"),
        one(findings).alias("raw_lines"),
        pairs(scripts, "script", "entries").alias("scripts"),
        chars.agg(F.struct(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("normalized_entries") < RARE).alias("rare")).alias("s")).scalar().alias("characters"),
        one(lengths.drop("measure")).alias("lengths"),
        shapes.scalar().alias("shapes"),
        imported.agg(F.struct(F.count_if(F.col("flags") != "").alias("with_flags"), F.countDistinct(F.when(F.col("flags") != "", F.col("flags"))).alias("distinct_flags")).alias("s")).scalar().alias("flags"),
        pairs(reasons, "reason", "lines").alias("rejections"),
        one(overlap(seed, imported)).alias("seed"),
        one(benchmark_audit(items, imported, seed)).alias("benchmark"),
        suspicious(records).agg(F.count(F.lit(1)).alias("n")).scalar().alias("suspicious"),
    )


def overlap(seed: DataFrame, imported: DataFrame) -> DataFrame:
    """Sizes of the two sets of normalized forms, their intersection and differences."""
    both = seed.select("normalized", F.lit(1).alias("s")).distinct().join(imported.select("normalized", F.lit(1).alias("i")).distinct(), "normalized", "full")
    return both.agg(F.count("s").alias("seed"), F.count("i").alias("imported"), F.count_if(F.col("s").isNotNull() & F.col("i").isNotNull()).alias("both"), F.count_if(F.col("i").isNull()).alias("seed_only"), F.count_if(F.col("s").isNull()).alias("imported_only"))


def raw_line_findings(lines: DataFrame) -> DataFrame:
    flags = T.raw_line_flags(F.col("line"))
    any_flag = F.lit(False)
    for c in flags.values():
        any_flag = any_flag | c
    return lines.agg(*[F.count_if(c).alias(k) for k, c in flags.items()], F.count_if(any_flag).alias("lines"))


def flag_frequency(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("flags").agg(F.count(F.lit(1)).alias("entries"))


def morphology_frequency(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("morphology").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("entries"))


def pos_frequency(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("part_of_speech").agg(F.count(F.lit(1)).alias("entries"))
