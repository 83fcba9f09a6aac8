"""Lexical queries as batch joins: many inputs against a lexicon, ranked by window.

inputs: query. lexicon: word, normalized (unique), token_count, document_count, zipf_milli.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T
from textlex.functions.distance import distance_quarters, edit_cost

#: Kinds in order of priority, and their bonus in the score.
KINDS = {"Exact": 0.50, "DiacriticCorrection": 0.40, "Completion": 0.30, "Correction": 0.10, "NextWord": 0.20}
MAX_QUARTERS, LENGTH_BAND, EXACT_QUALITY, SCORE_FREQUENCY = 8, 2, 100, 1000
#: Words of up to LONG letters are compared by their deletions; longer ones by SEGMENTS parts, as an edit touches two parts at most.
LONG, SEGMENTS = 16, 5


def clamp_limit(limit: int | None = None) -> int:
    return max(0, min(5 if limit is None else limit, 50))


def prepared(inputs: DataFrame) -> DataFrame:
    q = inputs.select("query").distinct().select("query", T.normalize(F.col("query")).alias("q")).filter("q <> ''")
    return q.withColumn("q_plain", F.translate("q", T.MARKED, T.PLAIN))


def known_words(inputs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each different query with whether its normal form is in the lexicon."""
    found = lexicon.select(F.col("normalized").alias("q"), F.lit(True).alias("known")).distinct()
    return prepared(inputs).join(found, "q", "left").select("query", F.coalesce("known", F.lit(False)).alias("known"))


def prefix_matches(q: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries that begin with q: an equi-join on the beginnings of the entries that some query has the length of."""
    lengths = q.select(F.char_length("q").alias("n")).distinct()  # as many as there are lengths
    starts = lexicon.withColumn("n", F.explode(F.sequence(F.lit(1), F.char_length("normalized")))).join(F.broadcast(lengths), "n")
    return q.join(starts.withColumn("q", F.substring(F.col("normalized"), F.lit(1), F.col("n"))).drop("n"), "q")


def diacritic_matches(q: DataFrame, lexicon: DataFrame) -> DataFrame:
    plain = lexicon.withColumn("q_plain", F.translate("normalized", T.MARKED, T.PLAIN))
    return q.join(plain, "q_plain").filter("normalized <> q")


def _without_one(words: Column) -> Column:
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1 << 20))))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def deletions(word: Column) -> Column:
    """The word and all forms with one or two letters less: two words within two edits share one."""
    one = _without_one(F.array(word))
    return F.array_distinct(F.concat(F.array(word), one, _without_one(one)))


def _segments(word: Column, length: Column) -> Column:
    """(k, first place, size) of the SEGMENTS parts of a word of that length."""
    cut = lambda k: F.floor(length * k / SEGMENTS).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("k"), (cut(k) + 1).alias("at"), (cut(k + 1) - cut(k)).alias("size")) for k in range(SEGMENTS)])


def _segment_key(length: Column, part: Column, text: Column) -> Column:
    return F.concat_ws("/", length.cast("string"), part.getField("k").cast("string"), F.sha2(text, 256))


def entry_keys(word: Column) -> Column:
    """Deletions of a short word; the parts of a long one, of which two edits leave one as it is."""
    n = F.char_length(word)
    parts = F.transform(_segments(word, n), lambda s: _segment_key(n, s, F.substring(word, s.getField("at"), s.getField("size"))))
    return F.when(n <= LONG, deletions(F.when(n <= LONG, word))).otherwise(parts)


def query_keys(word: Column) -> Column:
    """All keys that an entry within two edits may have: as many as a long word's, whatever its length."""
    n = F.char_length(word)
    shifts = F.array(*[F.lit(k) for k in range(-LENGTH_BAND, LENGTH_BAND + 1)])

    def of(length):
        at = lambda s, shift: s.getField("at") + shift
        each = lambda s: F.transform(shifts, lambda shift: F.when(at(s, shift) >= 1, _segment_key(length, s, F.substring(word, at(s, shift), s.getField("size")))))
        return F.flatten(F.transform(_segments(word, length), each))

    long = F.flatten(F.transform(F.filter(F.transform(shifts, lambda d: n + d), lambda m: m > LONG), of))
    none = F.array().cast("array<string>")
    short = F.when(n <= LONG + LENGTH_BAND, deletions(F.when(n <= LONG + LENGTH_BAND, word))).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(short, F.when(n > LONG - LENGTH_BAND, long).otherwise(none))))


def edit_matches(q: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries within a weighted distance of 2, with `quarters`; no diacritic matches of other words."""
    plain = F.translate("normalized", T.MARKED, T.PLAIN)
    left = q.withColumn("key", F.explode(query_keys(F.col("q_plain"))))
    right = lexicon.withColumn("key", F.explode(entry_keys(plain)))
    near = left.join(right, "key").drop("key").filter(F.abs(F.char_length("normalized") - F.char_length("q")) <= LENGTH_BAND)
    near = near.filter((plain != F.col("q_plain")) | (F.col("normalized") == F.col("q"))).dropDuplicates(["query", "normalized"])
    return near.withColumn("quarters", distance_quarters("q", "normalized")).filter(F.col("quarters") <= MAX_QUARTERS)


def candidates(inputs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One candidate for each query and entry: word, kind, edit_cost, diacritic, prefix_quality and the entry's counts."""
    q = prepared(inputs)
    exact = F.col("normalized") == F.col("q")
    quality = F.char_length("q").cast("long")
    same_plain = F.translate("normalized", T.MARKED, T.PLAIN) == F.col("q_plain")
    columns = lambda kind, cost, diacritic, prefix: {"kind": kind, "edit_cost": cost.cast("long"), "diacritic": diacritic, "prefix_quality": prefix.cast("long")}
    by_prefix = prefix_matches(q, lexicon).withColumns(
        columns(F.when(exact, "Exact").otherwise("Completion"), F.when(exact, 0).otherwise(1), same_plain, F.when(exact, EXACT_QUALITY).otherwise(quality))
    )
    restored = diacritic_matches(q, lexicon).withColumns(columns(F.lit("DiacriticCorrection"), F.lit(0), F.lit(True), F.lit(0)))
    begins = F.col("normalized").startswith(F.col("q"))
    edited = edit_matches(q, lexicon).withColumns(
        columns(
            F.when(exact, "Exact").when(begins, "Completion").otherwise("Correction"),
            F.when(exact, 0).otherwise(edit_cost(F.col("quarters"))),
            same_plain,
            F.when(begins, quality).otherwise(0),
        )
    )
    names = ["query", "q", "q_plain", "word", "normalized", "token_count", "document_count", "zipf_milli", "kind", "edit_cost", "diacritic", "prefix_quality"]
    # a restored diacritic overwrites; an edit replaces only what ranks after it, and a completion by prefix never does
    both = by_prefix.select(*names, F.lit(1).alias("step")).unionByName(restored.select(*names, F.lit(0).alias("step"))).unionByName(edited.select(*names, F.lit(2).alias("step")))
    order = W.partitionBy("query", "normalized").orderBy(F.when(F.col("step") == 0, 0).otherwise(1), *rank_keys(), "step")
    return both.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k", "step")


def rank_keys(use_frequency: bool = True) -> list[Column]:
    """One list of sort keys for both branches of the ranking: completions by quality, others by cost."""
    completion = F.col("kind") == "Completion"
    kind = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        kind = F.when(F.col("kind") == name, k).otherwise(kind)
    zipf, docs = (F.desc("zipf_milli"), F.desc("document_count")) if use_frequency else (F.lit(0), F.lit(0))
    return [
        kind,
        F.when(completion, -F.col("prefix_quality")).otherwise(F.col("edit_cost")),
        F.when(~completion & F.col("diacritic"), 0).otherwise(1),
        zipf,
        docs,
        F.when(completion, F.char_length("word")).otherwise(0),
        F.col("word"),
    ]


def score() -> Column:
    bonus = F.lit(0.0)
    for name, value in KINDS.items():
        bonus = F.when(F.col("kind") == name, value).otherwise(bonus)
    frequency = F.log(F.col("token_count") + 1.0) / F.log(F.lit(SCORE_FREQUENCY + 1.0))
    alike = (F.translate(F.lower("word"), T.MARKED, T.PLAIN) == F.col("q_plain")) & (F.char_length("word") == F.char_length("q"))
    prefix = F.when((F.col("word").startswith(F.col("q")) | alike) & (F.octet_length("q") >= 2), 0.25).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), frequency * 0.35 + bonus + prefix - F.col("edit_cost") / 10 * 0.35)), 9)


#: The wordings of the reasons.
def reason(use_frequency: bool = True) -> Column:
    frequent = (F.col("zipf_milli") > 0) & F.lit(use_frequency)
    first = F.when(F.col("kind") == "Completion", F.concat(F.lit("prefix match quality "), F.col("prefix_quality"))).otherwise(F.concat(F.lit("lower edit cost (cost: "), F.col("edit_cost"), F.lit(")")))
    return F.concat(first, F.when(frequent, F.concat(F.lit(", then higher frequency (zipf_milli: "), F.col("zipf_milli"), F.lit(")"))).otherwise(", then lexical order"))


def suggest(inputs: DataFrame, lexicon: DataFrame, limit: int | None = None, use_frequency: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """query, rank, text, kind, score, edit_cost, zipf_milli, document_count, ranking_reason. `complete` and `correct` are the same."""
    found = candidates(inputs, lexicon)
    if kinds:
        found = found.filter(F.col("kind").isin(kinds))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*rank_keys(use_frequency))).cast("long")).filter(F.col("rank") <= clamp_limit(limit))
    return ranked.select("query", "rank", F.col("word").alias("text"), "kind", score().alias("score"), "edit_cost", "zipf_milli", "document_count", reason(use_frequency).alias("ranking_reason"))


complete = correct = suggest
