"""Evaluation of packs and models on benchmark cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import ids
from textlex.functions import text as T
from textlex.operators import search

LIMIT, SMALL_BENCHMARK = 10, 50
#: Categories that an evaluation of next words must have.
MANDATORY = ["trigram-hit", "trigram-preferred", "bigram-backoff", "unknown-context", "sentence-boundary", "document-boundary", "deterministic-tie"]
#: The categories that go with each task.
CATEGORIES = {
    "accept-word": ["correct-spelling", "exact-preservation", "proper-noun", "morphology", "regional-variant", "unknown-word", "false-acceptance"],
    "correct-word": ["missing-diacritics", "substitution", "insertion", "deletion", "transposition", "multi-edit", "common-vs-rare", "no-candidate"],
    "complete-prefix": ["prefix-completion"],
}


def compatible(task: Column, category: Column) -> Column:
    out = F.lit(False)
    for t, names in CATEGORIES.items():
        out = out | ((task == t) & category.isin(names))
    return out


def case_problem() -> Column:
    """Why a case isn't valid, or null. Columns as in `ranked_results`, with review_status, reviewer_id, review_date."""
    draft = F.col("review_status") == "draft"
    return (
        F.when(F.coalesce(F.col("input"), F.lit("")) == "", "EMPTY_INPUT")
        .when(F.col("input").rlike(r"\p{Cc}"), "CONTROL_CHARACTER")
        .when(F.col("input") != T.nfc(F.col("input")), "NOT_COMPOSED")
        .when(~compatible(F.col("task"), F.col("category")), "TASK_CATEGORY")
        .when(F.arrays_overlap("expected", "forbidden"), "EXPECTED_AND_FORBIDDEN")
        .when(F.size(F.array_distinct("expected")) < F.size("expected"), "DUPLICATE_CANDIDATE")
        .when((F.col("task") == "accept-word") & F.col("accepted").isNull() & F.col("preserve_exact").isNull(), "NO_EXPECTATION")
        .when(draft & (F.col("reviewer_id").isNotNull() | F.col("review_date").isNotNull()), "DRAFT_WITH_REVIEW")
        .when(~draft & ~F.coalesce(ids.reviewer_ok(F.col("reviewer_id")), F.lit(False)), "REVIEWER")
        .when(~draft & ~F.coalesce(ids.strict_date_ok(F.col("review_date")), F.lit(False)), "REVIEW_DATE")
    )


def ranked_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases (case_id, task, expected, forbidden, top_k, ...) with each pack's results (case_id, pack, is_known, suggestions) scored."""
    place = lambda wanted: F.array_min(F.filter(F.transform(F.col(wanted), lambda w: F.array_position("suggestions", w)), lambda k: k > 0)).cast("long")
    out = cases.join(results, "case_id").withColumns({"expected_rank": place("expected"), "forbidden_rank": place("forbidden")})
    return out.withColumn("satisfied", F.coalesce(F.col("expected_rank") <= F.coalesce("top_k", F.lit(LIMIT)), F.lit(False)))


def metric(name: str, eligible: Column, matched: Column) -> Column:
    n, m = F.count_if(eligible), F.count_if(eligible & matched)
    return F.struct(F.lit(name).alias("metric"), n.alias("eligible"), m.alias("matched"), (F.count(F.lit(1)) - n).alias("excluded"), F.round(F.try_divide(m.cast("double"), n), 9).alias("value"))


def metrics(scored: DataFrame) -> DataFrame:
    """pack, metric, eligible, matched, excluded, value (null without eligible cases)."""
    correct = (F.col("task") == "correct-word") & (F.size("expected") > 0)
    rank = F.col("expected_rank")
    found = [
        metric("known_word_coverage", (F.col("task") == "accept-word") & F.coalesce(F.col("accepted"), F.lit(False)), F.col("is_known")),
        metric("false_acceptance", (F.col("task") == "accept-word") & ~F.coalesce(F.col("accepted"), F.lit(True)), F.col("is_known")),
        *[metric(f"correction_top_{k}", correct, F.coalesce(rank <= k, F.lit(False))) for k in (1, 3, 5)],
        metric("completion_recall", (F.col("task") == "complete-prefix") & (F.size("expected") > 0), rank.isNotNull()),
        metric("exact_preservation", F.coalesce(F.col("preserve_exact"), F.lit(False)), F.col("is_known")),
        metric("no_candidate", F.coalesce(F.col("allow_none"), F.lit(False)), F.size("suggestions") == 0),
    ]
    mrr = F.struct(
        F.lit("mrr").alias("metric"), F.count_if(correct).alias("eligible"), F.count_if(correct & rank.isNotNull()).alias("matched"), F.count_if(~correct).alias("excluded"),
        F.round(F.try_divide(F.sum(F.when(correct & rank.isNotNull(), 1 / rank).otherwise(0.0)), F.count_if(correct)), 9).alias("value"),
    )
    return scored.groupBy("pack").agg(F.array(*found, mrr).alias("m")).select("pack", F.explode("m").alias("m")).select("pack", "m.*")


def _change(better: Column, worse: Column, rest: Column) -> Column:
    return F.when(better, "improvement").when(worse, "regression").otherwise(rest)


def pairwise_class(b: str = "b", c: str = "c") -> Column:
    """How the candidate `c` changes the baseline `b`."""
    of = lambda side, name: F.col(f"{side}.{name}")
    same = F.lit("unchanged")
    known = (~of(b, "is_known") & of(c, "is_known"), of(b, "is_known") & ~of(c, "is_known"))
    accept = F.when(of(b, "preserve_exact") | of(b, "accepted"), _change(*known, same)).when(~of(b, "accepted"), _change(*known[::-1], same)).otherwise(same)
    ranks = _change(
        of(b, "expected_rank").isNull() & of(c, "expected_rank").isNotNull() | (of(c, "expected_rank") < of(b, "expected_rank")),
        of(b, "expected_rank").isNotNull() & of(c, "expected_rank").isNull() | (of(c, "expected_rank") > of(b, "expected_rank")),
        same,
    )
    expected = F.when(F.size(of(b, "expected")) == 0, same).otherwise(_change(~of(b, "satisfied") & of(c, "satisfied"), of(b, "satisfied") & ~of(c, "satisfied"), ranks))
    empty = lambda side: F.size(of(side, "suggestions")) == 0
    none = F.coalesce(of(b, "allow_none"), F.lit(False))
    candidates = F.when(none & ~empty(b) & empty(c), "improvement").when(none & empty(b) & ~empty(c), "regression").otherwise(expected)
    bf, cf = of(b, "forbidden_rank"), of(c, "forbidden_rank")
    forbidden = _change(bf.isNotNull() & cf.isNull() | (cf > bf), bf.isNull() & cf.isNotNull() | (cf < bf), candidates)
    return F.when(of(b, "task") == "accept-word", accept).otherwise(forbidden)


def pairwise(scored: DataFrame, baseline: str) -> DataFrame:
    """case_id, pack and class of each other pack against the baseline."""
    b, c = scored.filter(F.col("pack") == baseline).alias("b"), scored.filter(F.col("pack") != baseline).alias("c")
    return b.join(c, F.col("b.case_id") == F.col("c.case_id")).select("b.case_id", "c.pack", pairwise_class().alias("class"))


def transition(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, review_status, content) of two snapshots -> case_id, outcome."""
    b, c = base.alias("b"), candidate.alias("c")
    both = b.join(c, F.col("b.case_id") == F.col("c.case_id"), "full")
    was, now = F.col("b.review_status"), F.col("c.review_status")
    same = F.col("b.content").eqNullSafe(F.col("c.content"))
    outcome = (
        F.when((was == "human-reviewed") & now.isNull(), "reviewed_removed")
        .when((was == "human-reviewed") & (now == "draft"), "reviewed_downgraded")
        .when((was == "human-reviewed") & ~same, "reviewed_modified")
        .when((now == "human-reviewed") & was.isNull(), "reviewed_without_draft")
        .when((now == "human-reviewed") & (was == "draft") & ~same, "promoted_with_changes")
        .when((now == "human-reviewed") & (was == "draft"), "promoted")
        .when(was.isNull(), "draft_added")
        .when(now.isNull(), "draft_removed")
        .otherwise("kept")
    )
    return both.select(F.coalesce("b.case_id", "c.case_id").alias("case_id"), outcome.alias("outcome"))


def contradictions(cases: DataFrame) -> DataFrame:
    """Inputs of one task with several different expectations."""
    content = F.sha2(ids.expectation(F.struct("accepted", "preserve_exact", "expected", "forbidden", "allow_none", "top_k")), 256)
    found = cases.groupBy("task", "input").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct(content).alias("expectations"))
    return found.filter("cases > 1")


def duplicate_cases(cases: DataFrame) -> DataFrame:
    """Ids that occur several times, and cases of other ids that ask the same: kind, key, cases."""
    content = F.sha2(ids.expectation(F.struct("accepted", "preserve_exact", "expected", "forbidden", "allow_none", "top_k")), 256)
    twice = cases.groupBy(F.col("case_id").alias("key")).agg(F.count(F.lit(1)).alias("cases")).filter("cases > 1")
    same = cases.groupBy("task", "input", content.alias("c")).agg(F.countDistinct("case_id").alias("cases")).filter("cases > 1")
    return twice.select(F.lit("id").alias("kind"), "key", "cases").unionByName(same.select(F.lit("content").alias("kind"), F.concat_ws(":", "task", "input").alias("key"), "cases"))


def case_set(draft: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Drafts and reviewed cases together."""
    return draft.unionByName(reviewed)


def pack_results(cases: DataFrame, packs: dict[str, DataFrame], limit: int = LIMIT) -> DataFrame:
    """Each case asked of each pack (word, normalized and counts): case_id, pack, is_known, suggestions in their order."""
    asked = cases.select("case_id", F.col("input").alias("query"))
    out = None
    for name, lexicon in packs.items():
        ranked = search.suggest(asked, lexicon, limit).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).getField("text").alias("suggestions"))
        known = search.known_words(asked, lexicon)
        rows = asked.join(known, "query", "left").join(ranked, "query", "left")
        rows = rows.select("case_id", F.lit(name).alias("pack"), F.coalesce("known", F.lit(False)).alias("is_known"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
        out = rows if out is None else out.unionByName(rows)
    return out


def changed_cases(scored: DataFrame, baseline: str, wanted: str) -> DataFrame:
    """The cases of one class of `pairwise` (improvement, regression, unchanged) with the candidate's suggestions."""
    rows = pairwise(scored, baseline).filter(F.col("class") == wanted).select("case_id", "pack")
    return rows.join(scored.select("case_id", "pack", "input", "suggestions"), ["case_id", "pack"])


def false_acceptances(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("task") == "accept-word") & ~F.coalesce("accepted", F.lit(True)) & F.col("is_known")).select("case_id", "pack", "input")


def _place(wanted: str, found: str) -> Column:
    """The first place of `found` that is wanted, from 1, or null."""
    hits = F.transform(F.col(found), lambda w: F.array_contains(F.col(wanted), w))
    at = F.array_position(hits, True)
    return F.when(at > 0, at)


def _reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def _percent(test: Column, of: Column | None = None) -> Column:
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    hits = F.count_if(test if of is None else of & test)
    return F.round(F.coalesce(F.try_divide(hits * 100.0, n), F.lit(0.0)), 2)


def ranking_rows(cases: DataFrame, baseline: DataFrame, experiment: DataFrame) -> DataFrame:
    """cases: case_id, input, expected (array), category; both sides: case_id, suggestions. Ranks of both, and what changed."""
    side = lambda df, name: df.select("case_id", F.col("suggestions").alias(f"{name}_suggestions"))
    rows = cases.join(side(baseline, "b"), "case_id", "left").join(side(experiment, "e"), "case_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.slice(F.coalesce(c, none), 1, 5) for c in ("b_suggestions", "e_suggestions")})
    rows = rows.withColumns({"b_rank": _place("expected", "b_suggestions"), "e_rank": _place("expected", "e_suggestions")})
    gain = _reciprocal(F.col("e_rank")) - _reciprocal(F.col("b_rank"))
    return rows.withColumns({"change": F.when(gain > 0, "improved").when(gain < 0, "regressed").otherwise("unchanged"), "reordered": F.col("b_suggestions") != F.col("e_suggestions")})


def ranking_evaluation(cases: DataFrame, baseline: DataFrame, experiment: DataFrame) -> DataFrame:
    """One row: accuracy of both sides, changes, and whether the experiment may be accepted: no worse at the top, no case worse, exact words kept."""
    rows = ranking_rows(cases, baseline, experiment)
    top = lambda side, k: F.coalesce(F.col(f"{side}_rank") <= k, F.lit(False))
    exact = F.col("category") == "exact-word-preservation"
    first = F.coalesce(T.normalize(F.get("e_suggestions", 0)) == T.normalize(F.col("input")), F.lit(False))
    count = lambda name: F.count_if(F.col("change") == name)
    accepted = (F.count_if(top("e", 1)) >= F.count_if(top("b", 1))) & (F.count_if(top("e", 3)) >= F.count_if(top("b", 3))) & (count("regressed") == 0) & (F.count_if(exact & ~(top("e", 1) & first)) == 0)
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        *[_percent(top(side, k)).alias(f"{name}_top_{k}") for side, name in (("b", "baseline"), ("e", "experiment")) for k in (1, 3, 5)],
        *[F.round(F.avg(_reciprocal(F.col(f"{side}_rank"))), 4).alias(f"{name}_mrr") for side, name in (("b", "baseline"), ("e", "experiment"))],
        *[F.count_if(F.size(f"{side}_suggestions") == 0).alias(f"{name}_no_candidate") for side, name in (("b", "baseline"), ("e", "experiment"))],
        count("improved").alias("improved"), count("regressed").alias("regressed"), count("unchanged").alias("unchanged"), accepted.alias("accepted"),
    )


def evaluate_ranking(cases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Ranking with frequencies against ranking without them."""
    asked = cases.select("case_id", F.col("input").alias("query"))
    sides = []
    for use in (False, True):
        found = search.suggest(asked, lexicon, 5, use_frequency=use).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).getField("text").alias("suggestions"))
        sides.append(asked.join(found, "query").select("case_id", "suggestions"))
    return ranking_evaluation(cases, *sides)


def lexicon_impact(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row for items (input, expected): entries, known answers, answers first and among five suggestions, and among ten completions of their first three letters, in percent."""
    items = items.select(F.monotonically_increasing_id().alias("item"), "input", "expected")
    at = lambda query, k: search.suggest(items.select(query.alias("query")).distinct(), lexicon, k).groupBy(F.col("query")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).getField("text").alias("s"))
    found = at(F.col("input"), 5).select(F.col("query").alias("input"), F.col("s").alias("suggestions"))
    head = F.substring("expected", 1, 3)
    begun = at(head, 10).select(F.col("query").alias("head"), F.col("s").alias("completions"))
    known = search.known_words(items.select(F.col("expected").alias("query")), lexicon).select(F.col("query").alias("expected"), "known")
    rows = items.withColumn("head", head).join(found, "input", "left").join(begun, "head", "left").join(known, "expected", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    entries = lexicon.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("items"),
        _percent(yes(F.col("known"))).alias("known_percent"),
        _percent(yes(F.get("suggestions", 0) == F.col("expected"))).alias("top_1_percent"),
        _percent(yes(F.array_contains("suggestions", F.col("expected")))).alias("top_5_percent"),
        _percent(yes(F.array_contains("completions", F.col("expected")))).alias("completion_percent"),
    ).select(entries.alias("entries"), "*")


def benchmark_audit(items: DataFrame, imported: DataFrame, seed: DataFrame) -> DataFrame:
    """One row on a benchmark (input, expected): its size, how many answers are in the lists (normalized), and its weaknesses."""
    sizes = items.agg(F.count(F.lit(1)).alias("size"), F.countDistinct("input").alias("unique_inputs"), F.countDistinct("expected").alias("unique_expected"))
    answers = provenance(items.select("expected").distinct().select(T.normalize_text(F.col("expected")).alias("word")), imported=imported.select(F.col("normalized").alias("word")), seed=seed.select(F.col("normalized").alias("word")))
    held = answers.agg(F.count_if("in_imported").alias("expected_in_imported"), F.count_if("in_seed").alias("expected_in_seed"), F.count_if(~F.col("in_imported") & ~F.col("in_seed")).alias("expected_in_neither"))
    out = sizes.select("*", *[held.select(c).scalar().alias(c) for c in held.columns])
    weak = F.array_compact(F.array(F.when(F.col("size") < SMALL_BENCHMARK, "SMALL_SAMPLE"), F.when(F.col("expected_in_seed") == F.col("unique_expected"), "ALL_EXPECTED_IN_SEED"), F.when(F.col("unique_inputs") < F.col("size"), "DUPLICATE_INPUTS")))
    return out.withColumn("weaknesses", F.concat_ws(",", weak))


def out_of_order(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring predictions of a context that aren't in order: probability and count descending, then word. Columns: keys, rank, next, count, probability_millionths."""
    w = W.partitionBy(*keys).orderBy("rank")
    before = lambda c: F.lag(c).over(w)
    p, c, x = before("probability_millionths"), before("count"), before("next")
    wrong = (p < F.col("probability_millionths")) | ((p == F.col("probability_millionths")) & ((c < F.col("count")) | ((c == F.col("count")) & (x >= F.col("next")))))
    return predictions.withColumn("wrong", F.coalesce(wrong, F.lit(False))).filter("wrong").drop("wrong")


def next_word_evaluation(cases: DataFrame, predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: accuracy over all cases and over those with an answer, chosen sources, the bigram baseline, and the gates.

    cases: case_id, category, expected (array), forbidden (array), expected_source (or ''). predictions: case_id, source, rank,
    next, count, probability_millionths; a case without a row has none. baseline: case_id, words, from bigrams only.
    """
    best = predictions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "next"))).getField("next").alias("words"), F.max("source").alias("source"))
    wrong = out_of_order(predictions, ["case_id"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    none = F.array().cast("array<string>")
    rows = cases.join(best, "case_id", "left").join(baseline.select("case_id", F.col("words").alias("b_words")), "case_id", "left")
    rows = rows.withColumns({"words": F.slice(F.coalesce("words", none), 1, 5), "b_words": F.coalesce("b_words", none), "source": F.coalesce("source", F.lit("none"))})
    rows = rows.withColumns({"rank": _place("expected", "words"), "b_rank": _place("expected", "b_words")})
    hit = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    positive = F.size("expected") > 0
    matched = (F.col("expected_source") == "") | (F.col("expected_source") == F.col("source"))
    forbidden = F.arrays_overlap("words", "forbidden") & (F.size("words") > 0) & (F.size("forbidden") > 0)
    mrr = lambda test: F.round(F.coalesce(F.avg(F.when(test, _reciprocal(F.col("rank")))), F.lit(0.0)), 6)
    out = rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(positive).alias("positive"),
        *[F.count_if(F.col("source") == x).alias(n) for x, n in (("trigram", "trigram"), ("bigram-backoff", "backoff"), ("none", "none"))],
        *[_percent(hit("rank", k) & positive).alias(f"top_{k}") for k in (1, 3, 5)], mrr(F.lit(True)).alias("mrr"),
        *[_percent(hit("rank", k), positive).alias(f"positive_top_{k}") for k in (1, 3, 5)], mrr(positive).alias("positive_mrr"),
        _percent(matched).alias("source_percent"), _percent(hit("b_rank", 3), positive).alias("baseline_top_3"),
        (F.size(F.array_intersect(F.collect_set("category"), F.array(*map(F.lit, MANDATORY)))) == len(MANDATORY)).alias("categories_ok"),
        (F.count_if(forbidden & F.col("category").isin("sentence-boundary", "document-boundary")) == 0).alias("boundaries_ok"),
        (F.count_if((F.col("category") == "unknown-context") & (F.size("words") > 0)) == 0).alias("unknown_ok"),
        (F.count_if(~matched) == 0).alias("sources_ok"),
        (F.count_if(positive & hit("rank", 5)) > 0).alias("any_answer"),
    ).withColumn("order_ok", wrong == 0)
    out = out.withColumn("valid", F.col("categories_ok") & F.col("boundaries_ok") & F.col("unknown_ok") & F.col("order_ok") & F.col("sources_ok"))
    good = (F.col("positive") > 0) & (F.col("positive_top_3") >= F.col("baseline_top_3")) & F.col("any_answer")
    return out.withColumn("good", good).withColumn("accepted", F.col("valid") & F.col("good")).drop("any_answer")


def next_word_scores(cases: DataFrame, predictions: DataFrame, k: int = 5) -> DataFrame:
    """cases (previous_2, previous_1, expected) against with_backoff's rows: top-1, top-3, top-k, MRR and sources, in one row."""
    keys = ["previous_2", "previous_1"]
    rows = cases.join(predictions, keys, "left")
    per = rows.groupBy(*keys, "expected").agg(F.min(F.when(F.col("next") == F.col("expected"), F.col("rank"))).alias("rank"), F.max("prediction_source").alias("source"))
    hit = lambda n: F.count_if(F.coalesce(F.col("rank") <= n, F.lit(False)))
    return per.agg(
        F.count(F.lit(1)).alias("cases"), hit(1).alias("top_1"), hit(3).alias("top_3"), hit(k).alias(f"top_{k}"),
        F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mrr"),
        F.count_if(F.col("source") == "trigram").alias("trigram"), F.count_if(F.col("source") == "bigram-backoff").alias("backoff"), F.count_if(F.col("source").isNull()).alias("none"),
    )


def provenance(words: DataFrame, **sets: DataFrame | None) -> DataFrame:
    """Words with a flag in_<name> for each set (word) that holds them; null for a set that isn't there."""
    out = words
    for name, s in sets.items():
        if s is None:
            out = out.withColumn(f"in_{name}", F.lit(None).cast("boolean"))
        else:
            out = out.join(s.select("word", F.lit(True).alias(f"in_{name}")).distinct(), "word", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out


def vocabulary(*sets: DataFrame) -> DataFrame:
    """The different words of all sets."""
    out = sets[0].select("word")
    for s in sets[1:]:
        out = out.union(s.select("word"))
    return out.distinct()


def case_provenance(cases: DataFrame, **sets: DataFrame | None) -> DataFrame:
    """Of each case (case_id, input, expected): whether its input, and whether one of its answers, is in each set; null for a set that isn't there."""
    asked = cases.select("case_id", F.lit("input").alias("side"), T.normalize_text(F.col("input")).alias("word"))
    answers = cases.select("case_id", F.lit("expected").alias("side"), F.explode("expected").alias("w")).select("case_id", "side", T.normalize_text(F.col("w")).alias("word"))
    rows = asked.unionByName(answers)
    flags = provenance(rows.select("word").distinct(), **sets)
    flat = rows.join(flags, "word").groupBy("case_id").agg(*[F.bool_or(F.when(F.col("side") == side, F.col(f"in_{name}"))).alias(f"{side}_in_{name}") for name in sets for side in ("input", "expected")])
    missing = [F.coalesce(f"expected_in_{n}", F.lit(False)).alias(f"expected_in_{n}") if s is not None else F.col(f"expected_in_{n}") for n, s in sets.items()]
    return flat.select("case_id", *[f"input_in_{n}" for n in sets], *missing)
