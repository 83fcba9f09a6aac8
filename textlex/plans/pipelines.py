"""Composite pipelines over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlex.functions import text as T
from textlex.operators import audit, corpus, evaluate, frequency, lexicon, ngrams, review


def build_lexicon(entries: DataFrame, freq: DataFrame) -> DataFrame:
    """Normalise, drop invalid entries, merge and attach frequencies."""
    clean = entries.withColumns({"word": T.normalize_text(F.col("word")), "normalized": T.normalize_text(F.col("word"))})
    return lexicon.with_frequency(lexicon.merge(clean.filter(lexicon.entry_problem().isNull())), freq)


def audit_lexicon(records: DataFrame, parsed: DataFrame, seed: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """All reports on an imported list: of its records, of the lines it came from, against a seed, and of a benchmark."""
    names = ("char_inventory", "shape_counts", "script_counts", "length_percentiles", "length_summary", "length_histogram", "suspicious", "stride_sample")
    out = {n: getattr(audit, n)(records) for n in names}
    out |= {n: getattr(audit, n)(parsed) for n in ("cross_check", "rejections")}
    imported = parsed.filter("event = 'Parsed'")
    out |= {n: getattr(audit, n)(imported) for n in ("exact_duplicates", "flag_frequency", "morphology_frequency", "pos_frequency")}
    return out | {"category_samples": audit.category_samples(records, seed), "overlap": audit.overlap(seed, imported), "roll_up": audit.roll_up(records, parsed, seed, items)}


def word_frequencies(docs: DataFrame) -> dict[str, DataFrame]:
    freq = frequency.word_frequencies(docs)
    reports = ("summary", "zipf_buckets", "length_distribution", "char_analysis", "coverage_milestones")
    return {"frequencies": frequency.ranked(freq)} | {n: getattr(frequency, n)(freq) for n in reports}


def ngram_model(docs: DataFrame, n: int, least: int = 2) -> dict[str, DataFrame]:
    grams = ngrams.model(docs, n, least)
    return {"model": ngrams.top_per_context(grams, n), "summary": ngrams.summary(docs, n, least), "top": ngrams.most_frequent(grams, n), "contexts": ngrams.context_distribution(grams, n)}


def inventory_corpora(docs: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    return {"corpora": corpus.inventory(docs), "totals": corpus.token_totals(docs), "breakdown": corpus.breakdown(docs, registry)}


def validate_cases(cases: DataFrame, **sets: DataFrame | None) -> dict[str, DataFrame]:
    problems = cases.select("case_id", evaluate.case_problem().alias("problem")).filter("problem is not null")
    return {"problems": problems, "duplicates": evaluate.duplicate_cases(cases), "contradictions": evaluate.contradictions(cases), "provenance": evaluate.case_provenance(cases, **sets)}


def merge_decisions(decisions: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """Problems, targets that are missing or not changed, and the entries' status from the sound decisions."""
    groups = review.conflict_groups(entries)
    problem = review.decision_problem()
    sound = decisions.filter(problem.isNull())
    orphans, same = review.orphans(sound, entries, groups), review.unchanged_metadata(sound, entries)
    valid = sound.join(orphans.select("target_id").unionByName(same).distinct(), "target_id", "left_anti")
    decided = review.effective_status(entries, valid)
    return {"problems": decisions.withColumn("problem", problem).filter("problem is not null"), "orphans": orphans, "unchanged": same, "decided": decided, "summary": review.status_counts(decided)}


def review_queues(entries: DataFrame, seed: DataFrame, rejected: DataFrame) -> dict[str, DataFrame]:
    groups = review.conflict_groups(entries)
    return {"entries": review.queues(entries, seed, audit.rare_letters(entries), audit.suspicious(entries), rejected), "groups": groups, "members": review.conflict_members(groups, entries)}


def compare_packs(cases: DataFrame, packs: dict[str, DataFrame], baseline: str = "seed") -> dict[str, DataFrame]:
    """Each case asked of each pack, scored, and each pack's changes against the baseline."""
    scored = evaluate.ranked_results(cases, evaluate.pack_results(cases, packs))
    changes = {f"{c}s": evaluate.changed_cases(scored, baseline, c) for c in ("improvement", "regression")}
    return {"scored": scored, "metrics": evaluate.metrics(scored), "pairwise": evaluate.pairwise(scored, baseline), "false_acceptances": evaluate.false_acceptances(scored)} | changes


def audit_corpora(docs: DataFrame, words: DataFrame) -> dict[str, DataFrame]:
    return {"quality": corpus.quality(docs, words), "documents": corpus.document_duplicates(docs), "sentences": corpus.sentence_duplicates(docs)}


def build_pack(name: str, seed: DataFrame, entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries of a pack. In the reviewed pack two candidates of equal precedence are an error."""
    groups = review.conflict_groups(entries)
    resolved = review.resolve_collisions(review.select_pack(name, seed, review.effective_status(entries, decisions), groups, decisions))
    if name == "reviewed":
        resolved = resolved.withColumn("normalized", F.when(F.col("tied"), F.raise_error(F.concat(F.lit("equal precedence: "), F.col("normalized")))).otherwise(F.col("normalized")))
    return resolved.orderBy("normalized", "display")
