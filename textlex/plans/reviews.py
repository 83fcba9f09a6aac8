"""Queries on review, packs and evaluation, over small tables given here and the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlex.functions import ids
from textlex.functions import text as T
from textlex.operators import audit, evaluate, ngrams, predict, review
from textlex.plans import documents as P
from textlex.plans import lexical as L
from textlex.plans.inline import SEED, Inline

SOURCE, REVISION = "dictionary", "0" * 40


def _decision(n, line, status, target="entry", version="review-decision-v1", source=SOURCE, reviewer="anna-b", date="2026-07-02", notes=None, evidence=(), display=None, normalized=None, flags=None, morphology=None, pos=None, resolution=None, selected=None, new=None, new_normalized=None):
    return (n, version, target, line, source, status, reviewer, date, notes, list(evidence), display, normalized, flags, morphology, pos, resolution, selected, new, new_normalized)


#: target_line 0 stands for an empty target.
DECISIONS = Inline(
    "decisions",
    "n bigint, schema_version string, target_type string, target_line bigint, source_id string, review_status string, reviewer_id string, review_date string, review_notes string, evidence array<string>, new_display string, new_normalized string, "
    "new_flags string, new_morphology array<string>, new_part_of_speech string, resolution string, selected_line bigint, resolution_display string, resolution_normalized string",
    [
        _decision(1, 4, "approved", date="2026-7-2"),
        _decision(2, 7, "approved_with_metadata_change", display="AC-DC", normalized="ac-dc"),
        _decision(3, 13, "experimental_only", date="2026-02-29"),
        _decision(4, 14, "approved", version="review-decision-v0"),
        _decision(5, 3, "approved", target="conflict_group"),
        _decision(6, 99, "rejected_from_default_pack", notes=" "),
        _decision(7, 14, "unreviewed", date=None),
        _decision(8, 14, "approved_with_metadata_change", display="Çav", normalized="cav"),
        _decision(9, 14, "approved", reviewer=""),
        _decision(10, 14, "approved", date="1999-07-02"),
        _decision(11, 3, "approved", target="conflict_group", resolution="select_member", selected=8),
        _decision(12, 15, "approved", target="conflict_group", resolution="replace_group", new="Hirçan", new_normalized="hirçan"),
        _decision(13, 17, "experimental_only", target="conflict_group"),
        _decision(14, 19, "rejected_from_default_pack", target="conflict_group", notes="two lists differ"),
        _decision(15, 13, "approved_with_metadata_change", display="gund", normalized="gund", flags="", pos="zz"),
        _decision(16, 0, "approved"),
        _decision(17, 14, "approved", source=" "),
        _decision(18, 21, "approved_with_metadata_change", target="conflict_group", display="Stêr", normalized="stêr"),
        _decision(19, 21, "approved", target="conflict_group", display="Stêr", normalized="stêr", resolution="select_member", selected=21),
        _decision(20, 14, "approved", display="Çav", normalized="çav"),
        _decision(21, 14, "approved_with_metadata_change", display=" ", normalized=""),
        _decision(22, 98, "needs_linguist", evidence=["a list"]),
        _decision(23, 97, "approved", target="conflict_group", resolution="select_member", selected=97),
        _decision(24, 2, "approved_with_metadata_change", display="sêvik", normalized="sêvik", flags="AN", morphology=["po:noun"]),
    ],
)
CASES = Inline(
    "cases",
    "case_id string, task string, category string, input string, accepted boolean, preserve_exact boolean, expected array<string>, forbidden array<string>, allow_none boolean, top_k bigint, review_status string, reviewer_id string, review_date string",
    [
        ("c1", "accept-word", "correct-spelling", "malbat", True, None, [], [], None, None, "human-reviewed", "anna-b", "2026-07-02"),
        ("c2", "accept-word", "false-acceptance", "zzz", False, None, [], [], None, None, "human-reviewed", "bot-1", "2026-07-02"),
        ("c3", "correct-word", "missing-diacritics", "deri", None, None, ["derî"], ["dar"], None, 1, "draft", None, None),
        ("c4", "correct-word", "no-candidate", "qqqq", None, None, [], [], True, None, "draft", "anna-b", None),
        ("c5", "complete-prefix", "prefix-completion", "malb", None, None, ["malbat"], [], None, 3, "human-reviewed", "anna-b", "2026-02-30"),
        ("c6", "correct-word", "prefix-completion", "nann", None, None, ["nan", "nan"], [], None, None, "draft", None, None),
        ("c7", "accept-word", "exact-preservation", "av", None, True, [], [], None, None, "draft", None, None),
        ("c8", "correct-word", "substitution", "deri", None, None, ["derî", "darî"], [], None, None, "draft", None, None),
    ],
)
RESULTS = Inline(
    "results",
    "case_id string, pack string, is_known boolean, suggestions array<string>",
    [
        ("c1", "seed", True, []), ("c1", "full", True, []), ("c2", "seed", False, []), ("c2", "full", True, []),
        ("c3", "seed", False, ["derî", "dar"]), ("c3", "full", False, ["dar", "derî"]), ("c4", "seed", False, ["a"]), ("c4", "full", False, []),
        ("c5", "seed", False, ["mal", "malbat"]), ("c5", "full", False, ["malbat"]), ("c6", "seed", False, ["nan"]), ("c6", "full", False, []),
        ("c7", "seed", False, []), ("c7", "full", True, []), ("c8", "seed", False, ["a", "b", "darî"]), ("c8", "full", False, ["a", "darî"]),
    ],
)
NEXT_CASES = Inline(
    "next_cases",
    "case_id string, category string, expected array<string>, forbidden array<string>, expected_source string",
    [
        ("n1", "trigram-hit", ["nan"], [], "trigram"), ("n2", "trigram-preferred", ["av", "nan"], [], "trigram"), ("n3", "bigram-backoff", ["mal"], [], "bigram-backoff"), ("n4", "unknown-context", [], [], "none"),
        ("n5", "sentence-boundary", [], ["dar"], ""), ("n6", "document-boundary", ["dar"], ["kevir"], ""), ("n7", "deterministic-tie", ["sêv"], [], "bigram"),
    ],
)
PREDICTED = Inline(
    "predicted",
    "case_id string, source string, rank bigint, next string, count bigint, probability_millionths bigint",
    [
        ("n1", "trigram", 1, "nan", 5, 600_000), ("n1", "trigram", 2, "av", 3, 400_000), ("n2", "trigram", 1, "mal", 4, 500_000), ("n2", "trigram", 2, "av", 4, 500_000), ("n3", "bigram-backoff", 1, "derî", 2, 700_000),
        ("n3", "bigram-backoff", 2, "mal", 1, 300_000), ("n5", "bigram", 1, "masî", 2, 1_000_000), ("n6", "bigram", 1, "kevir", 2, 600_000), ("n6", "bigram", 2, "dar", 1, 400_000), ("n7", "bigram", 1, "stêr", 1, 500_000), ("n7", "bigram", 2, "sêv", 1, 500_000),
    ],
)
BIGRAM_ONLY = Inline("bigram_only", "case_id string, words array<string>", [("n1", ["nan"]), ("n2", ["mal"]), ("n3", ["mal"]), ("n6", []), ("n7", ["a", "b", "c", "sêv"])])
ITEMS = Inline("items", "input string, expected string", [("deri", "derî"), ("malb", "malbat"), ("nann", "nan"), ("susa", "şûşe"), ("xyzzy", "zarok"), ("deri", "derî"), ("kevri", "kevir")])
QUEUED = Inline(
    "queued",
    "position bigint, target_type string, target_id string, normalized string, display string, source_id string, source_revision string",
    [(1, "entry", "e1", "mal", "Mal", "a", "1"), (2, "entry", "e1", "mal", "mal", "a", "2"), (3, "conflict_group", "e1", "mal", "mal", "a", "1"), (4, "entry", "e2", "av", "av", "b", "1")],
)
SNAPSHOTS = Inline(
    "snapshots",
    "side string, case_id string, review_status string, content string",
    [("b", i, s, c) for i, s, c in [("a", "human-reviewed", "1"), ("c", "human-reviewed", "1"), ("d", "draft", "1"), ("e", "draft", "1"), ("f", "human-reviewed", "1"), ("g", "human-reviewed", "1"), ("h", "draft", "1")]]
    + [("c", i, s, c) for i, s, c in [("a", "human-reviewed", "1"), ("c", "human-reviewed", "2"), ("d", "human-reviewed", "1"), ("e", "human-reviewed", "2"), ("f", "draft", "1"), ("i", "human-reviewed", "1"), ("j", "draft", "1")]],
)
CHECKED = Inline(
    "checked",
    "value string",
    [(v,) for v in ["2024-02-29", "2023-02-29", "2024-2-9", "0000-01-01", "1999-12-31", "2101-01-01", "2024-13-01", "2024-00-10", "anna-b", "an", "bot-x", "a--b", "123", "Anna", "a" * 40, "0123456789abcdef0123456789abcdef01234567", "a/b.txt", "/a", "a/../b", "a//b", "C:/x", "a\\b", "./a", "a/.", ""]],
)


def entries(spark):
    return review.with_entry_id(L.parsed(spark).filter("event = 'Parsed'"), SOURCE, REVISION)


def seed(spark):
    return SEED.frame(spark).select("word", "normalized")


def groups(spark):
    return review.conflict_groups(entries(spark))


def decisions(spark):
    """The decisions with the ids of their targets; what has no entry or group is missing."""
    e = entries(spark).select("line_num", "normalized", "entry_id")
    d = DECISIONS.frame(spark).join(e.select(F.col("line_num").alias("target_line"), F.col("entry_id").alias("of_entry"), F.col("normalized").alias("n_")), "target_line", "left")
    d = d.join(groups(spark).select(F.col("normalized").alias("n_"), F.col("group_id").alias("of_group")), "n_", "left")
    d = d.join(e.select(F.col("line_num").alias("selected_line"), F.col("entry_id").alias("selected_entry_id")), "selected_line", "left")
    target = F.when(F.col("target_type") == "entry", F.col("of_entry")).otherwise(F.col("of_group"))
    return d.withColumn("target_id", F.when(F.col("target_line") == 0, "").otherwise(F.coalesce(target, F.lit("missing")))).drop("of_entry", "of_group", "n_")


def valid_decisions(spark):
    """Decisions without a problem that have a target and, where they change metadata, change some."""
    d = decisions(spark).filter(review.decision_problem().isNull())
    none = review.orphans(d, entries(spark), groups(spark)).select("target_id").unionByName(review.unchanged_metadata(d, entries(spark)))
    return d.join(none.distinct(), "target_id", "left_anti")


def queue_rows(spark):
    e = entries(spark)
    return review.queues(e, seed(spark), audit.rare_letters(e), audit.suspicious(e), L.parsed(spark).filter("event = 'Rejected'"))


def pack(spark, name):
    return review.select_pack(name, seed(spark), review.effective_status(entries(spark), valid_decisions(spark)), groups(spark), valid_decisions(spark))


def packs(spark):
    out = None
    for name in review.SELECTED:
        one = pack(spark, name).withColumn("pack", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def counts(spark):
    decided = review.effective_status(entries(spark), valid_decisions(spark))
    out = None
    for name in review.SELECTED:
        found = pack(spark, name)
        one = review.selection_counts(name, found, decided, review.resolve_collisions(found))
        out = one if out is None else out.unionByName(one)
    return out


def pack_lexicon(spark, name):
    """The words of a pack with the counts of the seed list."""
    words = review.resolve_collisions(pack(spark, name)).select(F.col("display").alias("word"), "normalized")
    c = SEED.frame(spark).select("normalized", "token_count", "document_count", "zipf_milli")
    return words.join(c, "normalized", "left").fillna(0, ["token_count", "document_count", "zipf_milli"])


def compared(spark):
    """The cases asked of the packs themselves."""
    results = evaluate.pack_results(CASES.frame(spark), {name: pack_lexicon(spark, name) for name in review.SELECTED})
    return evaluate.pairwise(evaluate.ranked_results(CASES.frame(spark), results), "seed")


def scored(spark):
    return evaluate.ranked_results(CASES.frame(spark), RESULTS.frame(spark))


def next_word(spark, sf_dir):
    b = P.read(spark, sf_dir, "benchmark")
    cases = ngrams.windows(b, 3).select("previous_2", "previous_1", F.col("next").alias("expected")).distinct()
    return evaluate.next_word_scores(cases, predict.backoff_of(cases, P.docs(spark, sf_dir)))


def side(spark, pack):
    return RESULTS.frame(spark).filter(F.col("pack") == pack)


def ranking_cases(spark):
    c = CASES.frame(spark).select("case_id", "input", "expected", "category")
    return c.withColumn("category", F.when(F.col("case_id") == "c7", "exact-word-preservation").otherwise(F.col("category")))


def impact(spark):
    items = spark.createDataFrame([(i, e) for i, e in ITEMS.rows], "input string, expected string")
    return evaluate.lexicon_impact(items, SEED.frame(spark))


def case_sources(spark, sf_dir):
    """Benchmark words with the partitions of the documents that hold them."""
    from textlex.operators import corpus

    words = P.docs(spark, sf_dir).select(corpus.assign_partition(T.duplicate_group_id(F.col("text"))).alias("p"), F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return evaluate.provenance(L.benchmark_words(spark, sf_dir).select(F.col("query").alias("word")), **{p: words.filter(F.col("p") == p) for p in ("train", "development", "evaluation")})


U64 = lambda n: f"unhex(printf('%016x', {n}))"


def _blob(c: str) -> str:
    return f"encode({c})"


def _field(c: str) -> str:
    return f"({U64(f'strlen({c})')} || {_blob(c)})"


def _fields(c: str) -> str:
    return f"list_reduce(list_prepend(''::BLOB, list_transform({c}, lambda v: {_field('v')})), lambda s, v: s || v)"


ENTRIES_SQL = f"""{L.PARSED.replace("array_to_string(morphology, ' ') AS morphology,", "morphology,")}, entries AS (SELECT *, sha256({' || '.join(_field(f"'{v}'") for v in (ids.ENTRY_TAG, SOURCE, REVISION))} || {_field('nfc_normalize(word)')} || {_field('normalized')} || {_field('flags')}
  || {_fields('list_sort(morphology)')}) AS entry_id FROM parsed WHERE event = 'Parsed')"""
_SCORED = f"""{CASES.sql}, {RESULTS.sql}, scored AS (SELECT *, list_min(list_filter(list_transform(expected, lambda w: list_position(suggestions, w)), lambda k: k > 0)) AS er,
  list_min(list_filter(list_transform(forbidden, lambda w: list_position(suggestions, w)), lambda k: k > 0)) AS fr, coalesce(list_min(list_filter(list_transform(expected, lambda w: list_position(suggestions, w)), lambda k: k > 0)) <= coalesce(top_k, 10), false) AS sat
  FROM cases JOIN results USING (case_id))"""


def _metric(name: str, eligible: str, matched: str) -> str:
    n, m = f"count(*) FILTER ({eligible})", f"count(*) FILTER (({eligible}) AND ({matched}))"
    return f"SELECT pack, '{name}' AS metric, {n} AS eligible, {m} AS matched, count(*) - {n} AS excluded, round({m} / nullif({n}, 0), 9) AS value FROM scored GROUP BY pack"


_CW = "task = 'correct-word' AND len(expected) > 0"
METRICS = " UNION ALL ".join(
    [
        _metric("known_word_coverage", "task = 'accept-word' AND coalesce(accepted, false)", "is_known"),
        _metric("false_acceptance", "task = 'accept-word' AND NOT coalesce(accepted, true)", "is_known"),
        *[_metric(f"correction_top_{k}", _CW, f"coalesce(er <= {k}, false)") for k in (1, 3, 5)],
        _metric("completion_recall", "task = 'complete-prefix' AND len(expected) > 0", "er IS NOT NULL"),
        _metric("exact_preservation", "coalesce(preserve_exact, false)", "is_known"),
        _metric("no_candidate", "coalesce(allow_none, false)", "len(suggestions) = 0"),
        f"SELECT pack, 'mrr' AS metric, count(*) FILTER ({_CW}), count(*) FILTER ({_CW} AND er IS NOT NULL), count(*) FILTER (NOT ({_CW})), round(sum(CASE WHEN {_CW} AND er IS NOT NULL THEN 1 / er ELSE 0 END) / nullif(count(*) FILTER ({_CW}), 0), 9) FROM scored GROUP BY pack",
    ]
)
_NORM = lambda c: f"lower(nfc_normalize(regexp_replace({c}, '[\\p{{Cc}}\\x{{200B}}\\x{{FEFF}}]', '', 'g')))"
_BLANK = lambda c: f"trim(coalesce({c}, '')) = ''"
_WRONG = f"""CASE WHEN schema_version <> '{ids.DECISION_VERSION}' THEN 'SCHEMA_VERSION' WHEN target_line = 0 THEN 'TARGET_ID' WHEN {_BLANK('source_id')} THEN 'SOURCE_ID'
  WHEN review_status = 'unreviewed' AND (reviewer_id IS NOT NULL OR review_date IS NOT NULL OR review_notes IS NOT NULL OR new_display IS NOT NULL) THEN 'UNREVIEWED_WITH_REVIEW'
  WHEN review_status <> 'unreviewed' AND {_BLANK('reviewer_id')} THEN 'REVIEWER' WHEN review_status <> 'unreviewed' AND (try_strptime(review_date, '%Y-%m-%d') IS NULL OR year(try_strptime(review_date, '%Y-%m-%d')) NOT BETWEEN 2000 AND 2100) THEN 'REVIEW_DATE'
  WHEN target_type = 'conflict_group' AND review_status = 'approved_with_metadata_change' THEN 'GROUP_METADATA_CHANGE' WHEN target_type = 'conflict_group' AND new_display IS NOT NULL THEN 'GROUP_REPLACEMENT'
  WHEN target_type = 'conflict_group' AND review_status = 'approved' AND resolution IS NULL THEN 'GROUP_RESOLUTION' WHEN review_status <> 'approved_with_metadata_change' AND new_display IS NOT NULL THEN 'REPLACEMENT_NOT_ALLOWED'
  WHEN review_status = 'approved_with_metadata_change' AND {_BLANK('new_display')} THEN 'REPLACEMENT_MISSING' WHEN review_status = 'approved_with_metadata_change' AND new_normalized IS DISTINCT FROM {_NORM('new_display')} THEN 'REPLACEMENT_NORMALIZED'
  WHEN review_status = 'rejected_from_default_pack' AND {_BLANK('review_notes')} AND len(evidence) = 0 THEN 'REJECTION_REASON' END"""
_GROUPS = """firsts AS (SELECT *, first_value((word, flags, morphology, part_of_speech)) OVER (PARTITION BY normalized ORDER BY line_num) AS f FROM entries),
  grouped AS (SELECT normalized, list_sort(list(DISTINCT entry_id)) AS members, list_sort(list_distinct(flatten(list(list_filter([CASE WHEN word <> f[1] THEN 'word' END, CASE WHEN flags <> f[2] THEN 'flags' END,
    CASE WHEN morphology <> f[3] THEN 'morphology' END, CASE WHEN part_of_speech <> f[4] THEN 'part_of_speech' END], lambda x: x IS NOT NULL))))) AS d FROM firsts GROUP BY 1 HAVING len(d) > 0)"""
_GROUPS += f""", groups AS (SELECT *, sha256({_field(repr(ids.GROUP_TAG))} || {_field('normalized')} || {_fields('members')}) AS group_id FROM grouped)"""
_OWN = "FROM decisions d LEFT JOIN entries e ON e.line_num = d.target_line LEFT JOIN groups g ON g.normalized = e.normalized"
_DECIDED = f"""{ENTRIES_SQL}, {_GROUPS}, {DECISIONS.sql}, sound AS (SELECT d.*, CASE WHEN target_type = 'entry' THEN e.entry_id ELSE g.group_id END AS target_id,
    review_status = 'approved_with_metadata_change' AND new_display = e.word AND (new_flags IS NULL OR new_flags = e.flags) AND (new_morphology IS NULL OR new_morphology = e.morphology) AND (new_part_of_speech IS NULL OR new_part_of_speech = e.part_of_speech) AS same
    {_OWN} WHERE {_WRONG.replace('review_status', 'd.review_status')} IS NULL),
  valid AS (SELECT * FROM sound WHERE target_id IS NOT NULL AND NOT coalesce(same, false)),
  decided AS (SELECT e.*, coalesce(v.review_status, 'unreviewed') AS review_status, v.new_display, v.new_normalized FROM entries e LEFT JOIN valid v ON v.target_type = 'entry' AND v.target_id = e.entry_id)"""
_POP = "CASE review_status WHEN 'approved' THEN 'external_approved' WHEN 'approved_with_metadata_change' THEN 'external_approved_metadata_change' WHEN 'experimental_only' THEN 'external_experimental_only' WHEN 'unreviewed' THEN 'external_unreviewed' END"
_COLS = f"entry_id, CASE WHEN review_status = 'approved_with_metadata_change' THEN new_display ELSE word END AS display, CASE WHEN review_status = 'approved_with_metadata_change' THEN new_normalized ELSE normalized END AS normalized, {_POP} AS population, line_num AS source_line"
_PACKS = f"""{_DECIDED}, {SEED.sql}, single AS (SELECT * FROM decided WHERE entry_id NOT IN (SELECT unnest(members) FROM groups) QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY line_num) = 1),
  gdec AS (SELECT g.*, coalesce(v.review_status, 'unreviewed') AS st, v.resolution, v.resolution_display, v.resolution_normalized, s.entry_id AS sel FROM groups g LEFT JOIN valid v ON v.target_type = 'conflict_group' AND v.target_id = g.group_id
    LEFT JOIN entries s ON s.line_num = v.selected_line),
  mem AS (SELECT st, resolution, sel, m.entry_id, arg_min(word, line_num) AS w, min(line_num) AS ln FROM (SELECT *, unnest(members) AS entry_id FROM gdec) m JOIN entries e ON e.entry_id = m.entry_id GROUP BY ALL),
  both_packs AS (SELECT unnest(['reviewed', 'experimental-full']) AS pack),
  picked AS (
  SELECT 'seed:' || normalized AS entry_id, word AS display, normalized, 'manual_seed' AS population, NULL::BIGINT AS source_line, pack FROM seed, (SELECT unnest(['seed', 'reviewed', 'experimental-full']) AS pack) UNION ALL
  SELECT {_COLS}, 'reviewed' FROM single WHERE review_status LIKE 'approved%' UNION ALL
  SELECT {_COLS}, 'experimental-full' FROM single WHERE {_POP} IS NOT NULL UNION ALL
  SELECT entry_id, w, {_NORM('w')}, 'external_approved', ln, pack FROM mem, both_packs WHERE st = 'approved' AND resolution = 'select_member' AND entry_id = sel UNION ALL
  SELECT group_id, resolution_display, resolution_normalized, 'external_approved_metadata_change', NULL, pack FROM gdec, both_packs WHERE st = 'approved' AND resolution = 'replace_group' UNION ALL
  SELECT entry_id, w, {_NORM('w')}, CASE st WHEN 'experimental_only' THEN 'external_experimental_only' ELSE 'external_unreviewed' END, ln, 'experimental-full' FROM mem WHERE st IN ('experimental_only', 'unreviewed'))"""

QUERIES = {
    "entry_ids": lambda s, d: entries(s).select("line_num", "entry_id"),
    "conflict_groups": lambda s, d: review.conflict_groups(entries(s)).select("group_id", "normalized", F.size("members").cast("long").alias("members"), F.concat_ws(",", "differing_fields").alias("differing_fields")),
    "queue_routing": lambda s, d: queue_rows(s),
    "decision_validate": lambda s, d: decisions(s).select("n", review.decision_problem().alias("problem")),
    "decision_merge": lambda s, d: review.effective_status(entries(s), valid_decisions(s)).select("line_num", "review_status"),
    "decision_summary": lambda s, d: review.status_counts(review.effective_status(entries(s), valid_decisions(s))),
    "decision_orphans": lambda s, d: review.orphans(decisions(s), entries(s), groups(s)),
    "metadata_unchanged": lambda s, d: review.unchanged_metadata(decisions(s), entries(s)),
    "conflict_members": lambda s, d: review.conflict_members(groups(s), entries(s)),
    "queue_latest": lambda s, d: review.latest_targets(QUEUED.frame(s)),
    "pack_select": lambda s, d: packs(s),
    "pack_counts": lambda s, d: packs(s).groupBy("pack", "population").agg(F.count(F.lit(1)).alias("entries")),
    "selection_counts": lambda s, d: counts(s),
    "compare_packs": lambda s, d: compared(s),
    "collisions": lambda s, d: review.resolve_collisions(pack(s, "experimental-full")),
    "case_ids": lambda s, d: CASES.frame(s).select("case_id", ids.case_id(F.col("task"), F.col("category"), F.col("input"), F.lit(None).cast("array<string>"), F.struct("accepted", "preserve_exact", "expected", "forbidden", "allow_none", "top_k")).alias("canonical_id")),
    "provenance_ids": lambda s, d: CASES.frame(s).select("case_id", ids.provenance_id(F.col("task"), F.col("reviewer_id"), F.lit(None).cast("string"), F.col("review_date")).alias("provenance_id")),
    "case_validate": lambda s, d: CASES.frame(s).select("case_id", evaluate.case_problem().alias("problem")),
    "case_metrics": lambda s, d: evaluate.metrics(scored(s)),
    "pairwise": lambda s, d: evaluate.pairwise(scored(s), "seed"),
    "pairwise_summary": lambda s, d: evaluate.pairwise(scored(s), "seed").groupBy("pack", "class").agg(F.count(F.lit(1)).alias("cases")),
    "changed_cases": lambda s, d: evaluate.changed_cases(scored(s), "seed", "improvement").unionByName(evaluate.changed_cases(scored(s), "seed", "regression")),
    "false_acceptances": lambda s, d: evaluate.false_acceptances(scored(s)),
    "duplicate_cases": lambda s, d: evaluate.duplicate_cases(evaluate.case_set(CASES.frame(s).filter("review_status = 'draft'"), CASES.frame(s).filter("review_status <> 'draft'")).unionByName(CASES.frame(s).filter("case_id in ('c1', 'c8')").withColumn("case_id", F.when(F.col("case_id") == "c1", "c1").otherwise("c9")))),
    "ranking_eval": lambda s, d: evaluate.ranking_evaluation(ranking_cases(s), side(s, "seed"), side(s, "full")),
    "ranking_search": lambda s, d: evaluate.evaluate_ranking(ranking_cases(s), SEED.frame(s)),
    "lexicon_impact": lambda s, d: impact(s),
    "next_word_gates": lambda s, d: evaluate.next_word_evaluation(NEXT_CASES.frame(s), PREDICTED.frame(s), BIGRAM_ONLY.frame(s)),
    "out_of_order": lambda s, d: evaluate.out_of_order(PREDICTED.frame(s), ["case_id"]).select("case_id", "rank"),
    "benchmark_audit": lambda s, d: evaluate.benchmark_audit(ITEMS.frame(s), entries(s), seed(s)),
    "case_overlap": lambda s, d: evaluate.case_provenance(CASES.frame(s), seed=seed(s).select(F.col("normalized").alias("word")), imported=entries(s).select(F.col("normalized").alias("word")), train=P.docs(s, d).select(F.explode(T.tokens(F.col("text"))).alias("word")), held_out=None),
    "contradictions": lambda s, d: evaluate.contradictions(CASES.frame(s)),
    "transition": lambda s, d: evaluate.transition(SNAPSHOTS.frame(s).filter("side = 'b'").drop("side"), SNAPSHOTS.frame(s).filter("side = 'c'").drop("side")),
    "checks": lambda s, d: CHECKED.frame(s).select("value", *[F.coalesce(f(F.col("value")), F.lit(False)).alias(n) for n, f in (("review_date", ids.review_date_ok), ("strict_date", ids.strict_date_ok), ("reviewer", ids.reviewer_ok), ("commit", ids.commit_ok), ("safe_path", ids.safe_path))]),
    "next_word_eval": next_word,
    "case_provenance": case_sources,
}
_PAIR = """CASE WHEN b.task = 'accept-word' THEN CASE WHEN coalesce(b.preserve_exact, false) OR coalesce(b.accepted, false) THEN CASE WHEN NOT b.is_known AND c.is_known THEN 'improvement' WHEN b.is_known AND NOT c.is_known THEN 'regression' ELSE 'unchanged' END
    WHEN b.accepted = false THEN CASE WHEN b.is_known AND NOT c.is_known THEN 'improvement' WHEN NOT b.is_known AND c.is_known THEN 'regression' ELSE 'unchanged' END ELSE 'unchanged' END
  WHEN b.fr IS NULL AND c.fr IS NOT NULL OR c.fr < b.fr THEN 'regression' WHEN b.fr IS NOT NULL AND c.fr IS NULL OR c.fr > b.fr THEN 'improvement'
  WHEN coalesce(b.allow_none, false) AND len(b.suggestions) > 0 AND len(c.suggestions) = 0 THEN 'improvement' WHEN coalesce(b.allow_none, false) AND len(b.suggestions) = 0 AND len(c.suggestions) > 0 THEN 'regression'
  WHEN len(b.expected) = 0 THEN 'unchanged' WHEN NOT b.sat AND c.sat THEN 'improvement' WHEN b.sat AND NOT c.sat THEN 'regression'
  WHEN b.er IS NULL AND c.er IS NOT NULL OR c.er < b.er THEN 'improvement' WHEN b.er IS NOT NULL AND c.er IS NULL OR c.er > b.er THEN 'regression' ELSE 'unchanged' END"""
_PAIRS = f"{_SCORED}, pairs AS (SELECT b.case_id, c.pack, {_PAIR} AS class FROM scored b JOIN scored c ON b.case_id = c.case_id WHERE b.pack = 'seed' AND c.pack <> 'seed')"
_OPT = lambda c: f"(CASE WHEN {c} IS NULL THEN unhex('00') ELSE unhex('01') || {_field(c)} END)"
_BOOL = lambda c: f"(CASE WHEN {c} IS NULL THEN unhex('00') WHEN {c} THEN unhex('0101') ELSE unhex('0100') END)"
_LIST = lambda c: f"({U64(f'len({c})')} || {_fields(f'list_sort({c})')})"
_EXP = f"{_BOOL('accepted')} || {_BOOL('preserve_exact')} || {_LIST('expected')} || {_LIST('forbidden')} || {_BOOL('allow_none')} || (CASE WHEN top_k IS NULL THEN unhex('00') ELSE unhex('01') || {U64('top_k')} END)"
_NONE = " OR ".join(f"({L.SHAPES[k]})" for k in ("punctuation_only", "symbol_only", "digit_only"))
_WORD_SCRIPT = L.SCRIPT.replace("normalized", "word")
_QUEUES = {
    "suspicious-entries": ("SUSPICIOUS_ENTRY", "EXISTS (SELECT 1 FROM sus WHERE sus.word = e.word AND sus.normalized = e.normalized)"),
    "unusual-scripts": ("UNUSUAL_SCRIPT", f"regexp_matches({_WORD_SCRIPT}, '^(ARABIC_ONLY|CYRILLIC_ONLY|OTHER_SINGLE)')"),
    "mixed-scripts": ("MIXED_SCRIPT", f"contains({_WORD_SCRIPT}, 'MIXED')"),
    **{q: (r, L.SHAPES[k]) for q, r, k in (("punctuation-only", "PUNCTUATION_ONLY", "punctuation_only"), ("symbol-only", "SYMBOL_ONLY", "symbol_only"), ("digit-only", "DIGIT_ONLY", "digit_only"), ("multiword-entries", "MULTIWORD_ENTRY", "multiword"))},
    "no-letter": ("NO_LETTER", f"{L.SHAPES['no_letters']} AND NOT ({_NONE})"),
    "capitalization-anomalies": ("CAPITALIZATION_ANOMALY", f"({L.SHAPES['uppercase_only']}) OR ({L.SHAPES['mixed_case']})"),
    "rare-code-points": ("RARE_CODE_POINT", "EXISTS (SELECT 1 FROM rare WHERE contains(normalized, rare.char))"),
    "short-and-long-forms": ("SHORT_AND_LONG_FORM", f"{L.G} <= {review.SHORT} OR {L.G} >= {review.LONG}"),
    "hunspell-only": ("HUNSPELL_ONLY", "normalized NOT IN (SELECT normalized FROM seed)"),
}
_SUSPICIOUS = L._audit_sql("records")["suspicious"].split("'\\p{L}')) ", 1)[1]
_QUEUE_SQL = f"""WITH {ENTRIES_SQL}, {SEED.sql}, records AS (SELECT line_num, word, normalized FROM entries), {L.CHARS}, rare AS (SELECT char FROM chars WHERE normalized_entries BETWEEN 1 AND 4 AND regexp_matches(char, '\\p{{L}}')), sus AS ({_SUSPICIOUS})
  {' UNION ALL '.join(f"SELECT '{q}' AS queue, entry_id AS target_id, normalized, '{rule}_V1' AS rule_id FROM entries e WHERE {test}" for q, (rule, test) in _QUEUES.items())} UNION ALL
  SELECT 'parser-rejections', 'line:' || line_num, line, 'PARSER_REJECTION_V1' FROM parsed WHERE event = 'Rejected'"""
_ORDER = """SELECT case_id, rank FROM (SELECT *, lag(probability_millionths) OVER w AS p, lag(count) OVER w AS c, lag(next) OVER w AS x FROM predicted WINDOW w AS (PARTITION BY case_id ORDER BY rank))
  WHERE p < probability_millionths OR p = probability_millionths AND (c < count OR c = count AND x >= next)"""
_REVIEWER = lambda c: f"(regexp_matches({c}, '^[a-z0-9]+(-[a-z0-9]+)*$') AND regexp_matches({c}, '[a-z]') AND length({c}) BETWEEN 3 AND 64 AND len(list_intersect(string_split({c}, '-'), {ids.RESERVED})) = 0)"
_STRICT = lambda c: f"(regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND NOT starts_with({c}, '0000') AND try_strptime({c}, '%Y-%m-%d') IS NOT NULL)"
_BENCH_RUNS = P.ORACLE["trigrams"].replace("FROM documents", "FROM (SELECT item_id AS doc_id, text, '' AS source, '' AS lang FROM benchmark)").replace("WHERE count >= 2", "")
_RANK = "list_position([" + ", ".join(f"'{p}'" for p in review.POPULATIONS) + "], population)"
ORACLE = {
    "entry_ids": f"WITH {ENTRIES_SQL} SELECT line_num, entry_id FROM entries",
    "conflict_groups": f"WITH {ENTRIES_SQL}, {_GROUPS} SELECT group_id, normalized, len(members) AS members, array_to_string(d, ',') AS differing_fields FROM groups",
    "conflict_members": f"""WITH {ENTRIES_SQL}, {_GROUPS}, m AS (SELECT group_id, normalized, unnest(members) AS entry_id FROM groups)
      SELECT group_id, m.normalized, m.entry_id, arg_min(word, line_num) AS display, list_sort(list(DISTINCT line_num)) AS source_lines, arg_min(flags, line_num) AS flags, arg_min(part_of_speech, line_num) AS part_of_speech
      FROM m JOIN entries e ON e.entry_id = m.entry_id GROUP BY 1, 2, 3""",
    "metadata_unchanged": f"WITH {_DECIDED.replace('WHERE ' + _WRONG.replace('review_status', 'd.review_status') + ' IS NULL)', ')')} SELECT DISTINCT target_id FROM sound WHERE target_type = 'entry' AND same",
    "queue_routing": _QUEUE_SQL,
    "queue_latest": f"WITH {QUEUED.sql} SELECT * FROM queued QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY position DESC) = 1",
    "decision_validate": f"WITH {DECISIONS.sql} SELECT n, {_WRONG} AS problem FROM decisions",
    "decision_merge": f"WITH {_DECIDED} SELECT line_num, review_status FROM decided",
    "decision_summary": f"WITH {_DECIDED} SELECT review_status, count(*) AS entries FROM decided GROUP BY 1",
    "decision_orphans": f"""WITH {ENTRIES_SQL}, {_GROUPS}, {DECISIONS.sql} SELECT CASE WHEN target_line = 0 THEN '' ELSE 'missing' END AS target_id, review_status {_OWN}
      WHERE CASE WHEN target_type = 'entry' THEN e.entry_id ELSE g.group_id END IS NULL""",
    "selection_counts": f"""WITH {_PACKS}, ranked AS (SELECT *, count(*) OVER (PARTITION BY pack, normalized) - 1 AS competing, row_number() OVER (PARTITION BY pack, normalized) AS k FROM picked),
      lost AS (SELECT pack, sum(competing)::BIGINT AS discarded_by_collision, count(*) AS final_entries FROM ranked WHERE k = 1 GROUP BY 1)
      SELECT p.pack, {', '.join(f"count(*) FILTER (population = '{x}') AS {x}" for x in review.POPULATIONS)},
        (SELECT count(DISTINCT entry_id) FROM entries) - count(DISTINCT p.entry_id) FILTER (p.entry_id IN (SELECT entry_id FROM entries)) AS excluded_by_status, any_value(discarded_by_collision) AS discarded_by_collision, any_value(final_entries) AS final_entries
      FROM picked p JOIN lost USING (pack) GROUP BY 1""",
    "pack_select": f"WITH {_PACKS} SELECT * FROM picked",
    "pack_counts": f"WITH {_PACKS} SELECT pack, population, count(*) AS entries FROM picked GROUP BY ALL",
    "collisions": f"""WITH {_PACKS}, o AS (SELECT *, row_number() OVER w AS k, {_RANK} AS r, lead({_RANK}) OVER w AS nr, count(*) OVER (PARTITION BY normalized) - 1 AS competing FROM picked WHERE pack = 'experimental-full'
      WINDOW w AS (PARTITION BY normalized ORDER BY {_RANK}, source_line NULLS FIRST, display, entry_id)) SELECT normalized, display, entry_id, population, competing, coalesce(r = nr, false) AS tied FROM o WHERE k = 1""",
    "case_ids": f"WITH {CASES.sql} SELECT case_id, sha256({_field(repr(ids.CASE_TAG))} || {_field('task')} || {_field('category')} || {_field('input')} || {U64('0')} || {_EXP}) AS canonical_id FROM cases",
    "provenance_ids": f"WITH {CASES.sql} SELECT case_id, sha256({_field(repr(ids.PROVENANCE_TAG))} || {_field('task')} || {_OPT('reviewer_id')} || unhex('00') || {_OPT('review_date')}) AS provenance_id FROM cases",
    "case_metrics": f"WITH {_SCORED} {METRICS}",
    "pairwise": f"WITH {_PAIRS} SELECT * FROM pairs",
    "pairwise_summary": f"WITH {_PAIRS} SELECT pack, class, count(*) AS cases FROM pairs GROUP BY ALL",
    "changed_cases": f"WITH {_PAIRS} SELECT p.case_id, p.pack, s.input, s.suggestions FROM pairs p JOIN scored s ON s.case_id = p.case_id AND s.pack = p.pack WHERE class IN ('improvement', 'regression')",
    "false_acceptances": f"WITH {_SCORED} SELECT case_id, pack, input FROM scored WHERE task = 'accept-word' AND NOT coalesce(accepted, true) AND is_known",
    "duplicate_cases": f"""WITH {CASES.sql}, c AS (SELECT * FROM cases UNION ALL SELECT * FROM cases WHERE case_id = 'c1' UNION ALL SELECT * REPLACE ('c9' AS case_id) FROM cases WHERE case_id = 'c8')
      SELECT 'id' AS kind, case_id AS key, count(*) AS cases FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL
      SELECT 'content', task || ':' || input, count(DISTINCT case_id) FROM c GROUP BY task, input, sha256({_EXP}) HAVING count(DISTINCT case_id) > 1""",
    "ranking_eval": f"""WITH {CASES.sql}, {RESULTS.sql}, r AS (SELECT c.input, CASE WHEN c.case_id = 'c7' THEN 'exact-word-preservation' ELSE category END AS category, coalesce(b.suggestions, [])[1:5] AS bs, coalesce(e.suggestions, [])[1:5] AS es, expected
        FROM cases c LEFT JOIN results b ON b.case_id = c.case_id AND b.pack = 'seed' LEFT JOIN results e ON e.case_id = c.case_id AND e.pack = 'full'),
      k AS (SELECT *, list_min(list_filter(list_transform(expected, lambda w: list_position(bs, w)), lambda x: x > 0)) AS b, list_min(list_filter(list_transform(expected, lambda w: list_position(es, w)), lambda x: x > 0)) AS e FROM r)
      SELECT count(*) AS cases, {', '.join(f"round(count(*) FILTER ({c} <= {n}) * 100.0 / count(*), 2) AS {name}_top_{n}" for c, name in (('b', 'baseline'), ('e', 'experiment')) for n in (1, 3, 5))},
        {', '.join(f"round(avg(coalesce(1.0::DOUBLE / {c}, 0)), 4) AS {name}_mrr, count(*) FILTER (len({c}s) = 0) AS {name}_no_candidate" for c, name in (('b', 'baseline'), ('e', 'experiment')))},
        count(*) FILTER (coalesce(1.0 / e, 0) > coalesce(1.0 / b, 0)) AS improved, count(*) FILTER (coalesce(1.0 / e, 0) < coalesce(1.0 / b, 0)) AS regressed, count(*) FILTER (coalesce(1.0 / e, 0) = coalesce(1.0 / b, 0)) AS unchanged,
        count(*) FILTER (e <= 1) >= count(*) FILTER (b <= 1) AND count(*) FILTER (e <= 3) >= count(*) FILTER (b <= 3) AND count(*) FILTER (coalesce(1.0 / e, 0) < coalesce(1.0 / b, 0)) = 0
          AND count(*) FILTER (category = 'exact-word-preservation' AND NOT coalesce(e = 1 AND lower(es[1]) = lower(input), false)) = 0 AS accepted FROM k""",
    "next_word_gates": f"""WITH {NEXT_CASES.sql}, {PREDICTED.sql}, {BIGRAM_ONLY.sql}, best AS (SELECT case_id, list(next ORDER BY rank)[1:5] AS words, max(source) AS source FROM predicted GROUP BY 1),
      r AS (SELECT c.*, coalesce(b.words, []) AS words, coalesce(b.source, 'none') AS source, len(expected) > 0 AS pos,
        list_position(list_transform(coalesce(b.words, []), lambda w: list_contains(expected, w)), true) AS k, list_position(list_transform(coalesce(o.words, []), lambda w: list_contains(expected, w)), true) AS bk,
        expected_source = '' OR expected_source = coalesce(b.source, 'none') AS ok FROM next_cases c LEFT JOIN best b USING (case_id) LEFT JOIN bigram_only o USING (case_id)),
      h AS (SELECT *, nullif(k, 0) AS rk, nullif(bk, 0) AS brk FROM r),
      g AS (SELECT count(*) AS cases, count(*) FILTER (pos) AS positive, count(*) FILTER (source = 'trigram') AS trigram, count(*) FILTER (source = 'bigram-backoff') AS backoff, count(*) FILTER (source = 'none') AS none,
        {', '.join(f"round(count(*) FILTER (rk <= {n}) * 100.0 / count(*), 2) AS top_{n}, round(count(*) FILTER (pos AND rk <= {n}) * 100.0 / count(*) FILTER (pos), 2) AS positive_top_{n}" for n in (1, 3, 5))},
        round(avg(coalesce(1.0::DOUBLE / rk, 0)), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / rk, 0)) FILTER (pos), 6) AS positive_mrr, round(count(*) FILTER (ok) * 100.0 / count(*), 2) AS source_percent,
        round(count(*) FILTER (pos AND brk <= 3) * 100.0 / count(*) FILTER (pos), 2) AS baseline_top_3, count(DISTINCT category) FILTER (list_contains({evaluate.MANDATORY}, category)) = {len(evaluate.MANDATORY)} AS categories_ok,
        count(*) FILTER (len(list_intersect(words, forbidden)) > 0 AND category IN ('sentence-boundary', 'document-boundary')) = 0 AS boundaries_ok, count(*) FILTER (category = 'unknown-context' AND len(words) > 0) = 0 AS unknown_ok,
        count(*) FILTER (NOT ok) = 0 AS sources_ok, count(*) FILTER (pos AND rk <= 5) > 0 AS any_answer, (SELECT count(*) FROM ({{order}})) = 0 AS order_ok FROM h)
      SELECT * EXCLUDE (any_answer), categories_ok AND boundaries_ok AND unknown_ok AND order_ok AND sources_ok AS valid, positive > 0 AND positive_top_3 >= baseline_top_3 AND any_answer AS good,
        categories_ok AND boundaries_ok AND unknown_ok AND order_ok AND sources_ok AND positive > 0 AND positive_top_3 >= baseline_top_3 AND any_answer AS accepted FROM g""".replace("{order}", _ORDER),
    "out_of_order": f"WITH {PREDICTED.sql} {_ORDER}",
    "benchmark_audit": f"""WITH {ITEMS.sql}, {ENTRIES_SQL}, {SEED.sql}, e AS (SELECT DISTINCT expected FROM items), c AS (SELECT (SELECT count(*) FROM items) AS size, (SELECT count(DISTINCT input) FROM items) AS unique_inputs, count(*) AS unique_expected,
        count(*) FILTER (lower(expected) IN (SELECT normalized FROM entries)) AS expected_in_imported, count(*) FILTER (lower(expected) IN (SELECT normalized FROM seed)) AS expected_in_seed,
        count(*) FILTER (lower(expected) NOT IN (SELECT normalized FROM entries) AND lower(expected) NOT IN (SELECT normalized FROM seed)) AS expected_in_neither FROM e)
      SELECT *, array_to_string(list_filter([CASE WHEN size < 50 THEN 'SMALL_SAMPLE' END, CASE WHEN expected_in_seed = unique_expected THEN 'ALL_EXPECTED_IN_SEED' END, CASE WHEN unique_inputs < size THEN 'DUPLICATE_INPUTS' END], lambda x: x IS NOT NULL), ',') AS weaknesses FROM c""",
    "case_overlap": f"""WITH {CASES.sql}, {ENTRIES_SQL}, {SEED.sql}, t AS (SELECT DISTINCT unnest({P.SQL_WORDS}) AS word FROM documents), sets AS (SELECT (SELECT list(normalized) FROM seed) AS seed_, (SELECT list(DISTINCT normalized) FROM entries) AS imported_, (SELECT list(word) FROM t) AS train_)
      SELECT case_id, {', '.join(f"list_contains({n}_, lower(input)) AS input_in_{n}, len(list_filter(expected, lambda w: list_contains({n}_, lower(w)))) > 0 AS expected_in_{n}" for n in ('seed', 'imported', 'train'))},
        NULL::BOOLEAN AS input_in_held_out, NULL::BOOLEAN AS expected_in_held_out FROM cases, sets""",
    "case_validate": f"""WITH {CASES.sql} SELECT case_id, CASE WHEN coalesce(input, '') = '' THEN 'EMPTY_INPUT' WHEN regexp_matches(input, '\\p{{Cc}}') THEN 'CONTROL_CHARACTER' WHEN input <> nfc_normalize(input) THEN 'NOT_COMPOSED'
      WHEN NOT ({' OR '.join(f"(task = '{t}' AND category IN ({', '.join(map(repr, c))}))" for t, c in evaluate.CATEGORIES.items())}) THEN 'TASK_CATEGORY' WHEN len(list_intersect(expected, forbidden)) > 0 THEN 'EXPECTED_AND_FORBIDDEN'
      WHEN len(list_distinct(expected)) < len(expected) THEN 'DUPLICATE_CANDIDATE' WHEN task = 'accept-word' AND accepted IS NULL AND preserve_exact IS NULL THEN 'NO_EXPECTATION'
      WHEN review_status = 'draft' AND (reviewer_id IS NOT NULL OR review_date IS NOT NULL) THEN 'DRAFT_WITH_REVIEW' WHEN review_status <> 'draft' AND NOT coalesce({_REVIEWER('reviewer_id')}, false) THEN 'REVIEWER'
      WHEN review_status <> 'draft' AND NOT coalesce({_STRICT('review_date')}, false) THEN 'REVIEW_DATE' END AS problem FROM cases""",
    "checks": f"""WITH {CHECKED.sql} SELECT value, coalesce(regexp_matches(value, '^\\d{{1,4}}-\\d{{1,2}}-\\d{{1,2}}$') AND try_strptime(value, '%Y-%m-%d') IS NOT NULL AND year(try_strptime(value, '%Y-%m-%d')) BETWEEN 2000 AND 2100, false) AS review_date,
      coalesce({_STRICT('value')}, false) AS strict_date, {_REVIEWER('value')} AS reviewer, regexp_matches(value, '^[0-9a-fA-F]{{40}}$') AS commit,
      NOT regexp_matches(value, '^$|^/|\\\\|^[A-Za-z]:|(^|/)\\.{{0,2}}(/|$)') AS safe_path FROM checked""",
    "next_word_eval": f"""WITH cases AS (SELECT DISTINCT previous_2, previous_1, next AS expected FROM ({_BENCH_RUNS})), pairs AS (SELECT DISTINCT previous_2, previous_1 FROM cases), p AS ({L.BACKOFF}),
      r AS (SELECT c.previous_2, c.previous_1, c.expected, min(rank) FILTER (next = expected) AS rank, max(prediction_source) AS source FROM cases c LEFT JOIN p ON p.previous_2 = c.previous_2 AND p.previous_1 = c.previous_1 GROUP BY 1, 2, 3)
      SELECT count(*) AS cases, count(*) FILTER (rank <= 1) AS top_1, count(*) FILTER (rank <= 3) AS top_3, count(*) FILTER (rank <= 5) AS top_5, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr,
        count(*) FILTER (source = 'trigram') AS trigram, count(*) FILTER (source = 'bigram-backoff') AS backoff, count(*) FILTER (source IS NULL) AS "none" FROM r""",
    "contradictions": f"WITH {CASES.sql} SELECT task, input, count(*) AS cases, count(DISTINCT sha256({_EXP})) AS expectations FROM cases GROUP BY task, input HAVING count(*) > 1",
    "transition": f"""WITH {SNAPSHOTS.sql} SELECT coalesce(b.case_id, c.case_id) AS case_id, CASE WHEN b.review_status = 'human-reviewed' AND c.case_id IS NULL THEN 'reviewed_removed' WHEN b.review_status = 'human-reviewed' AND c.review_status = 'draft' THEN 'reviewed_downgraded'
      WHEN b.review_status = 'human-reviewed' AND b.content <> c.content THEN 'reviewed_modified' WHEN c.review_status = 'human-reviewed' AND b.case_id IS NULL THEN 'reviewed_without_draft' WHEN c.review_status = 'human-reviewed' AND b.review_status = 'draft' THEN CASE WHEN b.content = c.content THEN 'promoted' ELSE 'promoted_with_changes' END
      WHEN b.case_id IS NULL THEN 'draft_added' WHEN c.case_id IS NULL THEN 'draft_removed' ELSE 'kept' END AS outcome FROM (SELECT * FROM snapshots WHERE side = 'b') b FULL JOIN (SELECT * FROM snapshots WHERE side = 'c') c ON b.case_id = c.case_id""",
    "case_provenance": P.ORACLE["partition_docs"].split("SELECT CASE")[0].replace("AS g FROM docs", "AS g, text FROM docs")
    + f""", w AS (SELECT DISTINCT CASE WHEN {P.PARTITION} < 80 THEN 'train' WHEN {P.PARTITION} < 90 THEN 'development' ELSE 'evaluation' END AS p, unnest({P.SQL_WORDS}) AS word FROM keyed), ask AS (SELECT DISTINCT unnest({P.SQL_WORDS}) AS word FROM benchmark)
      SELECT word, """ + ", ".join(f"word IN (SELECT word FROM w WHERE p = '{p}') AS in_{p}" for p in ("train", "development", "evaluation")) + " FROM ask",
}
