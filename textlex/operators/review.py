"""Review queues, decisions and pack selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import ids
from textlex.functions import text as T

SHORT, LONG = 1, 25
#: Ways in which an approved decision resolves a conflict group.
RESOLUTIONS = ["select_member", "replace_group"]
#: Populations of a pack in order of precedence.
POPULATIONS = ["manual_seed", "seed_metadata_change", "external_approved_metadata_change", "external_approved", "external_experimental_only", "external_unreviewed"]
SELECTED = {
    "seed": {},
    "reviewed": {"approved": "external_approved", "approved_with_metadata_change": "external_approved_metadata_change"},
    "experimental-full": {
        "approved": "external_approved",
        "approved_with_metadata_change": "external_approved_metadata_change",
        "experimental_only": "external_experimental_only",
        "unreviewed": "external_unreviewed",
    },
}


def with_entry_id(entries: DataFrame, source: str, revision: str) -> DataFrame:
    return entries.withColumn("entry_id", ids.entry_id(F.lit(source), F.lit(revision), F.col("word"), F.col("normalized"), F.col("flags"), F.col("morphology")))


def conflict_groups(entries: DataFrame) -> DataFrame:
    """Normalized forms with entries that differ: group_id, members by id, and the fields in which one differs from the first."""
    first = W.partitionBy("normalized").orderBy("line_num").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    names = ["word", "flags", "morphology", "part_of_speech"]
    differ = F.array_compact(F.array(*[F.when(F.col(c) != F.first(c).over(first), F.lit(c)) for c in names]))
    rows = entries.withColumn("differing", differ)
    groups = rows.groupBy("normalized").agg(F.array_sort(F.collect_set("entry_id")).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("differing")))).alias("differing_fields"))
    return groups.filter(F.size("differing_fields") > 0).select(ids.group_id(F.col("normalized"), F.col("members")).alias("group_id"), "normalized", "members", "differing_fields")


def queues(entries: DataFrame, seed: DataFrame, rare: DataFrame, suspicious: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """A row for each queue an entry belongs to: queue, target_id, normalized, rule_id."""
    s = T.shape(F.col("word"), F.col("normalized"))
    script = T.script_class(F.col("word"))
    n = T.graphemes(F.col("normalized"))
    none = s["punctuation_only"] | s["symbol_only"] | s["digit_only"]
    chars = entries.select("entry_id", F.explode(F.array_distinct(F.split("normalized", ""))).alias("char"))
    has_rare = chars.join(rare.select("char").distinct(), "char").select("entry_id").distinct().withColumn("rare", F.lit(True))
    rows = entries.join(has_rare, "entry_id", "left")
    rows = rows.join(suspicious.select("word", "normalized").distinct().withColumn("suspicious", F.lit(True)), ["word", "normalized"], "left")
    rows = rows.join(seed.select("normalized").distinct().withColumn("seeded", F.lit(True)), "normalized", "left")
    rules = {
        "suspicious-entries": ("SUSPICIOUS_ENTRY", F.col("suspicious")),
        "unusual-scripts": ("UNUSUAL_SCRIPT", script.rlike("^(ARABIC_ONLY|CYRILLIC_ONLY|OTHER_SINGLE)")),
        "mixed-scripts": ("MIXED_SCRIPT", script.contains("MIXED")),
        "punctuation-only": ("PUNCTUATION_ONLY", s["punctuation_only"]),
        "symbol-only": ("SYMBOL_ONLY", s["symbol_only"]),
        "digit-only": ("DIGIT_ONLY", s["digit_only"]),
        "no-letter": ("NO_LETTER", s["no_letters"] & ~none),
        "capitalization-anomalies": ("CAPITALIZATION_ANOMALY", s["uppercase_only"] | s["mixed_case"]),
        "multiword-entries": ("MULTIWORD_ENTRY", s["multiword"]),
        "rare-code-points": ("RARE_CODE_POINT", F.col("rare")),
        "short-and-long-forms": ("SHORT_AND_LONG_FORM", (n <= SHORT) | (n >= LONG)),
        "hunspell-only": ("HUNSPELL_ONLY", F.col("seeded").isNull()),
    }
    hits = F.array(*[F.when(test, F.struct(F.lit(q).alias("queue"), F.lit(f"{rule}_V1").alias("rule_id"))) for q, (rule, test) in rules.items()])
    out = rows.select(F.col("entry_id").alias("target_id"), "normalized", F.explode(F.array_compact(hits)).alias("h")).select("h.queue", "target_id", "normalized", "h.rule_id")
    if rejected is not None:
        out = out.unionByName(rejected.select(F.lit("parser-rejections").alias("queue"), F.concat(F.lit("line:"), F.col("line_num")).alias("target_id"), F.col("line").alias("normalized"), F.lit("PARSER_REJECTION_V1").alias("rule_id")))
    return out


def decision_problem() -> Column:
    """Why a decision isn't valid, or null. Columns: schema_version, target_type, target_id, source_id, review_status, reviewer_id,
    review_date, review_notes, evidence, new_display, new_normalized, resolution."""
    blank = lambda c: T.trim_space(F.coalesce(F.col(c), F.lit(""))) == ""
    status, has_new = F.col("review_status"), F.col("new_display").isNotNull()
    group = F.col("target_type") == "conflict_group"
    changed = status == "approved_with_metadata_change"
    return (
        F.when(F.col("schema_version") != ids.DECISION_VERSION, "SCHEMA_VERSION")
        .when(blank("target_id"), "TARGET_ID")
        .when(blank("source_id"), "SOURCE_ID")
        .when((status == "unreviewed") & (F.col("reviewer_id").isNotNull() | F.col("review_date").isNotNull() | F.col("review_notes").isNotNull() | has_new), "UNREVIEWED_WITH_REVIEW")
        .when((status != "unreviewed") & blank("reviewer_id"), "REVIEWER")
        .when((status != "unreviewed") & ~F.coalesce(ids.review_date_ok(F.col("review_date")), F.lit(False)), "REVIEW_DATE")
        .when(group & changed, "GROUP_METADATA_CHANGE")
        .when(group & has_new, "GROUP_REPLACEMENT")
        .when(group & (status == "approved") & F.col("resolution").isNull(), "GROUP_RESOLUTION")
        .when(~changed & has_new, "REPLACEMENT_NOT_ALLOWED")
        .when(changed & blank("new_display"), "REPLACEMENT_MISSING")
        .when(changed & ~F.col("new_normalized").eqNullSafe(T.normalize_text(F.col("new_display"))), "REPLACEMENT_NORMALIZED")
        .when((status == "rejected_from_default_pack") & blank("review_notes") & (F.size("evidence") == 0), "REJECTION_REASON")
    )


def effective_status(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries with the status of their decision, unreviewed without one."""
    d = decisions.filter("target_type = 'entry'").select(F.col("target_id").alias("entry_id"), "review_status", "new_display", "new_normalized")
    return entries.join(d, "entry_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))


def orphans(decisions: DataFrame, entries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Decisions whose target is no entry, or no conflict group."""
    targets = entries.select(F.lit("entry").alias("target_type"), F.col("entry_id").alias("target_id"))
    if groups is not None:
        targets = targets.unionByName(groups.select(F.lit("conflict_group").alias("target_type"), F.col("group_id").alias("target_id")))
    return decisions.join(targets.distinct(), ["target_type", "target_id"], "left_anti").select("target_id", "review_status")


def status_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("review_status").agg(F.count(F.lit(1)).alias("entries"))


def conflict_members(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """The members of each conflict group with their lines: group_id, normalized, entry_id, display, source_lines, flags, part_of_speech."""
    lines = entries.groupBy("entry_id").agg(F.array_sort(F.collect_set("line_num")).alias("source_lines"), F.min(F.struct("line_num", "word", "flags", "part_of_speech")).alias("e"))
    each = groups.select("group_id", "normalized", F.explode("members").alias("entry_id")).join(lines, "entry_id")
    return each.select("group_id", "normalized", "entry_id", F.col("e.word").alias("display"), "source_lines", "e.flags", "e.part_of_speech")


def unchanged_metadata(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Metadata changes that change nothing of their entry: target_id. A field that isn't given changes nothing."""
    same = lambda given, own: F.col(given).isNull() | F.col(given).eqNullSafe(F.col(own))
    changes = decisions.filter((F.col("review_status") == "approved_with_metadata_change") & (F.col("target_type") == "entry"))
    own = entries.select(F.col("entry_id").alias("target_id"), "word", "flags", "morphology", "part_of_speech").dropDuplicates(["target_id"])
    both = changes.join(own, "target_id")
    return both.filter((F.col("new_display") == F.col("word")) & same("new_flags", "flags") & same("new_morphology", "morphology") & same("new_part_of_speech", "part_of_speech")).select("target_id").distinct()


def _of_groups(pack: str, entries: DataFrame, groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates from conflict groups, which only a decision on the group decides.

    Approved: the member selected, or what replaces the group. Experimental or undecided: all members, in the experimental pack only.
    """
    d = decisions.filter("target_type = 'conflict_group'").select(F.col("target_id").alias("group_id"), "review_status", "resolution", "selected_entry_id", "resolution_display", "resolution_normalized")
    of = groups.join(d, "group_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))
    approved, select = F.col("review_status") == "approved", F.col("resolution") == "select_member"
    wrong = approved & (F.col("resolution").isNull() | (select & ~F.coalesce(F.array_contains("members", F.col("selected_entry_id")), F.lit(False))))
    checked = of.withColumn("review_status", F.when(wrong, F.raise_error(F.concat(F.lit("unresolved conflict group "), F.col("group_id")))).otherwise(F.col("review_status")))
    first = entries.groupBy("entry_id").agg(F.min(F.struct("line_num", "word")).alias("e"))
    members = checked.select("group_id", "review_status", "resolution", "selected_entry_id", F.explode("members").alias("entry_id")).join(first, "entry_id")
    population = F.when((F.col("review_status") == "approved") & (F.col("resolution") == "select_member") & (F.col("entry_id") == F.col("selected_entry_id")), "external_approved")
    if pack == "experimental-full":
        population = population.when(F.col("review_status") == "experimental_only", "external_experimental_only").when(F.col("review_status") == "unreviewed", "external_unreviewed")
    picked = members.withColumn("population", population).filter("population is not null")
    out = picked.select("entry_id", F.col("e.word").alias("display"), T.normalize_text(F.col("e.word")).alias("normalized"), "population", F.col("e.line_num").alias("source_line"))
    replaced = checked.filter(approved & (F.col("resolution") == "replace_group"))
    return out.unionByName(replaced.select(F.col("group_id").alias("entry_id"), F.col("resolution_display").alias("display"), F.col("resolution_normalized").alias("normalized"), F.lit("external_approved_metadata_change").alias("population"), F.lit(None).cast("long").alias("source_line")))


def select_pack(pack: str, seed: DataFrame, decided: DataFrame, groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates of a pack: seed rows, entries outside conflict groups by their status, and what the groups' decisions give."""
    out = seed.select(F.concat(F.lit("seed:"), F.col("normalized")).alias("entry_id"), F.col("word").alias("display"), "normalized", F.lit("manual_seed").alias("population"), F.lit(None).cast("long").alias("source_line"))
    if pack == "seed":
        return out
    population = F.lit(None).cast("string")
    for status, name in SELECTED[pack].items():
        population = F.when(F.col("review_status") == status, name).otherwise(population)
    changed = F.col("review_status") == "approved_with_metadata_change"
    members = groups.select(F.explode("members").alias("entry_id")).distinct()
    first = W.partitionBy("entry_id").orderBy("line_num")  # lines that repeat are one entry
    single = decided.join(members, "entry_id", "left_anti").withColumn("k", F.row_number().over(first)).filter("k = 1")
    single = single.withColumn("population", population).filter("population is not null")
    single = single.select("entry_id", F.when(changed, F.col("new_display")).otherwise(F.col("word")).alias("display"), F.when(changed, F.col("new_normalized")).otherwise(F.col("normalized")).alias("normalized"), "population", F.col("line_num").alias("source_line"))
    return out.unionByName(single).unionByName(_of_groups(pack, decided, groups, decisions))


def selection_counts(pack: str, candidates: DataFrame, decided: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: candidates of each population, entries that their status keeps out, and candidates lost to others."""
    outside = decided.select("entry_id").distinct().join(candidates.select("entry_id").distinct(), "entry_id", "left_anti").agg(F.count(F.lit(1)).alias("excluded_by_status"))
    lost = resolved.agg(F.coalesce(F.sum("competing"), F.lit(0)).alias("discarded_by_collision"), F.count(F.lit(1)).alias("final_entries"))
    counts = candidates.agg(*[F.count_if(F.col("population") == x).alias(x) for x in POPULATIONS])
    return counts.select(F.lit(pack).alias("pack"), "*", *[t.select(c).scalar().alias(c) for t, c in ((outside, "excluded_by_status"), (lost, "discarded_by_collision"), (lost, "final_entries"))])


def queue_order() -> list:
    """Sort keys of a queue's entries."""
    return [F.col(c) for c in ("normalized", "display", "source_id", "source_revision", "target_id")]


def latest_targets(rows: DataFrame, order: str = "position") -> DataFrame:
    """Of several queue rows of a target (target_type, target_id) the last one."""
    last = W.partitionBy("target_type", "target_id").orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def resolve_collisions(candidates: DataFrame) -> DataFrame:
    """The candidate of each normalized form that stays, how many it stood against, and whether the next had the same precedence."""
    rank = F.array_position(F.array(*map(F.lit, POPULATIONS)), F.col("population"))
    order = W.partitionBy("normalized").orderBy("rank", F.asc_nulls_first("source_line"), "display", "entry_id")
    rows = candidates.withColumn("rank", rank).withColumns({"k": F.row_number().over(order), "next": F.lead("rank").over(order), "competing": F.count(F.lit(1)).over(W.partitionBy("normalized")) - 1})
    return rows.filter("k = 1").select("normalized", "display", "entry_id", "population", "competing", F.coalesce(F.col("next") == F.col("rank"), F.lit(False)).alias("tied"))
