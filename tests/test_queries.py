import pytest
from pyspark.sql import functions as F

import oracle
from textlex import plans
from textlex.operators import corpus, evaluate, frequency, lexicon, ngrams, predict, search
from textlex.plans import documents, pipelines, reviews
from textlex.plans.inline import ASKED, ENTRIES, SEED

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(plans.QUERIES[name](spark, SMALL), plans.ORACLE[name], SMALL) == ""


@pytest.mark.parametrize("name", ["word_frequency", "bigram_topk", "partition_docs"])
def test_partitions_do_not_matter(spark, name):
    want = sorted(map(repr, plans.QUERIES[name](spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(repr, plans.QUERIES[name](spark, SMALL).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_normal_forms_of_all_words(spark):
    words = [r.word for r in documents.freq(spark, SMALL).collect()]
    assert any("ß" in w for w in words) and any(w.isascii() for w in words)
    lower = [w.upper().lower() for w in words]
    want = sorted((w.upper(), n, n.translate(str.maketrans("îûşçê", "iusce")), n) for w, n in zip(words, lower))
    assert sorted(map(tuple, plans.QUERIES["normal_forms_all"](spark, SMALL).collect())) == want


def test_leakage(spark):
    assert plans.QUERIES["partition_leakage"](spark, SMALL).count() == 0


def test_edit_candidates_miss_nothing(spark):
    from textlex.functions.distance import quarters

    lex = SEED.frame(spark)
    q = search.prepared(ASKED.frame(spark))
    got = {(r.query, r.word, r.quarters) for r in search.edit_matches(q, lex).collect()}
    plain = lambda w: w.lower().translate(str.maketrans("îûşçê", "iusce"))
    want = set()
    for a in ASKED.rows:
        for e in SEED.rows:
            x, y = a[0].lower(), e[2]
            if abs(len(x) - len(y)) <= 2 and quarters(x, y) <= 8 and (plain(x) != plain(y) or x == y):
                want.add((a[0], e[1], quarters(x, y)))
    assert got == want


def test_suggestions(spark):
    rows = search.suggest(ASKED.frame(spark), SEED.frame(spark), 10).collect()
    first = {r.query: (r.text, r.kind) for r in rows if r.rank == 1}
    assert first["malb"] == ("malbat", "Completion") and first["deri"][0] == "derî" and first["hek"][0] == "hêk" and first["MALBAT"] == ("malbat", "Exact")
    texts = {}
    for r in rows:
        texts.setdefault(r.query, []).append(r.text)
        assert 0.01 <= r.score <= 0.99
    assert "kevir" in texts["kevri"] and "nan" in texts["nann"] and "xyzzyword42" not in texts
    assert search.clamp_limit(0) == 0 and search.clamp_limit(100) == 50 and search.clamp_limit() == 5
    assert search.suggest(ASKED.frame(spark), SEED.frame(spark), 0).count() == 0


def test_probability_and_backoff(spark):
    docs = spark.createDataFrame([("c", "1", "a b c. a b d. a b c. b x. b x. b x.")], "corpus_id string, document_id string, text string")
    bi, tri = ngrams.model(docs, 2), ngrams.model(docs, 3)
    assert {(r.previous, r.next, r["count"], r.context_count, r.probability_millionths) for r in bi.collect()} == {("a", "b", 3, 3, 1000000), ("b", "c", 2, 6, 333333), ("b", "x", 3, 6, 500000)}
    asked = spark.createDataFrame([("a", "b"), ("z", "b"), ("y", "z")], "previous_2 string, previous_1 string")
    got = [(r.previous_2, r.next, r.prediction_source) for r in predict.with_backoff(asked, bi, tri).orderBy("previous_2", "rank").collect()]
    assert got == [("a", "c", "trigram"), ("z", "x", "bigram-backoff"), ("z", "c", "bigram-backoff")]
    assert ngrams.violations(bi, 2).count() == 0


def test_merge_and_build(spark):
    rows = {r.normalized: r for r in lexicon.merge(ENTRIES.frame(spark)).collect()}
    assert rows["sêvik"].word == "sêvik" and rows["sêvik"].frequency == 840 and rows["sêvik"].sources == ["manual-seed", "wiktionary"]
    assert rows["amed"].word == "Amed" and rows["amed"].frequency == 90
    built = pipelines.build_lexicon(ENTRIES.frame(spark), documents.freq(spark, SMALL))
    assert {"", "x1"}.isdisjoint({r.normalized for r in built.collect()})


def test_empty_documents(spark):
    none = spark.createDataFrame([], "corpus_id string, document_id string, text string, lang string")
    for out in (frequency.word_frequencies(none), ngrams.model(none, 2), corpus.inventory(none), corpus.partition_documents(none), corpus.document_duplicates(none)):
        assert out.count() == 0
    nulls = spark.createDataFrame([("a", "1", None, None), ("a", "2", "", None)], none.schema)
    assert frequency.word_frequencies(nulls).count() == 0 and corpus.partition_documents(nulls).count() == 2


def test_seed_pack_and_validation(spark):
    assert {r.population for r in reviews.pack(spark, "seed").collect()} == {"manual_seed"}
    groups = {r.normalized: r.group_id for r in reviews.groups(spark).collect()}
    of = lambda name: {(r.normalized, r.display, r.population) for r in reviews.pack(spark, name).filter("population <> 'manual_seed'").collect()}
    assert of("reviewed") == {("lîstin", "lîstin", "external_approved"), ("hirçan", "Hirçan", "external_approved_metadata_change"), ("ac-dc", "AC-DC", "external_approved_metadata_change"), ("sêvik", "sêvik", "external_approved_metadata_change")}
    full = {(n, p) for n, _, p in of("experimental-full")}
    assert {("hêk", "external_experimental_only"), ("stêr", "external_unreviewed"), ("derî", "external_unreviewed"), ("lîstin", "external_approved")} <= full and not any(n == "masî" for n, _ in full) and set(groups) == {"lîstin", "derî", "hirç", "hêk", "masî", "stêr"}
    got = {r.case_id: r.problem for r in reviews.CASES.frame(spark).select("case_id", evaluate.case_problem().alias("problem")).collect()}
    assert got == {"c1": None, "c2": "REVIEWER", "c3": None, "c4": "DRAFT_WITH_REVIEW", "c5": "REVIEW_DATE", "c6": "TASK_CATEGORY", "c7": None, "c8": None}
    built = pipelines.build_pack("experimental-full", reviews.seed(spark), reviews.entries(spark), reviews.valid_decisions(spark)).collect()
    assert len(built) > 24 and [(r.normalized, r.display) for r in built] == sorted((r.normalized, r.display) for r in built)


def test_group_decisions_must_fit(spark):
    from textlex.operators import review

    d = reviews.valid_decisions(spark)
    decided = review.effective_status(reviews.entries(spark), d)
    for wrong in (d.withColumn("resolution", F.lit(None).cast("string")), d.withColumn("selected_entry_id", F.lit("none"))):
        with pytest.raises(Exception, match="unresolved conflict group"):
            review.select_pack("reviewed", reviews.seed(spark), decided, reviews.groups(spark), wrong).collect()


def test_compare_packs(spark):
    """The packs' own answers, against suggestions over a plain list of each pack's words."""
    got = {(r.case_id, r.pack): r["class"] for r in plans.QUERIES["compare_packs"](spark, SMALL).collect()}
    assert set(p for _, p in got) == {"reviewed", "experimental-full"} and len(got) == 16
    results = {(r.case_id, r.pack): r for r in evaluate.pack_results(reviews.CASES.frame(spark), {n: reviews.pack_lexicon(spark, n) for n in ("seed", "experimental-full")}).collect()}
    for case in reviews.CASES.frame(spark).collect():
        for name in ("seed", "experimental-full"):
            words = reviews.pack_lexicon(spark, name)
            one = spark.createDataFrame([(case.input,)], "query string")
            assert results[case.case_id, name].suggestions == [r.text for r in search.suggest(one, words, 10).orderBy("rank").collect()]
    assert results["c1", "seed"].is_known and not results["c2", "seed"].is_known


def test_ranking_and_impact(spark):
    row = plans.QUERIES["lexicon_impact"](spark, SMALL).first()
    assert (row.entries, row["items"], row.known_percent, row.top_1_percent, row.top_5_percent) == (24, 7, 85.71, 85.71, 85.71) and row.completion_percent == 85.71
    r = plans.QUERIES["ranking_search"](spark, SMALL).first()
    assert r.cases == 8 and r.improved + r.regressed + r.unchanged == 8 and r.experiment_top_1 >= r.baseline_top_1


def test_roll_up(spark):
    from textlex.operators import audit
    from textlex.plans import lexical

    row = pipelines.audit_lexicon(documents_records(spark), lexical.parsed(spark), reviews.seed(spark), reviews.ITEMS.frame(spark))["roll_up"].first()
    assert row.records == 22 and row.shapes["total"] == 22 and row.cross_check.conflict_groups == 6 and row.benchmark.size == 7
    assert row.suspicious == audit.suspicious(documents_records(spark)).count() and sum(row.rejections.values()) == 2
    ordered = audit.suspicious(documents_records(spark)).orderBy(*audit.suspicious_order()).collect()
    assert [(r.category, r.normalized, r.line_num) for r in ordered] == sorted((r.category, r.normalized, r.line_num) for r in ordered)


def documents_records(spark):
    from textlex.plans.inline import RECORDS

    return RECORDS.frame(spark)


def test_orders(spark):
    parts = plans.QUERIES["partition_docs"](spark, SMALL).orderBy(*corpus.partition_order()).collect()
    assert [(r.corpus_id, r.document_id) for r in parts] == sorted((r.corpus_id, r.document_id) for r in parts)
    from textlex.operators import review

    rows = [(r.normalized, r.display, r.source_id, r.source_revision, r.target_id) for r in reviews.QUEUED.frame(spark).orderBy(*review.queue_order()).collect()]
    assert rows == sorted(rows)
    words = evaluate.vocabulary(spark.createDataFrame([("a",), ("b",)], "word string"), spark.createDataFrame([("b",), ("c",)], "word string"))
    assert sorted(r.word for r in words.collect()) == ["a", "b", "c"]


def test_queue_routing(spark):
    got = {(r.queue, r.normalized) for r in reviews.queue_rows(spark).collect()}
    assert ("capitalization-anomalies", "ac/dc") in got and any(q == "parser-rejections" for q, _ in got) and ("hunspell-only", "derî") not in got and ("hunspell-only", "lîstin") in got
