import random

import numpy as np
import pytest

from textlex import api
from textlex.functions import distance
from textlex.functions import text as T
from textlex.operators import search
from textlex.plans import documents
from textlex.plans.inline import SEED

SMALL = "/root/testdata/sf0.001"


def test_lexicon(spark):
    lex = api.Lexicon(SEED.frame(spark))
    assert len(lex) == 24 and {r.query: r.known for r in lex.contains(["mal", "MAL", "zzz"]).collect()} == {"mal": True, "MAL": True, "zzz": False}
    assert [r.text for r in lex.suggest(["deri"]).collect()][0] == "derî" and lex.suggest(["deri"], 0).count() == 0
    assert {r.kind for r in lex.complete(["malb"], kinds=["Completion"]).collect()} == {"Completion"}
    with pytest.raises(ValueError):
        api.Lexicon(SEED.frame(spark).drop("word"))


def test_model(spark, tmp_path):
    docs = spark.createDataFrame([("a b c. a b d. a b c. b x. b x. b x.",)], "text string")
    words = spark.createDataFrame([(w, w, 1, 1, 1) for w in "abcdx"], "word string, normalized string, token_count bigint, document_count bigint, zipf_milli bigint")
    model = api.TextModel.from_documents(api.Lexicon(words), docs)
    got = {tuple(r.context): (r.next, r.prediction_source) for r in model.predict_next([[], ["b"], ["a", "b"], ["q", "a", "b"], ["z", "b"], ["z", "z"]]).filter("rank = 1").collect()}
    assert got == {("b",): ("x", "bigram"), ("a", "b"): ("c", "trigram"), ("q", "a", "b"): ("c", "trigram"), ("z", "b"): ("x", "bigram-backoff")}


def test_sql_functions(spark):
    api.register(spark)
    docs = documents.docs(spark, SMALL).filter("text is not null")
    docs.createOrReplaceTempView("some_documents")
    rows = spark.sql("select text, tl_nfc(text) as n, tl_tokens(text) as t, tl_sentences(text) as s from some_documents").collect()
    want = docs.select("text", T.nfc(docs.text).alias("n"), T.tokens(docs.text).alias("t"), T.sentences(docs.text).alias("s")).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert spark.sql("select tl_distance_quarters('deri', 'derî') as q").first().q == 1


def test_distances_of_many_pairs():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeêişsrtnxq") for _ in range(rng.randrange(9))) for _ in range(300)] + ["", "a" * 70]
    a, b = words, words[::-1]
    assert distance.quarters_of(a, b).tolist() == [distance.quarters(x, y) for x, y in zip(a, b)]
    assert distance.distance_quarters.func(__import__("pandas").Series(a), __import__("pandas").Series(b)).tolist() == [distance.quarters(x, y) for x, y in zip(a, b)]
    assert distance.quarters_of([], []).tolist() == [] and isinstance(distance.quarters_of(["a"], ["b"]), np.ndarray)


def test_long_words_are_matched(spark):
    rng = random.Random(4)
    letters = "aeêişsrtnxq"
    base = ["".join(rng.choice(letters) for _ in range(n)) for n in (14, 15, 16, 17, 18, 19, 25, 40, 64, 300, 3000) for _ in range(6)]

    def edited(w):
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) - 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
        return w

    asked = [(edited(w),) for w in base] + [(w,) for w in base[::5]]
    lex = spark.createDataFrame([(w, w, 1, 1, 1) for w in sorted(set(base))], "word string, normalized string, token_count bigint, document_count bigint, zipf_milli bigint")
    got = {(r.query, r.word) for r in search.edit_matches(search.prepared(spark.createDataFrame(asked, "query string")), lex).select("query", "word").collect()}
    plain = lambda w: w.translate(str.maketrans("îûşçê", "iusce"))
    want = {(a, w) for (a,) in asked for w in set(base) if abs(len(a) - len(w)) <= 2 and (plain(a) != plain(w) or a == w) and distance.quarters(a, w) <= 8}
    assert got == want
