import itertools
import random

import pytest
from pyspark.sql import functions as F

from textlex.functions import distance, ids
from textlex.functions import text as T


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(
    "given, want",
    [("Hello!", ["hello"]), ("year 2031", ["year"]), ("42", []), ("d'eau", ["d", "eau"]), ("semi-dry", ["semi", "dry"]), ("çem, kevir!", ["çem", "kevir"]), ("e\u0301t\u00e9", ["été"]),
     ("write to me@shop.example or http://shop.example/a_b", ["write", "to", "me", "shop", "example", "or", "http", "shop", "example", "a", "b"]), ("", [])],
)
def test_tokens(spark, given, want):
    assert one(spark, T.tokens, given) == want


@pytest.mark.parametrize("given, want", [("It rains... Will it stop?", ["It rains...", "Will it stop?"]), ("?! It rains.", ["It rains."]), ("It rains; it stops", ["It rains; it stops"]), ("a\nb", ["a\nb"]), ("", [])])
def test_sentences(spark, given, want):
    assert one(spark, T.sentences, given) == want


def test_normal_forms(spark):
    assert one(spark, T.normalize, "ŞÛŞE") == "şûşe"
    assert one(spark, T.strip_diacritics, "şûşe derî çem hêk é") == "suse deri cem hek é"
    assert one(spark, T.normalize_text, "mal​bat") == "malbat"
    assert one(spark, T.nfc, None) is None
    assert one(spark, T.document_key, "a \r\nb\t\r\r\n\n") == "a\nb"
    assert one(spark, T.graphemes, "é") == 1


@pytest.mark.parametrize("word, want", [("abc123", "LATIN_ONLY"), ("سلام", "ARABIC_ONLY"), ("мир", "CYRILLIC_ONLY"), ("aسb", "LATIN_ARABIC_MIXED"), ("ελ", "OTHER_SINGLE_SCRIPT:Greek"), ("ελܐ", "OTHER_MIXED_SCRIPT"), ("12", "NO_SCRIPTED_LETTERS")])
def test_script_class(spark, word, want):
    assert one(spark, T.script_class, word) == want


def test_shape(spark):
    flags = lambda w: {k for k, v in spark.createDataFrame([(w, w.lower())], "a string, b string").select(*[c.alias(k) for k, c in T.shape(F.col("a"), F.col("b")).items() if "length" not in k]).first().asDict().items() if v}
    assert {"punctuation_only", "no_letters"} <= flags("!")
    assert "symbol_only" in flags("$") and "digit_only" in flags("123") and "no_letters" in flags("123!")
    assert "uppercase_only" in flags("ABC") and "title_case" in flags("Malbat") and "title_case" not in flags("A中")


def test_distance():
    q = distance.quarters
    assert [q("deri", "derî"), q("suşe", "şuşe"), q("r", "t"), q("a", "s"), q("kveir", "kevir"), q("", "ab"), q("z", "s")] == [1, 1, 3, 3, 3, 8, 4]
    rng = random.Random(1)
    words = ["".join(rng.choice("aeişsrtn") for _ in range(rng.randrange(6))) for _ in range(60)]
    for a, b in itertools.combinations(words, 2):
        assert q(a, b) == q(b, a) and (q(a, b) == 0) == (a == b)


def test_edit_cost(spark):
    got = spark.createDataFrame([(q,) for q in range(9)], "q int").select(distance.edit_cost(F.col("q"))).collect()
    assert [r[0] for r in got] == [0, 3, 5, 8, 10, 13, 15, 18, 20]


def test_checks(spark):
    ok = lambda f, v: bool(one(spark, f, v))
    assert ok(ids.review_date_ok, "2026-7-2") and not ok(ids.review_date_ok, "2026-02-30") and not ok(ids.review_date_ok, "1999-01-01")
    assert ok(ids.strict_date_ok, "0001-01-01") and ok(ids.strict_date_ok, "2024-02-29") and not ok(ids.strict_date_ok, "2023-02-29") and not ok(ids.strict_date_ok, "2024-2-9")
    assert ok(ids.reviewer_ok, "anna-b") and not any(ok(ids.reviewer_ok, v) for v in ("an", "a--b", "bot-1", "123", "Anna"))
    assert ok(ids.safe_path, "a/b.txt") and not any(ok(ids.safe_path, v) for v in ("", "/a", "a/../b", "a//b", "C:/x", "a\\b", "./a"))
