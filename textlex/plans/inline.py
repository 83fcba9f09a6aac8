"""Small tables given in the code, for Spark and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]::VARCHAR[]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


class Inline:
    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        columns = ", ".join(c.split()[0] for c in schema.split(", "))
        self.sql = f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


#: A small lexicon of our own: words in load order, with made-up frequencies.
WORDS = [
    ("mal", 4100),
    ("malbat", 1250),
    ("malper", 300),
    ("derî", 960),
    ("dîwar", 720),
    ("sêv", 510),
    ("sev", 40),
    ("masî", 830),
    ("şûşe", 220),
    ("çem", 1400),
    ("çemçe", 35),
    ("kevir", 640),
    ("kevçî", 180),
    ("nan", 5200),
    ("nanpêj", 90),
    ("av", 6100),
    ("agir", 1500),
    ("Zagros", 410),
    ("hirç", 60),
    ("hêk", 350),
    ("dar", 2900),
    ("darî", 150),
    ("birû", 75),
    ("stêr", 880),
]
SEED = Inline(
    "seed",
    "ord bigint, word string, normalized string, token_count bigint, document_count bigint, zipf_milli bigint",
    [(k, w, w.lower(), n, n // 10, 3000 + 7 * k) for k, (w, n) in enumerate(WORDS, 1)],
)
ASKED = Inline("asked", "query string", [(q,) for q in ["malb", "deri", "susa", "kevri", "nann", "MALBAT", "m", "zagros", "sev", "xyzzyword42", "hek", "av", "cem", "mal", "sterr", "x" * 3000]])
LINES = Inline(
    "lines",
    "line_num bigint, line string",
    list(enumerate(["17", "sêvik/AN po:ij", "lîstin po:verb", "derî/N po:noun", "sêvik/AN po:ij", "", "AC\\/DC/AN po:noun", "lîstin/V po:verb is:x", "/N po:noun", "<b>/N", " Derî/M po:n", "http://a/x", "gund/ po:zz", "\tçav\t/Q  po:n", "hirç/A po:noun", "hirç/B po:noun", "hêk/A", "hêk/B", "masî/A po:noun", "masî po:noun", "stêr/A", "stêr/C"], 1)),
)
ENTRIES = Inline(
    "entries",
    "ord bigint, word string, lemma string, normalized string, part_of_speech string, frequency bigint, status string, variants array<string>, sources array<string>",
    [
        (1, "Sêvik", "sêvik", "sêvik", "noun", 840, "approved", ["sevik"], ["manual-seed"]),
        (2, "sêvik", "sêvik", "sêvik", "noun", 500, "approved", ["sêv ik"], ["wiktionary", "manual-seed"]),
        (3, "Amed", "Amed", "amed", "proper_noun", 10, "approved", [], ["a"]),
        (4, "amed", "amed", "amed", "proper_noun", 90, "approved", ["x"], ["b"]),
        (5, "derî", "derî", "derî", "noun", 960, "approved", [], ["manual-seed"]),
        (6, "", "x", "x", "noun", 1, "approved", [], ["a"]),
        (7, "x1", "x1", "x1", "noun", 1, "approved", [], ["a"]),
        (8, "<i>", "i", "i", "noun", 1, "approved", [], ["a"]),
        (9, "şûşe", "şûşe", "şûşe", "noun", 220, " ", [], ["b"]),
    ],
)
RECORDS = Inline(
    "records",
    "line_num bigint, word string, normalized string",
    list((k, w, w.lower()) for k, w in enumerate(["Sêvik", "ABC", "abc123", "!", "$", "123", "12-!", "xwe-xwe", "l'amour", "şûşe nû", "мир", "aмиr", "سلام", "aسb", "ελ", "éé", "McDonald", "a" * 26, "b" * 41, "A中", "ê", "x"], 1)),
)
REGISTRY = Inline(
    "registry",
    "corpus_id string, corpus_name string, license string, notes string",
    [(f"src{k}", f"{'Dialogue' if k % 7 == 0 else 'Text'} {k}", ("CC-BY-4.0", "CC0-1.0", "ODC-BY-1.0")[k % 3], "film dialogue" if k % 5 == 0 else "") for k in range(20)],
)
_BROKEN = [("a", "b", 3, 3, 1_000_000), ("a", "b", 3, 3, 1_000_000), ("c", "d", 0, 5, 10), ("c", "e", 2, 0, 10), ("c", "f", 7, 5, 900), ("c", "g", 2, 5, 1_000_001), ("c", "h", 2, 5, 0), ("c", "i", 2, 5, 400_000)]
#: Models with rows that break a rule, by width.
BROKEN = {
    2: Inline("broken_bigrams", "previous string, next string, count bigint, context_count bigint, probability_millionths bigint", _BROKEN),
    3: Inline("broken_trigrams", "previous_2 string, previous_1 string, next string, count bigint, context_count bigint, probability_millionths bigint", [("z", *r) for r in _BROKEN]),
}
