"""The library's front: a lexicon and a text model to ask, and functions for SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from textlex.functions import distance
from textlex.operators import ngrams, predict, search
from textlex.sources import pack


class Lexicon:
    """Words to look up. Columns: word, normalized (unique), token_count, document_count, zipf_milli."""

    def __init__(self, words: DataFrame):
        missing = {"word", "normalized", "token_count", "document_count", "zipf_milli"} - set(words.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        self.words = words

    @classmethod
    def from_pack(cls, spark: SparkSession, path: str) -> Lexicon:
        return cls(pack.read(spark, path)[0])

    def _asked(self, queries: DataFrame | Iterable[str]) -> DataFrame:
        return queries if isinstance(queries, DataFrame) else self.words.sparkSession.createDataFrame([(q,) for q in queries], "query string")

    def __len__(self) -> int:
        return self.words.count()

    def contains(self, queries: DataFrame | Iterable[str]) -> DataFrame:
        return search.known_words(self._asked(queries), self.words)

    def suggest(self, queries: DataFrame | Iterable[str], limit: int | None = None, use_frequency: bool = True, kinds: list[str] | None = None) -> DataFrame:
        return search.suggest(self._asked(queries), self.words, limit, use_frequency, kinds)

    complete = correct = suggest


class TextModel:
    """A lexicon with bigram and trigram models."""

    def __init__(self, lexicon: Lexicon, bigrams: DataFrame, trigrams: DataFrame):
        self.lexicon, self.bigrams, self.trigrams = lexicon, bigrams, trigrams

    @classmethod
    def from_documents(cls, lexicon: Lexicon, docs: DataFrame, least: int = 2) -> TextModel:
        """docs: text."""
        return cls(lexicon, ngrams.model(docs, 2, least), ngrams.model(docs, 3, least))

    @classmethod
    def from_pack(cls, spark: SparkSession, path: str) -> TextModel:
        words, bigrams, trigrams = pack.read(spark, path)
        return cls(Lexicon(words), bigrams, trigrams)

    def predict_next(self, contexts: DataFrame | Iterable[list[str]], limit: int = 5) -> DataFrame:
        """contexts: context (array). No word gives nothing, one its bigrams, more the last two with backoff."""
        if not isinstance(contexts, DataFrame):
            contexts = self.bigrams.sparkSession.createDataFrame([(list(c),) for c in contexts], "context array<string>")
        return predict.predict_next(contexts, self.bigrams, self.trigrams, max(0, min(limit, 50)))

    def save(self, path: str, language: str = "ku-Latn") -> None:
        pack.write(self.lexicon.words, self.bigrams, self.trigrams, path, language)


def register(spark: SparkSession) -> None:
    """Functions for SQL: tl_nfc(text), tl_tokens(text), tl_sentences(text), tl_distance_quarters(a, b).

    Each is a Pandas function, as SQL can only call registered ones; DataFrame code uses textlex.functions, which stay in the JVM.
    """
    import re
    import unicodedata

    import pandas as pd

    split = re.compile(r"[^.!?…۔]*[.!?…۔]+|[^.!?…۔]+$")

    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    def words_of(t: str) -> list[str]:
        t = unicodedata.normalize("NFC", t).lower()
        kind = lambda c: unicodedata.category(c)[0] in "PS" or c.isspace()
        return [w for w in "".join(" " if kind(c) else c for c in t).split(" ") if any(unicodedata.category(c)[0] == "L" for c in w)]

    def tokens(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else words_of(t))

    def sentences(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else [s for p in split.findall(t) if (s := p.strip()) and any(c.isalnum() for c in s)])

    for name, f, kind in (("tl_nfc", nfc, StringType()), ("tl_tokens", tokens, ArrayType(StringType())), ("tl_sentences", sentences, ArrayType(StringType()))):
        f.__annotations__ = {"text": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(f, kind))
    spark.udf.register("tl_distance_quarters", F.pandas_udf(distance.distance_quarters.func, IntegerType()))
