"""Operator 2: language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each cell is a bitmask with a bit for each language, and
the AND of an n-gram's cells is the set of all languages that contain it. A text's n-grams are looked up,
each language's hits are counted (popcounts by bit) and corrected for the filter's false positives,
(hits - n * p) / (1 - p) with the language's own p, and the language with the most wins.

n-grams are 2 to 5 characters of the lower-cased text in which each run of other characters than letters is one
space. A language contains every n-gram that its training texts have MIN_COUNT times at least.

Training reads a bounded sample of the labelled texts: about SAMPLE texts of each language, chosen by a hash
of the id. The filter has CELLS cells, or more if a language of that sample has more n-grams than a 24th of them. Prediction reads
whole texts of all documents, without a shuffle.

Defined cases: a null text or one without a letter is `und`, with score 0; a text none of whose n-grams is
known gets the language with the most training texts, score 0; ties go to the language with more
training texts, then to the smaller name. A null id is neither trained on nor held out. An empty table gives an
empty result, and without training texts everything is `und`. More than MAX_LANGUAGES languages are an error, as each cell has
a bit for each. An added column replaces one of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlex.llm.arrow import slices, small_batches, with_columns
from textlex.llm.tables import written
from textlex.llm.words import U64, mix

SAMPLE, MIN_COUNT, SIZES = 2000, 5, (2, 3, 4, 5)
CELLS, HASHES, MAX_LANGUAGES = 1 << 22, 3, 1024
UNKNOWN = "und"
#: Characters that are worked on at once.
STRETCH = 1 << 19

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with one space around and for other characters than letters, and their texts' indexes."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = _is_letter()[code]
    stay = letter.copy()
    stay[1:] |= letter[:-1]  # of the other characters the first after a letter
    stay[0] = True
    stay[1:] |= text[1:] != text[:-1]
    return np.where(letter, code, 32)[stay], text[stay]


def grams(code: np.ndarray, text: np.ndarray, size: int):
    """Stretches of n-gram hashes with their texts' indexes; n-grams lie in one text."""
    for a in range(0, len(code) - size + 1, STRETCH):
        b = min(a + STRETCH, len(code) - size + 1)
        h = np.full(b - a, size, U64)
        for k in range(size):
            h = h * U64(0xD6E8FEB86659FD93) + code[a + k : b + k]
        inside = text[a:b] == text[a + size - 1 : b + size - 1]
        yield mix(h[inside]), text[a:b][inside]


class Filter:
    def __init__(self, languages: list[str], keys: list[np.ndarray], cells: int = CELLS, hashes: int = HASHES):
        """languages: those with more training texts first; keys: the n-grams of each."""
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        cells = max(cells, 1 << int(24 * max(map(len, keys), default=0)).bit_length())
        self.languages, self.hashes, self.bits = languages, hashes, U64(cells.bit_length() - 1)
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * t().nbytes), np.uint64)
        self.width = 8 * kind().nbytes
        #: A row of words for each cell, with a bit for each language.
        self.mask = np.zeros((cells, max(1, -(-len(languages) // self.width))), kind)
        for k, h in enumerate(keys):
            word, bit = self.bit(k)
            for place in self.places(h):
                self.mask[place, word] |= bit  # equal places get the same bit
        #: The chance that an n-gram which a language hasn't passes for it.
        self.false = np.array([((self.mask[:, w] & b) > 0).mean() ** hashes for w, b in map(self.bit, range(len(languages)))])

    def bit(self, k: int) -> tuple[int, np.unsignedinteger]:
        return k // self.width, self.mask.dtype.type(1 << k % self.width)

    def places(self, h: np.ndarray):
        step = mix(h ^ U64(0x8CB92BA72F3D8DD7)) | U64(1)
        for k in range(self.hashes):
            yield ((h + U64(k) * step) >> (U64(64) - self.bits)).astype(np.int64)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The bitmask of languages that contain each n-gram: a row of words for each."""
        out = None
        for place in self.places(h):
            cell = self.mask[place]
            out = cell if out is None else out & cell
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, n_languages = len(texts), len(self.languages)
        code, text = characters(texts)
        seen = np.bincount(text[code != 32], minlength=n) > 0
        hits, total = np.zeros((n_languages, n)), np.zeros(n)
        for size in SIZES:
            for h, owner in grams(code, text, size):
                languages = self.containing(h)
                total += np.bincount(owner, minlength=n)
                for k in range(n_languages):
                    word, bit = self.bit(k)
                    hits[k] += np.bincount(owner[languages[:, word] & bit > 0], minlength=n)
        if not n_languages:
            return [UNKNOWN] * n, [0.0] * n
        p = self.false[:, None]
        corrected = np.maximum((hits - total * p) / (1 - p), 0.0)
        best = corrected.argmax(axis=0)  # the first of equals
        share = corrected[best, np.arange(n)] / np.maximum(corrected.sum(axis=0), 1e-300)
        known = np.minimum(corrected[best, np.arange(n)] / np.maximum(total, 1), 1.0)
        score = np.round(np.where(seen, share * known, 0.0), 6)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], score.tolist()


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _count(batches):
    for part in slices(batches):
        code, text = characters(part.column("text").to_pylist())
        name = np.array(part.column("lang").to_pylist(), object)
        for size in SIZES:
            for h, owner in grams(code, text, size):
                for lang in np.unique(name):
                    g, n = np.unique(h[name[owner] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), size, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "size", "h", "n"]
                    )


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filter:
    """A filter from all labelled texts given; at most about `sample` of each language are read."""
    docs = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    if not languages:
        return Filter([], [])
    small_batches(docs.sparkSession)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col("lang") == name) & (chance < int(min(1.0, sample / sizes[name]) * 1_000_000)))
    counts = docs.filter(chosen).select("text", "lang").mapInArrow(_count, "lang string, size int, h long, n long")
    counts = written(counts.groupBy("lang", "size", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT), "n-grams")
    found = counts.groupBy("lang").agg(F.collect_list("h").alias("h")).toArrow()  # bounded by the sample
    keys = {name: h.values.to_numpy().view(U64) for name, h in zip(found.column("lang").to_pylist(), found.column("h"), strict=True)}
    return Filter(languages, [keys.get(x, np.zeros(0, U64)) for x in languages])


def identify(df: DataFrame, model: Filter, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", drop_text: bool = True) -> DataFrame:
    """df with the language of each text and a score from 0 to 1: the winner's share of hits times the share of n-grams it knows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: list(shared.value.predict(texts))

    return with_columns(df, text, T.StructType([T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]), make, drop_text)


def identify_held_out(df: DataFrame) -> DataFrame:
    """Learns from the labelled documents whose remainder isn't 2 and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(df.filter(remainder(F.col("doc_id")) != 2))
    docs = df.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(docs, model)
