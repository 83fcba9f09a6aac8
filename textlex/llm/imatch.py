"""Operator 9: document fingerprints by I-Match.

Terms are runs of ASCII letters and digits and of all other characters from U+0080, in lower case. The lexicon has the
terms whose inverse document frequency lies in a band, here those of at least LOW and at most HIGH of all
documents; document frequencies are exact and cover all documents. A document keeps its distinct terms of
the lexicon, sorted. LEXICONS randomised subsets of the lexicon (each without three tenths, chosen by a
seeded hash) give a hash each; the fingerprint is these hashes, and the likeness of two fingerprints the
share of places at which they agree. A document with fewer than LEAST terms of the lexicon uses all its
terms, as too few terms would make unlike documents agree.

Scale: the term counts are merged in each task before the shuffle. The lexicon has at most a document's average number
of distinct terms divided by LOW entries (some 300,000), whatever the corpus' size. It is counted: up to MAX_LEXICON terms are
broadcast, and of a larger one each text's terms are found by a shuffle, with equal fingerprints.

`with_next` compares each document's fingerprint with that of an edited text, whose last half is taken from
the next document, and with the next document's. The order of documents is descending doc_id, the first
after the last. Ranges of ids are cut at quantiles, and what has one id, or none, at quantiles of a hash of the text; each task
also sends the first row of each range that it has to the range above, so that ranges can be read one by one in order, a few
documents at a time.

Defined cases: null counts as empty; the fingerprint of no terms is a constant of its own, and two documents without terms
have likeness 1; documents without an id come last, and ties in doc_id are ordered by a hash of the text;
a single document is its own next. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlex.llm.arrow import kept, slices, small_batches
from textlex.llm.tables import written
from textlex.llm.words import U64, Hasher, mix

LOW, HIGH, LEXICONS, LEAST, MAX_LEXICON = 0.001, 0.2, 8, 4, 4_000_000
CHUNK = 2_000_000


def _distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by text and hash, each once."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], text[new]


def _counts(batches):
    hasher, held, size = Hasher(), [], 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], names=["h", "n"])

    for part in slices(batches):
        h, text, *_ = hasher.words(part.column("text").to_pylist())
        held.append(_distinct(h, text)[0])
        size += len(held[-1])
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def lexicon(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes h of the terms in the band."""
    total = df.select(F.count(F.lit(1))).first()[0]
    small_batches(df.sparkSession)
    counts = df.select(F.col(text).alias("text")).mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(2, low * total)
    return written(counts.filter(F.col("n").between(F.lit(least), F.lit(max(least, high * total)))).select("h"), "lexicon")


def _sorted(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow().column("h").to_numpy().view(U64))


class Fingerprints:
    def __init__(self, lexicon: np.ndarray | None, lexicons: int = LEXICONS, least: int = LEAST):
        """lexicon: sorted hashes, or None where each text's terms of it are given."""
        self.hasher, self.lexicon, self.least = Hasher(), lexicon, least
        self.seeds = [mix(np.array([k + 1], U64) * U64(0xA0761D6478BD642F))[0] for k in range(lexicons)]
        if lexicon is not None:
            self.coarse = np.zeros(1 << 22, bool)
            self.coarse[lexicon >> U64(42)] = True

    def listed(self, h: np.ndarray, text: np.ndarray, given: list[np.ndarray] | None) -> np.ndarray:
        if self.lexicon is None:
            edge = np.searchsorted(text, np.arange(len(given) + 1))
            return np.concatenate([np.zeros(0, bool), *(np.isin(h[a:b], terms) for a, b, terms in zip(edge[:-1], edge[1:], given, strict=True))])
        out = self.coarse[h >> U64(42)]
        at = np.flatnonzero(out)
        if len(at):
            near = np.minimum(np.searchsorted(self.lexicon, h[at]), len(self.lexicon) - 1)
            out[at] = self.lexicon[near] == h[at]
        return out

    def of(self, texts: list[str], given: list[np.ndarray] | None = None) -> np.ndarray:
        """A row of hashes for each text; given: the terms of the lexicon that it has."""
        n = len(texts)
        h, text, *_ = self.hasher.words(texts)
        inside = self.listed(h, text, given)
        band_h, band_text = _distinct(h[inside], text[inside])
        few = np.bincount(band_text, minlength=n) < self.least
        rest = few[text]
        more_h, more_text = _distinct(h[rest], text[rest])
        own = ~few[band_text]
        h, text = np.concatenate((band_h[own], more_h)), np.concatenate((band_text[own], more_text))
        out = np.zeros((n, len(self.seeds)), U64)
        for k, seed in enumerate(self.seeds):
            chance = mix(h ^ seed)
            stay = chance % U64(10) >= U64(3)
            kept, owner = h[stay], text[stay]
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            if len(start):
                out[owner[start], k] = np.add.reduceat(mix(kept + (place + 1).astype(U64) * U64(0x9E3779B97F4A7C15)), start)
            out[:, k] = mix(out[:, k] + seed)
        return out


def shown(fingerprint: np.ndarray) -> str:
    return "-".join(f"{x:016x}" for x in fingerprint.tolist())


def fingerprints(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, most: int = MAX_LEXICON) -> DataFrame:
    """df without its text, with a column fingerprint, which replaces one of that name."""
    from textlex.llm.arrow import with_columns

    terms = lexicon(df, text, low, high)
    added = T.StructType([T.StructField("fingerprint", T.StringType())])
    if terms.count() <= most:
        words = df.sparkSession.sparkContext.broadcast(_sorted(terms))

        def make():
            f = Fingerprints(words.value)
            return lambda texts: [[shown(x) for x in f.of([t or "" for t in texts])]]

        return with_columns(df, text, added, make)
    keep = kept(df, ["fingerprint"], (text,))
    rows = written(df.select(F.struct(*keep).alias("own"), F.array(F.coalesce(text, F.lit(""))).alias("texts")).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = _with_terms(rows, terms).mapInArrow(_shown, T.StructType([rows.schema["own"], *added]))
    return found.select(*[F.col("own").getField(c).alias(c) for c in keep], "fingerprint")


def _terms(batches):
    """(row, k, h) of the distinct terms of the k-th text of each row."""
    hasher = Hasher()
    for part in slices(batches):
        texts, row = part.column("texts").to_pylist(), part.column("row").to_numpy()
        owner = np.array([(i, k) for i, x in enumerate(texts) for k in range(len(x))], np.int64).reshape(-1, 2)
        h, text, *_ = hasher.words([t for x in texts for t in x])
        h, text = _distinct(h, text)
        for a in range(0, len(h), 100_000):
            at = owner[text[a : a + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(row[at[:, 0]]), pa.array(at[:, 1]), pa.array(h[a : a + 100_000].view(np.int64))], names=["row", "k", "h"])


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (row, texts, ...) with `given`: for each of the texts its terms of the lexicon, by shuffles only."""
    each = rows.select("row", "texts").mapInArrow(_terms, "row long, k long, h long").join(terms.hint("merge"), "h")
    of_text = each.groupBy("row", "k").agg(F.collect_list("h").alias("h"))  # of one text
    given = of_text.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "h"))).alias("found"))
    out = rows.join(given.hint("merge"), "row", "left")
    none = F.array().cast("array<long>")
    of = lambda k: F.coalesce(F.try_element_at("found", k.cast("long")), none)
    return out.withColumn("given", F.transform(F.sequence(F.lit(0), F.size("texts") - 1), of)).drop("found")


def _given(part: pa.RecordBatch) -> list[list[np.ndarray]]:
    return [[np.array(h, np.int64).view(U64) for h in x] for x in part.column("given").to_pylist()]


def _shown(batches):
    f = Fingerprints(None)
    for part in slices(batches):
        own = f.of([x[0] for x in part.column("texts").to_pylist()], [x[0] for x in _given(part)])
        yield pa.RecordBatch.from_arrays([part.column("own"), pa.array([shown(x) for x in own])], names=["own", "fingerprint"])


class Ranges:
    """Ranges of (doc_id, tie), in ascending order of rows from the last to the first: no id, then ids; of equal ones the larger tie first."""

    def __init__(self, bounds: list[tuple]):
        """bounds: where each range but the first begins."""
        self.bounds = bounds

    @staticmethod
    def rank(doc_id: int | None, tie: int) -> tuple:
        return doc_id is not None, doc_id or 0, -tie

    def of(self, doc_id: int | None, tie: int) -> int:
        return bisect_right(self.bounds, self.rank(doc_id, tie))

    @classmethod
    def cut(cls, cuts: list[int], none: float, least: int | None, n: int) -> Ranges:
        """cuts: quantiles of the ids, repeated where an id has several; none: the share of rows without an id."""
        low = -(1 << 63)
        split = lambda known, i, parts: [(known, i, low + ((1 << 64) * k // parts)) for k in range(1, parts)]
        out = split(False, 0, max(1, round(none * n)))
        if least is not None and none:
            out.append((True, least, low))
        for i, parts in sorted(Counter(cuts).items()):
            out += [(True, i, low)] if i > least else []
            out += split(True, i, parts)
        return cls(out)


def _occupied(ranges: Ranges):
    def run(batches):
        seen = set()
        for batch in batches:
            seen.update(ranges.of(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["bucket"])

    return run


def _dealt(ranges: Ranges, number: dict[int, int]):
    """Rows with their range, and the first row of each range, in descending order, as a guest of the range above."""

    def row(bucket, guest, doc_id, tie, body):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(guest, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(tie, pa.int64()), pa.array(body, pa.binary())], names=["bucket", "guest", "doc_id", "tie", "body"])

    def run(batches):
        pack, top = zstandard.ZstdCompressor(level=1), {}
        for part in slices(batches):
            ids, ties = part.column("doc_id").to_pylist(), part.column("tie").to_pylist()
            body = [pack.compress((t or "").encode("utf-8", "replace")) for t in part.column("text").to_pylist()]
            bucket = [number[ranges.of(i, t)] for i, t in zip(ids, ties, strict=True)]
            for b, i, t, x in zip(bucket, ids, ties, body, strict=True):
                rank = ranges.rank(i, t)
                if b not in top or rank > top[b][0]:
                    top[b] = (rank, i, t, x)
            yield row(bucket, [0] * len(ids), ids, ties, body)
        for b, (_, i, t, x) in top.items():
            yield row([(b + 1) % len(number)], [1], [i], [t], [x])

    return run


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_TYPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(ids: list, texts: list[str], edited: list[str], own: np.ndarray, other: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([shown(x) for x in own], pa.string()),
        pa.array([shown(x) for x in other], pa.string()),
        pa.array(_likeness(own, other), pa.float64()),
        pa.array(_likeness(own, following), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=RESULT)


def _pairs(batches, step: int = 256):
    """(id, text, edited text, next text) of rows that come in order, a few at a time."""
    unpack = zstandard.ZstdDecompressor()
    queue: list[tuple[int, int, int | None, str]] = []  # bucket, guest, doc_id, text; the last waits for its next

    def ready():
        for one, other in zip(queue, queue[1:]):
            if not one[1] and one[0] == other[0]:
                text, n = one[3], len(one[3]) // 2
                yield one[2], text, text[: len(text) - n] + other[3][:n], other[3]

    for part in slices(batches):
        for b, g, i, x in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "body")), strict=True):
            if g and queue and queue[-1][0] == b and queue[-1][1]:
                continue  # only a range's first guest is the next document
            queue.append((b, g, i, unpack.decompress(x).decode()))
        if len(queue) >= step:
            yield list(ready())
            queue = queue[-1:]
    if queue:
        yield list(ready())


def _compared(words):
    def run(batches):
        f = Fingerprints(words.value)
        for rows in _pairs(batches):
            if rows:
                ids, texts, edited, after = zip(*rows, strict=True)
                # a text's next is most often the next row
                follows = [k + 1 < len(texts) and after[k] is texts[k + 1] for k in range(len(texts))]
                more = [a for a, known in zip(after, follows, strict=True) if not known]
                found = f.of([*texts, *more])
                own, rest, following = found[: len(texts)], list(found[len(texts) :]), []
                for k, known in enumerate(follows):
                    following.append(own[k + 1] if known else rest.pop(0))
                yield _result(list(ids), texts, edited, own, f.of(list(edited)), np.array(following))

    return run


def _as_texts(batches):
    for rows in _pairs(batches):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([list(r[1:]) for r in rows], pa.list_(pa.string()))], names=["doc_id", "texts"])


def _compared_given(batches):
    f = Fingerprints(None)
    for part in slices(batches):
        texts, given = part.column("texts").to_pylist(), _given(part)
        own, other, following = (f.of([x[k] for x in texts], [x[k] for x in given]) for k in range(3))
        yield _result(part.column("doc_id").to_pylist(), [x[0] for x in texts], [x[1] for x in texts], own, other, following)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH, most: int = MAX_LEXICON) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = lexicon(docs, "text", low, high)
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("cuts")
    found = docs.agg(F.min("doc_id").alias("least"), quantiles, F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    ranges = Ranges.cut(list(found.cuts or []), found.none / max(found.n, 1), found.least, n)
    tied = docs.withColumn("tie", F.xxhash64("text"))
    occupied = tied.select("doc_id", "tie").mapInArrow(_occupied(ranges), "bucket int").distinct().collect()  # ranges at most
    number = {b: k for k, b in enumerate(sorted(r.bucket for r in occupied))}  # so every range has a row
    dealt = tied.mapInArrow(_dealt(ranges, number), "bucket int, guest int, doc_id long, tie long, body binary").repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "tie")
    if terms.count() <= most:
        return dealt.mapInArrow(_compared(spark.sparkContext.broadcast(_sorted(terms))), RESULT_TYPE)
    rows = written(dealt.mapInArrow(_as_texts, "doc_id long, texts array<string>").withColumn("row", F.monotonically_increasing_id()), "texts")
    return _with_terms(rows, terms).mapInArrow(_compared_given, RESULT_TYPE)
