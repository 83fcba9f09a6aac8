"""Operator 10: substring deduplication with difference-cover anchors.

A window of `WINDOW` (35) consecutive words that starts anywhere else too is a repeat, and each word that a
repeated window covers is removed. A difference cover D modulo a period p has, for any two places i and j,
a shift d < p with both i + d and j + d in D (modulo p). So two equal windows of 35 words share, d words in,
an anchor of 35 - p + 1 words that both documents hash. With p = 21 and five residues only 5 of 21 places
are hashed, 15 words each.

1. Anchors: each document's anchors, and a hash of its whole word sequence, are dealt by hash; those that
   occur once go.
2. Extension: from each anchor left, all windows that contain it are hashed whole (up to p - 1 places to
   the left) and dealt by that hash; the windows that occur again are repeats. Windows without a shared
   anchor can't be repeats, so nothing is lost.
3. Each document drops the words under its repeated windows.

Hot keys: each task merges equal hashes of up to CHUNK anchors before it sends them (their places are known
repeats then, and one row stands for all), so that a passage or text with a third of all rows sends a few rows
per task. Of documents with the same word sequence all words go; one of them stands for all in step 2. Groups of
such documents with more than a thousandth of all rows are joined by a broadcast of at most a thousand rows.

Identity: anchors are dealt by 64 bits and only choose candidates. Windows and whole word sequences are equal if 128 bits of two
independent hashes of their words are. Each row has a key: its doc_id, or where the id is null or occurs in several rows a
number of its own for each different text, that no doc_id has.

Defined cases: null counts as empty, with no words; texts under 35 words stay whole; rows that repeat are
documents of their own and so remove each other's windows, also where they have the same id or none. An
empty table gives an empty result. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.llm.arrow import slices, small_batches
from textlex.llm.tables import join_groups, written
from textlex.llm.words import Hasher, mix, of_sequences, windows

WINDOW, PERIOD, COVER = 35, 21, (3, 6, 7, 12, 14)
CHUNK = 500_000
#: Repeated ids are broadcast up to this number and joined by a shuffle beyond.
FEW = 500_000
#: In place of an anchor's place: one of several equal texts, which stands for them; another of them.
FIRST_COPY, COPY = -1, -2


def covers(period: int, residues: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in residues for b in residues} == set(range(period))


class _Sender:
    """Collects (hashes, key, place) and merges what is equal within a chunk.

    Rows: h (and h2, if wide), key, place, n. n = 0: a place known as a repeat; n > 0: so many occurrences of the hash, and the
    place is null if they are known already.
    """

    def __init__(self, wide: bool):
        self.names = ["h", "h2", "key", "place", "n"] if wide else ["h", "key", "place", "n"]
        self.hashes, self.parts, self.size = 2 if wide else 1, [], 0

    @staticmethod
    def schema(wide: bool) -> str:
        return f"h long, {'h2 long, ' if wide else ''}key long, place int, n int"

    def add(self, hashes: tuple[np.ndarray, ...], key, place, n=1) -> None:
        rows = len(hashes[0])
        full = lambda x, t: np.full(rows, x, t) if np.isscalar(x) else x.astype(t)
        self.parts.append((*(h.view(np.int64) for h in hashes), full(key, np.int64), full(place, np.int32), full(n, np.int32)))
        self.size += rows

    def flush(self):
        if not self.size:
            return
        *hashes, key, place, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(hashes[0], kind="stable")
        hashes, key, place, n = [h[order] for h in hashes], key[order], place[order], n[order]
        new = np.logical_or.reduce([h[1:] != h[:-1] for h in hashes])
        first = np.flatnonzero(np.concatenate(([True], new)))
        size = np.diff(np.append(first, len(key)))
        total = np.add.reduceat(n, first)
        twice = np.repeat(total > 1, size)
        one = ~twice
        lead = first[total > 1]
        known = np.flatnonzero(twice & (place >= 0))
        # known repeats need no hash; these spread them over all partitions
        own = mix(key[known].view(np.uint64) ^ place[known].astype(np.uint64)).view(np.int64)
        cols = [np.concatenate([h[one], h[lead], own if k == 0 else np.zeros(len(known), np.int64)]) for k, h in enumerate(hashes)]
        cols += [
            np.concatenate([key[one], key[lead], key[known]]),
            np.concatenate([place[one], np.full(len(lead), -9, np.int32), place[known]]),
            np.concatenate([n[one], np.full(len(lead), 2, np.int32), np.zeros(len(known), np.int32)]),
        ]
        gone = np.repeat([False, True, False], [int(one.sum()), len(lead), len(known)])
        for k in range(0, len(gone), 50_000):
            part = slice(k, k + 50_000)
            masks = [gone[part] if name == "place" else None for name in self.names]
            yield pa.RecordBatch.from_arrays([pa.array(c[part], mask=m) for c, m in zip(cols, masks, strict=True)], names=self.names)


def _send(rows, wide: bool = False):
    """rows: yields once for each slice of documents after adding to the sender it is given."""

    def run(batches):
        sender = _Sender(wide)
        for _ in rows(batches, sender):
            if sender.size >= CHUNK:
                yield from sender.flush()
        yield from sender.flush()

    return run


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    width = window - period + 1

    def rows(batches, sender):
        hasher, chosen = Hasher(unchanged=True), np.isin(np.arange(period), cover)
        for part in slices(batches):
            h, text, *_ = hasher.words(part.column("text").to_pylist())
            key = part.column("key").to_numpy()
            a, at = windows(h, text, width)
            start = np.searchsorted(text, np.arange(len(key) + 1))
            place = at - start[text[at]]
            long = np.diff(start)[text[at]] >= window
            take = chosen[place % period] & long
            sender.add((a[take],), key[text[at][take]], place[take])
            yield

    return rows


def _whole_texts(window: int):
    """(h, h2, key) of each text of at least a window: two hashes of all its words."""

    def run(batches):
        hashers = Hasher(unchanged=True), Hasher(unchanged=True, stream=1)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            (one, n), (two, _) = (of_sequences(h, text, part.num_rows) for h, text, *_ in (hasher.words(texts) for hasher in hashers))
            take = n >= window
            yield pa.RecordBatch.from_arrays([pa.array(one[take].view(np.int64)), pa.array(two[take].view(np.int64)), part.column("key").filter(pa.array(take))], names=["h", "h2", "key"])

    return run


def _candidates(window: int, period: int):
    def rows(batches, sender):
        hashers = Hasher(unchanged=True), Hasher(unchanged=True, stream=1)
        unpack = zstandard.ZstdDecompressor()
        for part in slices(batches):
            marks = part.column("places").to_pylist()
            of = [k for k, m in enumerate(marks) if m and COPY not in m]
            if not of:
                continue
            blobs = part.column("body")
            texts = [unpack.decompress(blobs[k].as_py()).decode() for k in of]
            keys = part.column("key").to_numpy()[of]
            (h, text, *_), (other, *_) = (hasher.words(texts) for hasher in hashers)
            (w, at), (w2, _) = windows(h, text, window), windows(other, text, window)
            start = np.searchsorted(text, np.arange(len(of) + 1))
            edge = np.zeros(len(h) + period + 1, np.int32)
            several = np.array([FIRST_COPY in marks[k] for k in of])
            for j, k in enumerate(of):
                if several[j]:
                    edge[start[j]] += 1
                    edge[start[j + 1]] -= 1
                else:
                    p = start[j] + np.array(marks[k])
                    np.add.at(edge, np.maximum(p - period + 1, start[j]), 1)
                    np.add.at(edge, p + 1, -1)
            take = np.cumsum(edge)[at] > 0
            w, w2, at = w[take], w2[take], at[take]
            place = np.where(several[text[at]], -9, at - start[text[at]])
            sender.add((w, w2), keys[text[at]], place, np.where(several[text[at]], 2, 1))
            yield

    return rows


def _kept(window: int):
    """Words that stay, joined by a space."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for part in slices(batches):
            n_words, removed, out = [], [], []
            for body, starts, copy in zip(*(part.column(c).to_pylist() for c in ("body", "starts", "copy")), strict=True):
                words = unpack.decompress(body).split()  # at ASCII white space
                stay = words
                if copy:
                    stay = []
                elif starts:
                    edge, s = np.zeros(len(words) + 1, np.int32), np.array(starts)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    stay = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                n_words.append(len(words))
                removed.append(len(words) - len(stay))
                out.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return run


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for part in slices(batches):
        body = [pack.compress((t or "").encode("utf-8", "replace")) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(body, pa.binary())], names=["key", "doc_id", "body"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text -> key, doc_id, text; rows of one id and text have one key."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    several = written(ids.select(F.col("doc_id").alias("_id")), "repeated-ids")
    if not several.limit(1).count():
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    room = 1 << 62
    if least is None or least > room - (1 << 63):
        new = F.lit(room - (1 << 63) if least is None else least) - 1 - F.col("number")
    elif most < room:
        new = F.lit(most) + 1 + F.col("number")
    else:
        new = None  # ids at both ends: all rows get numbers
    few = several.count() <= FEW
    joined = lambda how: docs.join(F.broadcast(several) if few else several, F.col("doc_id").eqNullSafe(F.col("_id")), how)
    named = (docs if new is None else joined("left_semi")).select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    named = written(named.withColumn("number", F.monotonically_increasing_id()), "row-names")
    rest = None if new is None else joined("left_anti").select(F.col("doc_id").alias("key"), "doc_id", "text")
    mine = (docs if new is None else joined("left_semi")).withColumn("digest", F.sha2("text", 256))
    n = named.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("number"))
    mine = mine.join(n, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    mine = mine.select((F.col("number") if new is None else new).alias("key"), "doc_id", "text")
    return mine if rest is None else rest.unionByName(mine)


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_text."""
    if not covers(period, cover) or window < period:
        raise ValueError("not a difference cover of a period within the window")
    body = F.coalesce(F.col(text), F.lit(""))
    docs = _keyed(df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text")))
    small_batches(df.sparkSession)

    sent = docs.select("key", "text").mapInArrow(_send(_anchors(window, period, cover)), _Sender.schema(False))
    counted = sent.withColumn("total", F.sum("n").over(W.partitionBy("h")))
    anchors = counted.filter("place is not null and (n = 0 or total > 1)").select("key", "place")

    whole = docs.select("key", "text").mapInArrow(_whole_texts(window), "h long, h2 long, key long")
    whole = written(whole, "whole-texts")
    groups = whole.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1")
    groups = written(groups, "text-groups")
    # a row that repeats has one key and counts as first; its copies go with it
    copies = join_groups(whole, groups, ["h", "h2"], "n", max(1, whole.count()), "inner")
    copies = copies.select("key", F.when(F.col("key") == F.col("first"), F.lit(FIRST_COPY)).otherwise(F.lit(COPY)).alias("place"))
    copies = written(copies.distinct(), "copies")

    marks = anchors.unionByName(copies).groupBy("key").agg(F.collect_set("place").alias("places"))
    stored = docs.mapInArrow(_packed, "key long, doc_id long, body binary")
    # both joins take the same columns of all documents, so that one exchange of the texts serves both
    found = stored.join(marks, "key", "left").mapInArrow(_send(_candidates(window, period), True), _Sender.schema(True))
    counted = found.withColumn("total", F.sum("n").over(W.partitionBy("h", "h2")))
    starts = counted.filter("place is not null and (n = 0 or total > 1)").select("key", "place", F.lit(False).alias("copy"))
    lost = starts.unionByName(copies.select("key", F.lit(None).cast("int").alias("place"), F.lit(True).alias("copy")))
    lost = lost.groupBy("key").agg(F.collect_set("place").alias("starts"), F.max("copy").alias("copy"))
    final = stored.join(lost, "key", "left").select("doc_id", "body", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return final.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_text string")
