"""Runs of words, counted in each task and packed for the shuffle: a bucket of contexts travels as one sorted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlex.functions import text as T

#: A task counts this many words at a time (or a single batch of Spark, if that has more), and texts have at most so many bytes.
WORDS, BYTES = 400_000, 1 << 24
#: Buckets for each shuffle partition; more make the partitions more even.
BUCKETS = 16
#: Contexts of a line, words and counts; no word holds white space.
LINE, SPACE, TIMES = "\n", " ", "\t"


def words_of_sentences(docs: DataFrame) -> DataFrame:
    """w: the words of each sentence, as `sentences` cuts them; sentences without words may be rows too.

    Sentences end with punctuation, which neither belongs to words nor composes with other characters, so texts are composed as a
    whole and cut at the ends alone. explode_outer, as Spark would cut the texts a second time to filter for explode.
    """
    return docs.select(F.explode_outer(F.split(T.nfc(F.col("text")), T.SENTENCE_END)).alias("s")).select(T.words(F.lower("s")).alias("w"))


def _counted(words: pa.Array, lengths: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words in order, the different runs as numbers of words (n columns, sorted), and their counts."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    place = np.arange(len(codes))
    starts = place[place + n <= np.repeat(np.cumsum(lengths), lengths)]
    key, size = codes[starts], max(1, len(order))
    for k in range(1, n):
        if size * len(order) >= 1 << 62:
            different, key = np.unique(key, return_inverse=True)
            size = len(different)
        key, size = key * len(order) + codes[starts + k], size * len(order)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = starts[first]
    return coded.dictionary.take(order), np.stack([codes[at + k] for k in range(n)]), counts


def _packed(words: pa.Array, lengths: np.ndarray, n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, runs: a line for each context, with the words after it and, if more than one, their counts."""
    words, runs, counts = _counted(words, lengths, n)
    if not len(counts):
        return
    hashes, mixed = pd.util.hash_array(words.to_numpy(zero_copy_only=False)), np.zeros(len(counts), np.uint64)
    for column in runs[:-1]:
        mixed = (mixed ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, runs, counts = bucket[order], runs[:, order], counts[order]
    other = np.append(True, bucket[1:] != bucket[:-1])
    context = other | np.append(True, (runs[:-1, 1:] != runs[:-1, :-1]).any(axis=0))
    # the text as numbers of pieces: words by themselves, words that begin a line, words after a space, counts
    times, which = np.unique(counts, return_inverse=True)
    plain = pa.array(words, pa.large_string())
    pieces = pa.concat_arrays([plain, *[pc.binary_join_element_wise(pa.scalar(s, pa.large_string()), plain, pa.scalar("", pa.large_string())) for s in (LINE, SPACE)], pa.array([f"{TIMES}{t}" for t in times], pa.large_string())])
    v = len(words)
    table = runs.T + 2 * v
    table[:, 0] = np.where(other, runs[0], runs[0] + v)
    shown = np.repeat(context[:, None], n + 1, axis=1)
    shown[:, n - 1], shown[:, n] = True, counts > 1
    stream = np.concatenate([table, (which + 3 * v)[:, None]], axis=1)[shown]
    text = pieces.take(pa.array(stream))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    per_run = shown.sum(axis=1)
    begins = (np.cumsum(per_run) - per_run)[other]
    ends, cut = np.append(offsets[begins], offsets[-1]), 0
    ids, data = bucket[other], text.buffers()[2]
    while cut < len(ids):
        upto = max(cut + 1, int(np.searchsorted(ends, ends[cut] + BYTES, "right")) - 1)
        part = pa.LargeStringArray.from_buffers(upto - cut, pa.py_buffer(ends[cut : upto + 1].tobytes()), data)
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut:upto]), part.cast(pa.string())], ["bucket", "runs"])
        cut = upto


def _packer(n: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths, held = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            yield from _packed(pa.concat_arrays(words), np.concatenate(lengths), n, buckets)

        for batch in batches:
            lists = batch.column(0)
            words.append(lists.flatten())
            lengths.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(words[-1])
            if held >= WORDS:
                yield from done()
                words, lengths, held = [], [], 0
        if words:
            yield from done()

    return pack


def counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """bucket, names, count: the runs of len(names) words inside sentences. All rows of a context (names but the last) are in one bucket,
    and the rows are dealt by bucket, so that a context's sum needs no further shuffle."""
    n = len(names)
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = words_of_sentences(docs).mapInArrow(_packer(n, buckets), "bucket int, runs string").repartition("bucket")
    lines = packed.select("bucket", F.explode_outer(F.split("runs", LINE)).alias("line")).select("bucket", F.split("line", SPACE).alias("w"))
    context = [F.element_at("w", k + 1).alias(c) for k, c in enumerate(names[:-1])]
    each = lines.select("bucket", *context, F.explode_outer(F.slice("w", n, F.size("w"))).alias("next")).select("bucket", *names[:-1], F.split("next", TIMES).alias("next"))
    times = F.coalesce(F.get("next", F.lit(1)).cast("long"), F.lit(1).cast("long"))
    rows = each.select("bucket", *names[:-1], F.get("next", F.lit(0)).alias(names[-1]), times.alias("times"))
    return rows.groupBy("bucket", *names).agg(F.sum("times").alias("count"))
