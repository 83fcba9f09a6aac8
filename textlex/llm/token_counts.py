"""Operator 3: token counts by overlap resynchronisation.

A text of up to `chunk` characters is encoded at once. A longer one is cut into chunks that overlap. Each
chunk is encoded by itself, with the offset at which each of its white-space-free fields ends and the
number of tokens up to there. Neighbouring chunks are spliced at a boundary that both have inside their
overlap and that is proven stable: the end of a field that is followed by white space. No token, special
string, normalisation or pattern of this kind of vocabulary reaches across white space, so what stands
before and after such a place is encoded alike in any chunk. The left chunk gives the tokens up to the
boundary and the right chunk those after it. If the overlap holds no such boundary (a long run without
white space), it is doubled, up to the end of the text.

Defined cases: null counts as empty, with 0 bytes and 0 tokens; added columns replace input columns of
their names; an empty table gives an empty table. There is no shuffle, and memory beyond the text itself
is that of one chunk.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlex.llm import word_bpe
from textlex.llm.arrow import with_columns
from textlex.llm.bpe import vocabulary

CHUNK, OVERLAP = 16_384, 128
_fields = re.compile(f"[^{word_bpe.WHITE_SPACE}]+")


def encode_chunk(bpe: word_bpe.WordBpe, text: str) -> list[tuple[int, int]]:
    """For each field of a chunk the offset of its end and the number of tokens up to there."""
    out, total = [], 0
    for m in _fields.finditer(text):
        total += len(bpe.encode_packed(m.group())) // 4
        out.append((m.end(), total))
    return out


def count_tokens(bpe: word_bpe.WordBpe, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    if not text:
        return 0
    if len(text) <= chunk:
        return len(bpe.encode_packed(text)) // 4
    total, start, skip = 0, 0, 0  # skip: what ends up to there, as an offset in the text, has been counted
    end = min(len(text), chunk)
    left = encode_chunk(bpe, text[:end])
    while end < len(text):
        width, right_start = overlap, end - overlap
        while True:
            right_start = max(start, end - width)
            right_end = min(len(text), right_start + chunk + width)
            right = encode_chunk(bpe, text[right_start:right_end])
            common = _stable(left, start, end, right, right_start, right_end, skip)
            if common is not None or right_end == len(text) and right_start == start:
                break
            width *= 2
        if common is None:  # the right chunk reaches over all that is left
            left, start, end = right, right_start, right_end
            continue
        total += _tokens(left, common - start) - _tokens(left, skip - start)
        skip, left, start, end = common, right, right_start, right_end
    return total + left[-1][1] - _tokens(left, skip - start) if left else total


def _stable(left, start, end, right, right_start, right_end, skip) -> int | None:
    """The last offset at which both chunks have a field's end before white space that lies in both."""
    there = {right_start + k for k, _ in right if right_start + k < right_end}
    for k, _ in reversed(left):
        at = start + k
        if at <= max(right_start, skip):
            return None
        if at < end and at in there:
            return at
    return None


def _tokens(chunk: list[tuple[int, int]], upto: int) -> int:
    """Tokens of a chunk's fields that end at or before an offset."""
    from bisect import bisect_right

    k = bisect_right(chunk, (upto, 1 << 60))
    return chunk[k - 1][1] if k else 0


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df without its text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    spec = vocabulary(df, path)

    def make():
        bpe = word_bpe.model(spec.value)
        return lambda texts: [
            [len(t.encode()) if t else 0 for t in texts],
            [count_tokens(bpe, t, chunk, overlap) for t in texts],
        ]

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return with_columns(df, text, added, make).withColumn("over_limit", F.col("n_tokens") > limit)
