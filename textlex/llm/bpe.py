"""Operator 1: BPE encoding and decoding of document columns.

`encode` adds the token numbers of each text, `decode` the text of token numbers, `encode_decode` both in
one pass. Token numbers are packed: a binary column of little-endian unsigned 32-bit integers, a quarter
of the memory of an array column; `unpack` gives an array. The method is in word_bpe.

Defined cases: a null or empty text has no tokens and decodes to the empty string; equal texts have equal
tokens; an added column replaces an input column of that name; an empty table gives an empty table. No
shuffle: each row is handled where it is read, a few rows at a time, so that lost executors cost only
their own tasks. The vocabulary (a fixed file of a few MB) is read by the driver and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlex.llm import word_bpe
from textlex.llm.arrow import with_columns


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file's text for the executors."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    spec = vocabulary(df, path)

    def make():
        bpe = word_bpe.model(spec.value)
        return lambda texts: [[bpe.encode_packed(t) for t in texts]]

    return with_columns(df, text, T.StructType([T.StructField(ids, T.BinaryType())]), make, drop_text)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", drop_ids: bool = False) -> DataFrame:
    spec = vocabulary(df, path)

    def make():
        bpe = word_bpe.model(spec.value)
        return lambda packed: [[bpe.decode_packed(p) for p in packed]]

    return with_columns(df, ids, T.StructType([T.StructField(decoded, T.StringType())]), make, drop_ids)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop_text: bool = True) -> DataFrame:
    spec = vocabulary(df, path)

    def make():
        bpe = word_bpe.model(spec.value)

        def both(texts):
            packed = [bpe.encode_packed(t) for t in texts]
            return [packed, [bpe.decode_packed(p) for p in packed]]

        return both

    added = T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return with_columns(df, text, added, make, drop_text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpack(ids: Column) -> Column:
    """An array<long> of packed token numbers."""
    digits = F.regexp_extract_all(F.hex(ids), F.lit(".{8}"), F.lit(0))
    number = lambda d: F.conv(F.concat(*[F.substring(d, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.transform(digits, number)
