"""Scans of text and JSON lines, registries and checksums."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import ids
from textlex.functions import text as T

LEXICON_SCHEMA = (
    "word string, lemma string, normalized string, part_of_speech string, frequency bigint, status string, variants array<string>, sources array<string>, "
    "regions array<string>, frequency_metadata struct<token_count bigint, document_count bigint, zipf_milli int>"
)
REQUIRED = ["word", "lemma", "normalized", "part_of_speech", "frequency", "status"]


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of entries; a malformed line or a missing required field is an error, missing lists are empty."""
    df = spark.read.schema(LEXICON_SCHEMA).option("mode", "FAILFAST").json(path)
    for c in REQUIRED:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field {c}"))).otherwise(F.col(c)))
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(c, empty) for c in ("variants", "sources", "regions")})


def _path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "file:/")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_sha256, line_num (from 1), line.

    A file is read in splits: lines are numbered in each, and a split starts after the lines of those before it. Hashes are of whole
    files, so a file's size is bounded by a row's (2 GB); corpora are many files.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        _path(meta.getField("file_path")).alias("path"), meta.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    sizes = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    first = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(W.partitionBy("path", "block").orderBy("id"))
    lines = raw.withColumn("k", place).join(first, ["path", "block"])
    hashes = spark.read.format("binaryFile").load(path).select(_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("source_sha256"))
    return lines.join(hashes, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "source_sha256", (F.col("first") + F.col("k")).alias("line_num"), "line")


def import_corpus(spark: SparkSession, path: str, corpus_id: str, document_format: str = "one-document-per-line", id_field: str = "id", text_field: str = "text") -> DataFrame:
    """Canonical documents of a corpus. Empty documents and wrong fields are errors; `repeated_ids` finds ids that repeat."""
    lines = read_lines(spark, path)
    if document_format == "jsonl":
        whole = F.from_json("line", "map<string,string>")  # numbers are no texts
        quoted = lambda f: F.col("line").rlike(rf'"{f}"\s*:\s*"')
        text, key = F.when(quoted(text_field), whole.getItem(text_field)), F.when(quoted(id_field), whole.getItem(id_field))
    elif document_format == "one-document-per-line":
        text, key = F.col("line"), F.col("line_num").cast("string")
    else:
        raise ValueError(f"unknown document format {document_format}")
    place = F.concat("source_file", F.lit(":"), F.col("line_num").cast("string"))
    text = T.trim_space(text)
    checked = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.concat(F.lit("empty or invalid document at "), place))).otherwise(text)
    named = F.when(key.isNull(), F.raise_error(F.concat(F.lit("missing document id at "), place))).otherwise(F.concat("source_file", F.lit(":"), key))
    return lines.select(F.lit(corpus_id).alias("corpus_id"), named.alias("document_id"), "source_file", F.col("line_num").alias("source_record"), "source_sha256", checked.alias("text"))


def repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus_id", "document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """line_num and line of a dictionary file, for lexicon.parse_lines."""
    return read_lines(spark, path).select("line_num", "line")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Next-word cases, whose context is a string or an array; malformed lines are skipped."""
    raw = spark.read.text(path).filter(T.trim_space(F.col("value")) != "")
    context = F.coalesce(F.from_json(F.get_json_object("value", "$.context"), "array<string>"), F.array(F.get_json_object("value", "$.context")))
    lists = lambda c: F.coalesce(F.from_json(F.get_json_object("value", f"$.{c}"), "array<string>"), F.array().cast("array<string>"))
    out = raw.select(context.alias("context"), lists("expected").alias("expected"), lists("forbidden").alias("forbidden"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("category", "expected_source")])
    return out.filter(F.get(F.col("context"), 0).isNotNull())


def read_registry(spark: SparkSession, text: str, table: str) -> DataFrame:
    """A row for each file of a TOML registry's entries."""
    rows = [(e.get(f"{table}_id"), e.get("url"), f["path"], f["sha256"]) for e in tomllib.loads(text).get(table, []) for f in e.get("files", [])]
    return spark.createDataFrame(rows, "id string, url string, path string, sha256 string")


def registry_problem() -> Column:
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "ID")
        .when(~ids.safe_path(F.col("path")), "PATH")
        .when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "SHA256")
        .when(F.col("url").rlike("/(main|master|latest)/"), "MOVING_URL")
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file and sha256 of all files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def manifest_difference(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of either side without an equal one on the other: file, sha256, side."""
    a, m = actual.select("file", "sha256"), manifest.select("file", "sha256")
    return a.exceptAll(m).withColumn("side", F.lit("actual")).unionByName(m.exceptAll(a).withColumn("side", F.lit("manifest")))


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines in one file; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").json(path)
