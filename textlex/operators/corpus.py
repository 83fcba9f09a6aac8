"""Corpus operators: inventory, quality, duplicates and partitions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.functions import text as T

#: The domain tag of the partition hash, where none is given.
PARTITION_TAG = "textlex-partition"
#: The shares of a hundred up to which a partition goes.
PARTITIONS = [(80, "train"), (90, "development"), (100, "evaluation")]


def canonical(documents: DataFrame) -> DataFrame:
    """corpus_id, document_id, text of the driver's documents."""
    return documents.select(F.col("source").alias("corpus_id"), F.col("doc_id").cast("string").alias("document_id"), "text", "lang")


def assign_partition(key: Column, tag: str = PARTITION_TAG) -> Column:
    digest = F.sha2(F.concat(F.lit(tag + "\0"), key), 256)
    share = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 100
    out = F.lit(PARTITIONS[-1][1])
    for upto, name in reversed(PARTITIONS[:-1]):
        out = F.when(share < upto, name).otherwise(out)
    return out


def partition_documents(docs: DataFrame) -> DataFrame:
    """Each document with its duplicate group, the group's first member and a partition that the group shares."""
    keyed = docs.select("corpus_id", "document_id", T.duplicate_group_id(F.col("text")).alias("duplicate_group_id"))
    groups = keyed.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("corpus_id", "document_id")).alias("first"))
    return keyed.join(groups, "duplicate_group_id").select(
        assign_partition(F.col("duplicate_group_id")).alias("partition"),
        "corpus_id",
        "document_id",
        "duplicate_group_id",
        (F.col("n") > 1).alias("is_duplicate"),
        F.col("first.corpus_id").alias("canonical_corpus_id"),
        F.col("first.document_id").alias("canonical_document_id"),
    )


def partition_order() -> list[str]:
    """Sort keys of partitioned documents."""
    return ["corpus_id", "document_id"]


def leakage(partitioned: DataFrame) -> DataFrame:
    """Groups that lie in several partitions; there are none."""
    return partitioned.groupBy("duplicate_group_id").agg(F.countDistinct("partition").alias("partitions")).filter("partitions > 1")


def inventory(docs: DataFrame) -> DataFrame:
    each = docs.select("corpus_id", F.size(T.sentences(F.col("text"))).alias("s"), T.tokens(F.col("text")).alias("words"))
    sums = each.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("s").alias("sentences"), F.sum(F.size("words")).alias("tokens"))
    words = each.select("corpus_id", F.explode("words").alias("word")).distinct().groupBy("corpus_id").agg(F.count(F.lit(1)).alias("distinct_tokens"))
    return sums.join(words, "corpus_id", "left").withColumn("distinct_tokens", F.coalesce("distinct_tokens", F.lit(0)))


def domain_of(name: Column, notes: Column) -> Column:
    return F.when(notes.contains("dialogue") | name.contains("Dialogue"), "dialogue").otherwise("prose")


def token_totals(docs: DataFrame) -> DataFrame:
    """Tokens by language and corpus, each language's and the whole sum."""
    counted = docs.select("lang", "corpus_id", F.size(T.tokens(F.col("text"))).alias("n"))
    return counted.rollup("lang", "corpus_id").agg(F.sum("n").alias("tokens"))


def breakdown(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Tokens by license and by domain of the corpora: kind, name, tokens. registry: corpus_id, corpus_name, license, notes."""
    counted = docs.groupBy("corpus_id").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("n"))
    rows = counted.join(registry.select("corpus_id", "license", domain_of(F.col("corpus_name"), F.col("notes")).alias("domain")), "corpus_id")
    sums = rows.groupingSets([["license"], ["domain"]], "license", "domain").agg(F.sum("n").alias("tokens"), F.grouping("license").alias("g"))
    return sums.select(F.when(F.col("g") == 0, "license").otherwise("domain").alias("kind"), F.coalesce("license", "domain").alias("name"), "tokens")


def word_counts(docs: DataFrame) -> DataFrame:
    """corpus_id, word, n (tokens), documents: one pass over the texts, from which lexicon and quality come."""
    words = docs.select("corpus_id", "document_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    each = words.groupBy("corpus_id", "word", "document_id").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("corpus_id", "word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("documents"))


def quality(docs: DataFrame, lexicon: DataFrame | None = None, least_documents: int = 1) -> DataFrame:
    """By corpus and for all (null): tokens of each class, tokens in the lexicon (word; without one, the words of so many documents),
    and second and later copies of documents."""
    words = word_counts(docs)
    if lexicon is None:
        lexicon = words.groupBy("word").agg(F.sum("documents").alias("d")).filter(F.col("d") >= least_documents)
    known = lexicon.select("word").distinct().withColumn("known", F.lit(1))
    classed = words.join(known, "word", "left").withColumn("class", T.token_class(F.col("word")))
    part = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    latin = F.col("class") == "latin"
    sums = classed.rollup("corpus_id").agg(F.sum("n").alias("tokens"), part(F.col("known") == 1).alias("known_tokens"), part(latin).alias("latin_tokens"), part(~latin).alias("other_tokens"))
    keyed = docs.select("corpus_id", "document_id", T.duplicate_group_id(F.col("text")).alias("g"))
    members = keyed.groupBy("g", "corpus_id").agg(F.count(F.lit(1)).alias("n"))
    first = keyed.groupBy("g").agg(F.min(F.struct("corpus_id", "document_id")).alias("first")).select("g", F.col("first.corpus_id").alias("corpus_id"), F.lit(1).alias("is_first"))
    later = members.join(first, ["g", "corpus_id"], "left").rollup("corpus_id").agg(F.sum(F.col("n") - F.coalesce("is_first", F.lit(0))).alias("duplicate_members"))
    return sums.join(later.withColumnRenamed("corpus_id", "c"), F.col("corpus_id").eqNullSafe(F.col("c")), "left").drop("c")


def document_duplicates(docs: DataFrame) -> DataFrame:
    groups = docs.groupBy(T.duplicate_group_id(F.col("text")).alias("duplicate_group_id"))
    found = groups.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("corpus_id", "document_id")).alias("first")).filter("n > 1")
    return found.select("duplicate_group_id", "n", F.col("first.corpus_id").alias("corpus_id"), F.col("first.document_id").alias("document_id"))


def sentence_duplicates(docs: DataFrame) -> DataFrame:
    s = docs.select("document_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    s = s.select("document_id", F.sha2(T.sentence_key(F.col("sentence")), 256).alias("sentence_id"))
    return s.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id")).filter("n > 1")


def duplicate_files(docs: DataFrame) -> DataFrame:
    """Files with equal contents: source_sha256 and their names."""
    files = docs.select("source_sha256", "source_file").distinct().groupBy("source_sha256").agg(F.array_sort(F.collect_list("source_file")).alias("files"))
    return files.filter(F.size("files") > 1)


def token_classes(docs: DataFrame) -> DataFrame:
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(T.token_class(F.col("word")).alias("class")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))


def numbered(docs: DataFrame) -> DataFrame:
    """Rows in scan order within a corpus, for reports that name a record by its place."""
    return docs.withColumn("record", F.row_number().over(W.partitionBy("corpus_id").orderBy("document_id")))
