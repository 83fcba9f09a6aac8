"""Operator 7: sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records by seeded hashes: the shard is the one whose seeded hash of the doc_id is the
largest, so that doc_id and the number of shards alone decide (law `key`), and one more shard takes
records only into itself. Each shard is dealt further, by a seeded hash of the record, into buckets that fit in memory; their
number follows from the bytes of the largest shard. Pass 2 puts each bucket, sorted, through a Fisher-Yates
shuffle (Spark's `shuffle` of an array) and writes it; a record's slot is its bucket's first slot plus its place.

The order depends on the records and the seed alone: a task's shuffles start from the seed and the task's number, and there is
a number of tasks that follows from the buckets, each with its buckets in order. (A cluster that changes the numbers of
partitions given to `repartition` changes the order.)

Whole records are moved once and written once. Records that are all alike in id, length and checksum would share a bucket: where
there are more than ALIKE of them, they are dealt by their place in the input's files.

Defined cases: a null text has no bytes and the checksum of the empty text; null ids share a shard; rows that
repeat get slots of their own; an empty table gives an empty result. Columns of the input other than doc_id
and text don't matter; an added column replaces one of its name. Columns must have an order (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlex.llm.arrow import kept
from textlex.llm.tables import join_groups, row_key, written

BUCKET_BYTES, RECORD_BYTES, ALIKE, MAX_TASKS = 8 << 20, 16, 1000, 20_000
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of the key."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s"))))
    return best.getField("s")


def bucket_count(records: DataFrame, bucket_bytes: int) -> int:
    """Buckets of each shard, so that the largest shard's are no larger than that on average."""
    largest = records.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0] or 0
    return max(1, -(-largest // bucket_bytes))


def _records(df: DataFrame, n_shards: int, seed: int, doc_id: str, text: str, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Records (_id, size, text_crc32, shard, grown_shard, bucket, and df's columns as `row`), the first slot of each bucket, and the number of buckets."""
    df, key = row_key(df)
    body = F.coalesce(F.col(text), F.lit(""))
    own = kept(df, ADDED)
    rows = df.select(
        F.struct(*own).alias("row"),
        F.col(doc_id).alias("_id"),
        (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(doc_id), n_shards, seed).alias("shard"),
        shard_of(F.col(doc_id), n_shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), *key).alias("place"),
    )
    n_buckets = bucket_count(rows, bucket_bytes)
    alike = ["_id", "text_crc32", "size"]
    groups = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("alike")).filter(F.col("alike") > ALIKE)
    groups = written(groups, "alike")
    dealt = lambda salt: F.pmod(F.xxhash64(F.lit(~seed), *alike, salt), F.lit(n_buckets)).cast("int")
    if groups.limit(1).count():
        total = rows.count()
        many = groups.select(F.col("_id").isNull().alias("none"), *[F.coalesce(c, F.lit(0)).alias(c) for c in alike], "alike")
        keyed = rows.withColumns({"none": F.col("_id").isNull(), "given": F.col("_id")}).withColumn("_id", F.coalesce("_id", F.lit(0)))
        rows = join_groups(keyed, many, [*alike, "none"], "alike", total).withColumn("_id", F.col("given")).drop("none", "given")
        rows = rows.withColumn("bucket", dealt(F.when(F.col("alike").isNotNull(), F.col("place")))).drop("alike", "place")
    else:
        rows = rows.withColumn("bucket", dealt(F.lit(None).cast("long"))).drop("place")
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = written(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "buckets")
    return rows, first, n_buckets


def _shuffled(df: DataFrame, n_shards: int, seed: int, doc_id: str, text: str, bucket_bytes: int) -> tuple[DataFrame, list[str]]:
    """All records with their slots, bucket by bucket in the order of their slots; the columns of df that stay."""
    rows, first, n_buckets = _records(df, n_shards, seed, doc_id, text, bucket_bytes)
    own = kept(df, ADDED)
    tasks = min(MAX_TASKS, n_shards * n_buckets)
    dealt = rows.repartition(tasks, "shard", "bucket")
    records = F.array_sort(F.collect_list(F.struct("_id", "text_crc32", "size", "grown_shard", "row")))  # a bucket's
    full = dealt.groupBy("shard", "bucket").agg(records.alias("records")).join(first.hint("merge"), ["shard", "bucket"])
    full = full.sortWithinPartitions("shard", "bucket")
    out = full.select("shard", "first", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "r"))
    added = [F.col("r.size"), F.col("r.text_crc32"), F.lit("key").alias("law"), F.col("shard"), (F.col("first") + F.col("place")).alias("slot"), F.col("r.grown_shard")]
    return out.select(*[F.col("r.row").getField(c).alias(c) for c in own], *added), own


def write_shards(df: DataFrame, path: str, n_shards: int = 40, seed: int = 20260101, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes df as Parquet with a folder for each shard, a bucket's records one after the other in the order of their slots. The table written.

    Added: size, text_crc32, law, shard, slot, grown_shard.
    """
    placed, own = _shuffled(df, n_shards, seed, doc_id, text, bucket_bytes)
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path).select(*own, *ADDED)


def slots(df: DataFrame, n_shards: int = 40, seed: int = 20260101, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """As `write_shards`, without writing: a row for each record with its doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed, _ = _shuffled(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n_shards, seed, "doc_id", "text", bucket_bytes)
    return placed.drop("text")
