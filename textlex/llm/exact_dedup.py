"""Operator 6: exact deduplication by deterministic block naming, in DataFrame functions only.

Each text, as UTF-8, is cut into blocks of `block` bytes. Equal blocks get the same integer name and
different blocks different names, given in sorted order within each shuffle partition of the distinct
blocks. Then adjacent names are paired, and the distinct pairs are named in the same way, level by level,
until each document has one name. With the number of blocks it is the text's identity: two documents have
the same identity if and only if their texts are equal; no hash decides whether documents of different ids are equal (rows of
one id are told apart by the SHA-256 of their texts).

Scale: the text is shuffled twice, once as blocks with their places and once as distinct blocks, after
equal blocks have been merged in each task. Blocks that make up more than a thousandth of all (so at most
a thousand of them, a proven bound) are named from a broadcast table, and their rows are spread over all
partitions, so that a text with a third of all rows is no hot key; groups of that size get their results by a
broadcast too. Later levels move integers only.

Defined cases: null counts as empty; nothing else is changed before the comparison. Of equal texts the row
with the largest doc_id stays (null is the smallest). Rows that repeat in doc_id and text each count
and get a row; one of them stays at most. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlex.llm.tables import join_groups, written

BLOCK = 8192
#: A block is hot from this share of all blocks, and from this number.
HOT_SHARE, HOT_ROWS = 1000, 200
#: Rows that repeat are made in steps of so many.
REPEATS = 4096
#: Stands for the missing right half of a pair; no name is as small.
NONE = -(1 << 62)


def _cut(df: DataFrame, source: str, size: int, place: str, piece: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(source) / size)).cast("int")
    each = df.withColumn(place, F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn(piece, F.substring(F.col(source), F.col(place) * size + 1, F.lit(size))).drop(source)


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """Cut in two steps, as each cut copies what it cuts from: a very long text is copied once for each 64 blocks."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int")
    cut = _cut(_cut(docs.withColumn("n_blocks", n), "body", 64 * block, "part", "piece"), "piece", block, "inner", "block")
    return cut.withColumn("place", F.col("part") * 64 + F.col("inner")).drop("part", "inner")


def _hot(blocks: DataFrame) -> DataFrame | None:
    """Names (negative, in sorted order) of the hot blocks: at most HOT_SHARE rows of one block each."""
    by_hash = blocks.groupBy(F.xxhash64("block").alias("h")).count()
    counts = written(by_hash.filter(F.col("count") >= HOT_ROWS), "block-counts")
    total = blocks.select(F.count(F.lit(1))).first()[0]
    hashes = [r.h for r in counts.filter(F.col("count") * HOT_SHARE > total).select("h").collect()]  # at most HOT_SHARE
    if not hashes:
        return None
    found = blocks.filter(F.xxhash64("block").isin(hashes)).groupBy("block").count().filter(F.col("count") * HOT_SHARE > total)
    rows = sorted(bytes(r["block"]) for r in found.select("block").collect())
    return blocks.sparkSession.createDataFrame([(b, -1 - k) for k, b in enumerate(rows)], "block binary, hot long")


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with names in sorted order of each partition; partitions have ranges of their own."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, key: list[Column] | None = None) -> DataFrame:
    """A row for each different (doc_id, text): doc_id, text_sha256, rows (how often it occurs), the least key of its rows, and its identity n_blocks, name."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), F.struct(*(key or [F.lit(0)])).alias("key"))
    docs = docs.withColumn("digest", F.unhex(F.sha2("body", 256)))
    blocks = _blocks(docs, block).withColumn("row", F.when(F.col("place") == 0, F.col("key"))).drop("key")
    hot = _hot(_blocks(docs.select("body"), block).select("block"))
    if hot is None:
        left, rest = blocks.withColumn("hot", F.lit(None).cast("long")), blocks
    else:
        left, rest = blocks.join(F.broadcast(hot), "block", "left"), blocks.join(F.broadcast(hot), "block", "left_anti")
    names = _named(rest.select("block").groupBy("block").agg(F.count(F.lit(1)).alias("n")).select(F.col("block").alias("b")), ["b"])
    spread = F.concat(F.lit("hot "), F.xxhash64("doc_id", "digest", "place").cast("string")).cast("binary")
    left = left.withColumn("b", F.when(F.col("hot").isNotNull(), spread).otherwise(F.col("block"))).drop("block")
    placed = left.join(names, "b", "left").select("doc_id", "digest", "n_blocks", "place", "row", F.coalesce("hot", "name").alias("name"))
    whole = placed.groupBy("doc_id", "digest").agg(
        F.first("n_blocks").alias("n_blocks"),
        F.count_if(F.col("place") == 0).alias("rows"),
        F.min("row").alias("row"),
        F.array_sort(F.collect_set(F.struct("place", "name"))).getField("name").alias("names"),
    )
    whole = written(whole, "block-names")
    done = [whole.filter("n_blocks = 1")]
    most = whole.agg(F.max("n_blocks")).first()[0] or 1
    level = whole.filter("n_blocks > 1")
    while most > 1:
        level = written(_paired(level), "block-pairs")
        done.append(level.filter("size(names) = 1"))
        level = level.filter("size(names) > 1")
        most = -(-most // 2)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "rows", "row", "n_blocks", F.col("names")[0].alias("name"))


def _paired(level: DataFrame) -> DataFrame:
    """The same documents with half as many names: one for each pair of neighbours."""
    last = F.size("names") - 1
    pair = lambda k: F.struct(
        F.col("names")[k].alias("left"), F.when(k < last, F.col("names")[F.least(k + 1, last)]).otherwise(F.lit(NONE)).alias("right")
    )
    pairs = level.withColumn("pairs", F.transform(F.sequence(F.lit(0), last, F.lit(2)), pair))
    pairs = pairs.select("doc_id", "digest", "n_blocks", "rows", "row", F.posexplode("pairs").alias("place", "pair"))
    pairs = pairs.select("doc_id", "digest", "n_blocks", "rows", "row", "place", "pair.left", "pair.right")
    names = written(_named(pairs.select("left", "right").distinct(), ["left", "right"]), "pair-names")
    named = pairs.join(names, ["left", "right"])
    return named.groupBy("doc_id", "digest").agg(
        F.first("n_blocks").alias("n_blocks"),
        F.first("rows").alias("rows"),
        F.first("row").alias("row"),
        F.array_sort(F.collect_list(F.struct("place", "name"))).getField("name").alias("names"),
    )


def _grouped(found: DataFrame) -> DataFrame:
    """identities with the id that stays, the size of the group, and whether a row of this id and text stays."""
    best = F.max(F.struct("doc_id", "text_sha256")).alias("best")  # null is the least
    groups = found.groupBy("n_blocks", "name").agg(best, F.sum("rows").alias("group_size"), F.count(F.lit(1)).alias("ids"))
    groups = written(groups.filter("ids > 1"), "groups")
    out = join_groups(found, groups, ["n_blocks", "name"], "ids", max(1, found.count()))
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", "rows").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("stays"), "text_sha256", "rows", "row")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _grouped(written(identities(df, doc_id, text, block), "identities"))
    # rows that repeat, in steps, so that no array of all of them is made
    out = out.withColumn("step", F.explode(F.sequence(F.lit(0), ((F.col("rows") - 1) / REPEATS).cast("int"))))
    left = F.least(F.lit(REPEATS), F.col("rows") - F.col("step") * REPEATS).cast("int")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), left)))
    return out.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("step") == 0) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def kept_rows(df: DataFrame, key: list[Column], doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The keys k0, k1, ... of the rows that stay: of equal texts one row, of the largest doc_id."""
    named = [c.alias(f"k{n}") for n, c in enumerate(key)]
    out = _grouped(written(identities(df, doc_id, text, block, named), "identities")).filter("stays")
    return out.select(*[F.col("row").getField(f"k{n}").alias(f"k{n}") for n in range(len(key))])
