"""Operator 8: URL filters with a blocked Bloom filter and an exact join, in DataFrame functions only.

Listed entries are canonical: a lower-case host and the beginning of a path, each with a verdict. An entry
fits its host and all subdomains if the path starts with the entry's. So a URL's possible entries are the
ends of its host at label boundaries, each followed by beginnings of its path; only as many labels and
characters as some entry has are tried. A Bloom filter of the entries, in which all bits of a key lie in
one 64-bit block, passes the keys that may be listed, and an exact hash join with the list removes false
positives. The longest entry wins, and of equally long ones that with the longer host. URLs without an
entry get the default verdict.

The filter is a scalar subquery of at most MAX_BLOCKS longs; more entries than that serves make more false
positives, not other results. The list is broadcast up to BROADCAST_ROWS rows (it is counted first) and joined by
a shuffle beyond. Joins run on different (host, path) pairs with possible hits, not on rows. A second Bloom filter, of the URLs
with a rule, keeps all other rows out of the last join; of the others, those of a URL with more than a thousandth of them get its verdict by a broadcast, and the rest
by a shuffle, so that nothing that grows with the data is broadcast and no URL is a hot key.

Defined cases: a null URL or one without `://` has an empty host and path and fits no entry; if an entry is
listed with both verdicts, it blocks; rows that repeat each get a row; an empty table or list is fine; other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlex.llm.tables import fresh, join_groups, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ENTRY, MAX_BLOCKS, BROADCAST_ROWS = 16, 1 << 21, 20_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of a block."""
    h = F.xxhash64(F.lit(1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter of a column `key`: an array of `blocks` longs."""
    filled = keys.groupBy(_block(F.col("key"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("key"))).alias("mask"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
    word = F.struct("b", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return every.agg(F.array_sort(F.collect_list(word)).getField("mask").alias("bloom"))


def might_contain(filter_array: Column, key: Column, blocks: int) -> Column:
    mask = _mask(key)
    return F.element_at(filter_array, _block(key, blocks) + 1).bitwiseAND(mask) == mask


def _candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys of the entries that a URL could fit."""
    parts = F.split(host, r"\.", -1)
    ends = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    )
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s))))


def judge(df: DataFrame, entries: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """df's columns `keep` with host, path, rule (the entry that decides, or null) and verdict.

    entries: rule_host, rule_path (empty, or from its first slash), verdict (allow or block).
    """
    listed = entries.filter(F.col("rule_host").isNotNull()).select(
        F.concat("rule_host", F.coalesce("rule_path", F.lit(""))).alias("key"),
        F.size(F.split("rule_host", r"\.", -1)).alias("labels"),
        F.length(F.coalesce("rule_path", F.lit(""))).alias("path_length"),
        F.length("rule_host").alias("host_length"),
        "verdict",
    )
    listed = listed.groupBy("key", "labels", "path_length", "host_length").agg(F.max("verdict").alias("verdict"))  # block is after allow
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    keep = [c for c in (keep or df.columns) if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shape.n:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = min(MAX_BLOCKS, max(64, -(-shape.n * BITS_PER_ENTRY // 64)))
    # the array is evaluated once, as a subquery, before the scan starts
    words = bloom(listed.select("key"), blocks).scalar()
    tried = _candidates(F.col("host"), F.col("path"), sorted(shape.labels), sorted(shape.lengths))
    n = fresh(rows, "n")
    possible = rows.select("host", "path", F.explode(tried).alias("key")).filter(might_contain(words, F.col("key"), blocks))
    possible = possible.groupBy("host", "path", "key").agg(F.count(F.lit(1)).alias(n))
    hits = possible.join(F.broadcast(listed) if shape.n <= BROADCAST_ROWS else listed.hint("merge"), "key")
    rank = F.struct(F.col("host_length") + F.col("path_length"), "host_length")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), rank).alias("best"), F.max(n).alias(n))
    best = written(best.select("host", "path", n, F.col("best.key").alias("rule"), "best.verdict"), "url-verdicts")
    found = best.agg(F.count(F.lit(1)).alias("urls"), F.sum(n).alias("rows")).first()
    # a filter of the URLs with a rule: the rows of others take no part in the join
    blocks = min(MAX_BLOCKS, max(64, -(-found.urls * BITS_PER_ENTRY // 64)))
    pair = lambda: F.concat("host", F.lit("\0"), "path")
    with_rule = bloom(best.select(pair().alias("key")), blocks).scalar()
    judged = join_groups(rows.filter(might_contain(with_rule, pair(), blocks)), best, ["host", "path"], n, found.rows or 1).drop(n)
    rest = rows.filter(~might_contain(with_rule, pair(), blocks)).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return judged.unionByName(rest).select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
