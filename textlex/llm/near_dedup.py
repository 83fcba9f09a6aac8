"""Operator 4: near-duplicate detection by improved consistent weighted sampling.

A text is the weighted set of its shingles of five words (runs of letters and digits, in lower case). The
weight is TF-IDF: how often the shingle occurs in the text, times 1 + ln(N / df) / ln(1 / RARE), where df is the exact number of
documents with it and counts as RARE N at least. So the factor falls from 2 for a shingle in one of 10,000 documents
to 1 for one in all. Without the added 1 the rare edits of a copy would outweigh what a large group of copies has in common.

HASHES consistent weighted samples (ICWS) of each text agree between two texts with the probability of
their weighted Jaccard similarity. They are banded; texts that share a band are candidates, and a link is a
pair whose exact weighted Jaccard similarity is at least THRESHOLD. Classes are the connected components.

df: each task sends its distinct shingles as sorted, packed blocks of hash ranges, and each range is added up by itself. Only
shingles in more than RARE N documents (two at least) are needed: at most a document's average number of shingles divided by
RARE, whatever the corpus' size. They are counted; up to LISTED of them are broadcast, and more are joined to the documents by a
shuffle, with equal results.

No link is lost between texts that share a band:
1. Texts with the same words are one node, by 128 bits of two independent hashes of the whole sequence.
2. In buckets of up to SMALL nodes the pairs are rows, each different one once.
3. A larger bucket has a lead, its node with the most rows, and each of its nodes is compared with that, a part of the nodes in
   each task. In what is a group of copies this leaves one component.
4. The nodes of all buckets of one lead are a pool. Its pairs are compared, but for those that are both linked to the lead,
   and those whose distances from the lead differ by more than a link's distance may be: one minus weighted Jaccard similarity
   is a metric, so these aren't links. Nodes are dealt into parts of about BLOCK nodes or CHARS characters, of one
   range of distances, all linked to the lead or none, and each two parts that have pairs left are a task's block, in
   which the overlaps are matrix products. So a group of copies costs work in proportion to its size, and only nodes that share a
   band, are not linked and are equally far from their lead cost pairs.

Defined cases: texts of one to four words are linked to texts with the same words only, and texts without
words (null counts as empty) to equal ones. The class id is the least doc_id of the class (a null is the largest); that row
stays, and one of several rows that repeat it. An empty table gives an empty result; columns other than doc_id and text
don't matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlex.llm.arrow import release, slices, small_batches
from textlex.llm.components import components
from textlex.llm.tables import join_groups, written
from textlex.llm.words import U64, Hasher, mix, of_sequences, packed, unpacked, windows

WIDTH, THRESHOLD, BANDS, ROWS, SMALL, RARE, LISTED = 5, 0.8, 16, 4, 16, 1e-4, 4_000_000
HASHES = BANDS * ROWS
#: Nodes and characters of a part of a large bucket, and features that are multiplied at once.
BLOCK, CHARS, FEATURES = 256, 2_000_000, 1 << 12
#: Overlaps are products of 32-bit floats; similarities so near to the threshold are computed again one by one.
NEAR = 1e-3
#: Shingles that a task sorts at once.
CHUNK = 4_000_000


def shingles(hasher: Hasher, texts: list[str | None]):
    """Of all texts: distinct shingles (hash, text's index, how often), by text and hash; two hashes of the word sequence and the number of words."""
    h, text, *_ = hasher.words(texts)
    whole, n = of_sequences(h, text, len(texts))
    other, _ = of_sequences(h, text, len(texts), 1)
    g, at = windows(h, text, WIDTH)
    owner = text[at]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])))) if len(g) else np.zeros(0, np.int64)
    return g[first], owner[first], np.diff(np.append(first, len(g))), (whole, other), n


class Idf:
    """The weight factor of shingles: from sorted hashes and document frequencies, or from those listed with each text."""

    def __init__(self, total: int, g: np.ndarray | None, n: np.ndarray | None):
        self.total, self.g, self.n = max(total, 1), g, n
        if g is not None:
            self.coarse = np.zeros(1 << 20, bool)
            self.coarse[g >> U64(44)] = True

    def factor(self, df: np.ndarray) -> np.ndarray:
        return (1 + np.log(self.total / np.maximum(df, RARE * self.total)) / math.log(1 / RARE)).astype(np.float32)

    def of(self, g: np.ndarray, owner: np.ndarray | None = None, listed: list | None = None) -> np.ndarray:
        """Of shingles by text and hash; listed: for each text its (hashes, frequencies), sorted."""
        df = np.ones(len(g))
        if self.g is not None:
            at = np.flatnonzero(self.coarse[g >> U64(44)])
            self._put(df, g, at, self.g, self.n)
        else:
            edge = np.searchsorted(owner, np.arange(len(listed) + 1))
            for k, (known, n) in enumerate(listed):
                self._put(df, g, np.arange(edge[k], edge[k + 1]), known, n)
        return self.factor(df)

    @staticmethod
    def _put(df, g, at, known, n) -> None:
        if len(at) and len(known):
            near = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            hit = known[near] == g[at]
            df[at[hit]] = n[near[hit]]


def _listed(part: pa.RecordBatch | pa.Table, name: str = "listed") -> list:
    """For each row its sorted (hashes, frequencies)."""
    return [unpacked(x) if x else (np.zeros(0, U64), np.zeros(0, np.int64)) for x in part.column(name).to_pylist()]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / max(float(a[1].sum()) + float(b[1].sum()) - low, 1e-12)


class Sampler:
    """ICWS: for hash k and a shingle of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) of the shingle,
    t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b + 1) is the sample, as (shingle, t).

    r, c and b come from a table of 65,536 triples, picked by a hash of shingle and k.
    """

    def __init__(self, hashes: int = HASHES):
        rng = np.random.Generator(np.random.PCG64(7))
        n = 1 << 16
        r, log_c, b = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
        self.r, self.per_r, self.b = r.astype(np.float32), (1 / r).astype(np.float32), b.astype(np.float32)
        self.base = (log_c + r * b - r).astype(np.float32)  # the rank where t is 0
        self.factor = mix(np.arange(1, hashes + 1, dtype=U64)) | U64(1)
        self.known: dict[np.float32, np.ndarray] = {}

    @staticmethod
    def _rank(x: np.ndarray) -> np.ndarray:
        """Floats as integers of the same order, in the upper half."""
        bits = x.view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U64) << U64(32)

    def _keys(self, pick, log_w) -> np.ndarray:
        """Rank in the upper half, and what tells t in the lower one."""
        t = np.floor(log_w * self.per_r[pick] + self.b[pick])
        shown = t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        return self._rank(self.base[pick] - self.r[pick] * t) | shown

    def samples(self, g: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A row of 32-bit sample names for each text; start: of each text's first shingle."""
        out = np.empty((len(start), len(self.factor)), np.uint32)
        name = g & U64(0xFFFFFFFF)
        log_w = np.log(weight.astype(np.float32))
        # most shingles are rare and occur once: the keys of their weight are looked up
        common = np.float32(np.median(log_w))
        if common not in self.known:
            self.known = {common: self._keys(np.arange(1 << 16), common)}
        plain, odd = self.known[common], np.flatnonzero(log_w != common)
        log_odd = log_w[odd]
        for k, factor in enumerate(self.factor):
            pick = (g * factor) >> U64(48)
            key = plain[pick]
            if len(odd):
                key[odd] = self._keys(pick[odd], log_odd)
            out[:, k] = np.minimum.reduceat(key ^ name, start).astype(np.uint32)
        return out

    def bands(self, g, weight, start) -> np.ndarray:
        s = self.samples(g, weight, start).astype(U64)
        out = np.zeros((len(start), BANDS), U64)
        for b in range(BANDS):
            h = np.full(len(start), b + 1, U64)
            for k in range(ROWS):
                h = mix(h * U64(0xD6E8FEB86659FD93) + s[:, b * ROWS + k])
            out[:, b] = h
        return out


def _blocks_of_shingles(ranges: int):
    """(range, packed block): the distinct shingles of a chunk of documents and in how many they are, cut into ranges of hashes."""
    shift = U64(64 - (ranges.bit_length() - 1))

    def run(batches):
        hasher, held, size = Hasher(), [], 0

        def flush():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(g >> shift, np.arange(ranges + 1).astype(U64))
            bodies, at = [], []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                bodies.append(packed(g[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]))
                at.append(k)
            for k in range(0, len(at), 256):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 256], pa.int32()), pa.array(bodies[k : k + 256], pa.binary())], names=["range", "body"])

        for part in slices(batches):
            held.append(shingles(hasher, part.column("text").to_pylist())[0])
            size += len(held[-1])
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _frequent(least: float):
    """(g, n) of the shingles of each range that are in at least so many documents; ranges come one after the other."""

    def run(batches):
        held, now = [], None

        def flush():
            if not held:
                return
            g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            total = np.add.reduceat(n, first)
            often = total >= least
            g, total = g[first][often], total[often]
            for k in range(0, len(g), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[k : k + 50_000].view(np.int64)), pa.array(total[k : k + 50_000])], names=["g", "n"])

        for batch in batches:
            for at, body in zip(batch.column("range").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if at != now:
                    yield from flush()
                    held, now = [], at
                held.append(unpacked(body))
        yield from flush()

    return run


def frequent_shingles(docs: DataFrame, total: int, chars: int) -> DataFrame:
    """(g, n): the shingles in at least RARE of all documents, and two, with the exact numbers of documents."""
    ranges = 1 << min(18, max(8, int(chars / 6 / CHUNK).bit_length()))
    sent = docs.select("text").mapInArrow(_blocks_of_shingles(ranges), "range int, body binary")
    dealt = sent.repartition("range").sortWithinPartitions("range")
    return written(dealt.mapInArrow(_frequent(max(2, RARE * total)), "g long, n long"), "frequent-shingles")


def _names(whole: tuple[np.ndarray, np.ndarray], n: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that name each text's words; of texts without words, their characters."""
    one, other = (w.copy() for w in whole)
    for k in np.flatnonzero(n == 0):
        digest = hashlib.blake2b((texts[k] or "").encode("utf-8", "replace"), digest_size=16).digest()
        one[k], other[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return one.view(np.int64), other.view(np.int64)


def _listed_rows(batches):
    """(h1, h2, g) of the distinct shingles of each text."""
    hasher = Hasher()
    for part in slices(batches):
        texts = part.column("text").to_pylist()
        g, owner, _, whole, n = shingles(hasher, texts)
        one, other = _names(whole, n, texts)
        for k in range(0, len(g), 100_000):
            at = owner[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.array(other[at]), pa.array(g[k : k + 100_000].view(np.int64))], names=["h1", "h2", "g"])


def _pack_listed(batches):
    for batch in batches:
        found = batch.column("found")
        bodies = []
        for row in found:
            g, n = row.values.field("g").to_numpy().view(U64), row.values.field("n").to_numpy()
            order = np.argsort(g)
            bodies.append(packed(g[order], n[order]))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(bodies, pa.binary())], names=["h1", "h2", "listed"])


def _with_listed(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """docs with the packed frequencies of each text's frequent shingles, by shuffles only."""
    names = docs.mapInArrow(_named(docs.columns), T.StructType([*docs.schema, *_HASHES]))
    each = docs.select("text").mapInArrow(_listed_rows, "h1 long, h2 long, g long").distinct().join(frequent, "g")
    lists = each.groupBy("h1", "h2").agg(F.collect_list(F.struct("g", "n")).alias("found"))  # of one text
    lists = lists.mapInArrow(_pack_listed, "h1 long, h2 long, listed binary")
    return names.join(lists, ["h1", "h2"], "left").select(*docs.columns, "listed")


_HASHES = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def _named(stay: list[str] | None = None):
    """Each row with its node's two hashes; with the columns that stay, or its text packed."""

    def run(batches):
        hasher, to = Hasher(), zstandard.ZstdCompressor(level=1)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            h, text, *_ = hasher.words(texts)
            whole, n = of_sequences(h, text, len(texts))
            one, other = _names((whole, of_sequences(h, text, len(texts), 1)[0]), n, texts)
            if stay:
                columns = {c: part.column(c) for c in stay}
            else:
                body = [to.compress((t or "").encode("utf-8", "replace")) for t in texts]
                columns = {"doc_id": part.column("doc_id"), "size": pa.array([len(t or "") for t in texts], pa.int64()), "body": pa.array(body, pa.binary()), "listed": part.column("listed")}
            columns |= {"h1": pa.array(one), "h2": pa.array(other)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _signatures(idf, stay: list[str]):
    def run(batches):
        hasher, sampler, factor = Hasher(), Sampler(), idf.value
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            g, owner, tf, whole, n = shingles(hasher, texts)
            bands: list = [None] * len(texts)
            if len(g):
                start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                weight = factor.of(g, owner, _listed(part) if factor.g is None else None) * tf.astype(np.float32)
                found = sampler.bands(g, weight, start).view(np.int64)
                for row, k in enumerate(owner[start].tolist()):
                    bands[k] = found[row]
            one, other = _names(whole, n, texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), pa.array(one), pa.array(other), pa.array(bands, pa.list_(pa.int64()))], names=[*stay, "h1", "h2", "bands"])

    return run


class _Weighted:
    """Weighted shingles of packed texts, a few of them kept."""

    def __init__(self, idf: Idf):
        self.idf, self.hasher, self.unpack, self.held = idf, Hasher(), zstandard.ZstdDecompressor(), {}

    def of(self, node: int, body: bytes, listed: bytes | None):
        if node not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            g, owner, tf, *_ = shingles(self.hasher, [self.unpack.decompress(body).decode()])
            known = [unpacked(listed) if listed else (np.zeros(0, U64), np.zeros(0, np.int64))] if self.idf.g is None else None
            self.held[node] = g, self.idf.of(g, owner, known) * tf.astype(np.float32)
        return self.held[node]


def _linked(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _similar(idf, threshold: float):
    def run(batches):
        weights = _Weighted(idf.value)
        for part in slices(batches):
            rows = zip(*(part.column(c).to_pylist() for c in ("u", "v", "a", "b", "la", "lb")), strict=True)
            near = [(u, v) for u, v, a, b, la, lb in rows if similarity(weights.of(u, a, la), weights.of(v, b, lb)) >= threshold]
            yield _linked([u for u, _ in near], [v for _, v in near])

    return run


def _led(idf):
    """Of a lead (the row whose node is the lead) and a part of its candidates: how far each is from it."""

    def run(rows: pa.Table) -> pa.Table:
        weights = _Weighted(idf.value)
        lead = rows.column("u")[0].as_py()
        every = list(zip(*(rows.column(c).to_pylist() for c in ("node", "body", "listed")), strict=True))
        own = next(weights.of(*x) for x in every if x[0] == lead)
        rest = [x for x in every if x[0] != lead]
        away = [1 - similarity(own, weights.of(*x)) for x in rest]
        release()
        return pa.table({"u": pa.array([lead] * len(rest), pa.int64()), "node": pa.array([x[0] for x in rest], pa.int64()), "away": pa.array(away, pa.float64())})

    return run


def _overlaps(owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The common weight of each of `one` with each of `other`, for features (owner, feature, weight) of n texts."""
    _, at = np.unique(feature, return_inverse=True)
    several = np.bincount(at)[at] > 1
    owner, at, weight = owner[several], at[several], weight[several]
    order = np.argsort(at, kind="stable")
    owner, at, weight = owner[order], at[order], weight[order]
    at = np.cumsum(np.diff(at, prepend=at[:1]) > 0)
    out = np.zeros((len(one), len(other)), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, FEATURES):
        a, b = np.searchsorted(at, (first, first + FEATURES))
        has, heavy = np.zeros((n, FEATURES), np.float32), np.zeros(FEATURES, np.float32)
        has[owner[a:b], at[a:b] - first] = 1
        heavy[at[a:b] - first] = weight[a:b]
        out += (has[one] * heavy) @ has[other].T
    return out


def _spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each one's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(idf, threshold: float):
    """Of two parts of a pool (or one): links that span the components of its links."""

    def run(rows: pa.Table) -> pa.Table:
        factor, unpack = idf.value, zstandard.ZstdDecompressor()
        node, part, away = (rows.column(c).to_numpy() for c in ("node", "part", "away"))
        linked = rows.column("linked").to_numpy(zero_copy_only=False)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        one, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
        test = ~(linked[one][:, None] & linked[other][None, :]) & (np.abs(away[one][:, None] - away[other][None, :]) <= 1 - threshold + NEAR)
        if i == j:
            test = np.triu(test, 1)
        one, other, test = one[test.any(1)], other[test.any(0)], test[test.any(1)][:, test.any(0)]
        n, u, v = len(node), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(one):
            used = np.unique(np.concatenate((one, other)))
            bodies = rows.column("body")
            g, owner, tf, *_ = shingles(Hasher(), [unpack.decompress(bodies[k].as_py()).decode() for k in used.tolist()])
            idf_of = factor.of(g, owner, _listed(rows.take(pa.array(used))) if factor.g is None else None)
            owner = used[owner]
            weight = idf_of * tf.astype(np.float32)
            total = np.bincount(owner, weight, n)
            # the k-th time of a shingle is a feature of its own: the lesser of two numbers of times is how many they share
            nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
            feature = np.where(nth == 0, np.repeat(g, tf), mix(np.repeat(g, tf) + nth.astype(U64) * U64(0x9E3779B97F4A7C15)))
            low = _overlaps(np.repeat(owner, tf), feature, np.repeat(idf_of, tf), n, one, other).astype(np.float64)
            s = low / np.maximum(total[one][:, None] + total[other][None, :] - low, 1e-12)
            start = np.searchsorted(owner, np.arange(n + 1))
            of = lambda k: (g[start[k] : start[k + 1]], weight[start[k] : start[k + 1]])
            for x, y in np.argwhere(test & (np.abs(s - threshold) < NEAR)):
                s[x, y] = similarity(of(one[x]), of(other[y]))
            x, y = np.nonzero(test & (s >= threshold))
            u, v = one[x], other[y]
        lead = _spanning(n, u, v)
        has = np.flatnonzero(lead != np.arange(n))
        release()
        return pa.Table.from_batches([_linked(node[has], node[lead[has]])])

    return run


def _small_links(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The links among all pairs of nodes that share a bucket."""
    one, other = (members.select("bucket", F.col("node").alias(c)) for c in "uv")
    pairs = written(one.join(other, "bucket").filter("u < v").select("u", "v").distinct(), "pairs")
    of_u = texts.select(F.col("node").alias("u"), F.col("body").alias("a"), F.col("listed").alias("la"))
    of_v = texts.select(F.col("node").alias("v"), F.col("body").alias("b"), F.col("listed").alias("lb"))
    both = pairs.join(of_v, "v").join(of_u, "u").select("u", "v", "a", "b", "la", "lb")
    return written(both.mapInArrow(_similar(idf, threshold), "u long, v long"), "small-links")


def _parts(n: str = "n", size: str = "size"):
    """Parts for so many nodes with so many characters."""
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / CHARS)).cast("int")


def _lead_distances(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(u, node, size, away): each node of the large buckets of lead u and how far it is from it."""
    sizes = texts.select("node", "size")
    pairs = written(members.filter("node <> u").select("u", "node").distinct().join(sizes, "node"), "lead-pairs")
    pools = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).select("u", _parts("n", "all").alias("parts"))
    own = pools.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("u", "part", F.col("u").alias("node"))
    dealt = pairs.join(pools, "u").select("u", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node").unionByName(own)
    rows = dealt.join(texts.select("node", "body", "listed"), "node")
    found = written(rows.groupBy("u", "part").applyInArrow(_led(idf), "u long, node long, away double"), "lead-distances")
    lead = found.select("u").distinct().select("u", F.col("u").alias("node"), F.lit(0.0).alias("away"))
    return written(found.unionByName(lead).join(sizes, "node"), "pools")


def _pool_links(away: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The links among nodes of a pool that aren't both linked to its lead."""
    step = (1 - threshold + NEAR) / 2  # so links lie in ranges of distances that are two apart at most
    kind = ["u", "range", "linked"]
    rows = away.withColumns({"range": F.floor(F.col("away") / step).cast("int"), "linked": F.col("away") <= 1 - threshold})
    sizes = rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).select(*kind, _parts("n", "all").alias("parts"))
    part = lambda k: F.xxhash64("range", "linked", k)
    parts = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part", part(F.col("k")))
    side = lambda name: parts.select("u", F.col("part").alias(name), F.col("range").alias(f"{name}_range"), F.col("linked").alias(f"{name}_linked"))
    blocks = side("i").join(side("j"), "u").filter("i <= j and abs(i_range - j_range) <= 2 and not (i_linked and j_linked)").select("u", "i", "j")
    ends = blocks.withColumn("part", F.explode(F.array_distinct(F.array("i", "j"))))
    dealt = rows.join(sizes, kind).withColumn("part", part(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    dealt = dealt.select("u", "part", "node", "away", "linked").join(ends, ["u", "part"])
    return written(dealt.join(texts.select("node", "body", "listed"), "node").groupBy("u", "i", "j").applyInArrow(_block(idf, threshold), "u long, v long"), "pool-links")


def _classes(docs: DataFrame, threshold: float, small: int, listed: int) -> tuple[DataFrame, DataFrame, int]:
    """docs: doc_id, text and columns that are carried along. All rows without their text, with row (a number), h1, h2; (h1, h2, rows,
    class_id, class_size, first) of all nodes, first being the row that stays; number of rows."""
    spark = docs.sparkSession
    small_batches(spark)
    total, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    frequent = frequent_shingles(docs, total, chars)
    if frequent.count() <= listed:
        found = frequent.toArrow()
        g, n = found.column("g").to_numpy().view(U64), found.column("n").to_numpy()
        order = np.argsort(g)
        idf = spark.sparkContext.broadcast(Idf(total, g[order], n[order]))
        docs = docs.withColumn("listed", F.lit(None).cast("binary"))
    else:
        idf = spark.sparkContext.broadcast(Idf(total, None, None))
        docs = written(_with_listed(docs, frequent), "listed")

    stay = [c for c in docs.columns if c not in ("text", "listed")] + ["row"]
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    more = [T.StructField("bands", T.ArrayType(T.LongType()))]
    named = written(numbered.mapInArrow(_signatures(idf, stay), T.StructType([*(numbered.schema[c] for c in stay), *_HASHES, *more])), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = named.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.filter("bands is not null").select("node", "rows", F.explode("bands").alias("bucket"))
    lead = F.max(F.struct("rows", "node")).getField("node").alias("u")
    shared = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), lead).filter("n > 1"), "buckets")
    members = written(members.drop("rows").join(shared, "bucket"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "h1", "h2", F.col("first.doc_id").alias("doc_id")), "node")
    bodies = docs.mapInArrow(_named(), T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("size", T.LongType()), ("body", T.BinaryType()), ("listed", T.BinaryType()))), *_HASHES]))
    same = [bodies[c].eqNullSafe(wanted[c]) for c in ("h1", "h2", "doc_id")]  # so that copies with other ids aren't on one key
    texts = written(bodies.join(wanted, same).select("node", "size", "body", "listed").dropDuplicates(["node"]), "texts")
    links = _small_links(members.filter(F.col("n") <= small), texts, idf, threshold)
    away = _lead_distances(members.filter(F.col("n") > small), texts, idf)
    near = away.filter((F.col("away") <= 1 - threshold) & (F.col("u") != F.col("node"))).select("u", F.col("node").alias("v"))
    found = written(components(links.unionByName(near).unionByName(_pool_links(away, texts, idf, threshold))), "components")

    nodes = nodes.select("h1", "h2", "node", "first", "rows").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "node-classes")
    classes = nodes.groupBy("component").agg(F.min("first").alias("best"), F.sum("rows").alias("class_size"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    nodes = join_groups(nodes.drop("first"), classes, ["component"], "n", total)
    return named.drop("bands"), nodes.select("h1", "h2", "rows", F.col("best.doc_id").alias("class_id"), "class_size", F.col("best.row").alias("first")), total


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, small: int = SMALL, listed: int = LISTED, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: doc_id, class_id, class_size, kept, and columns of df to be carried along, by new name."""
    carry = carry or {}
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[c.alias(n) for n, c in carry.items()])
    rows, nodes, total = _classes(docs, threshold, small, listed)
    out = join_groups(rows, nodes, ["h1", "h2"], "rows", total)
    return out.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"), *carry)


def kept_rows(df: DataFrame, key: list[Column], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The keys k0, k1, ... of the rows that stay: one of each class."""
    carry = {f"k{n}": c for n, c in enumerate(key)}
    return near_dedup(df, doc_id, text, threshold, carry=carry).filter("kept").select(*carry)
