import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import oracle
from textlex.llm import bpe, components, exact_dedup, imatch, language_id, mixing, near_dedup, queries, shards, substring_dedup, token_counts, url_filter, word_bpe, words

PATH = public_tokenizers.path(queries.WORD_BPE)
SMALL = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from a warm wall and wonder why anyone would run so fast on such a slow day "
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000)) + "z" * 20_000
#: Nulls, empty and very long texts, ties and rows that repeat; names that clash with added columns.
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "!!! ...", "en"), (5, "a b", "en"), (6, PROSE * 3, "en"), (7, PROSE * 3, "en"), (8, PROSE * 3 + "and more", "en"),
    (9, LONG, "en"), (9, LONG, "en"), (10, "İstanbul ΣΑΣ é <|endoftext|> café's", "de"), (None, "no id here", None), (None, None, None), (11, LONG + " tail", None),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["ids", "decoded", "N_TOKENS", "score", "lang_pred", "kept", "class_id", "shard", "fingerprint", "rate", "n_chars", "source", "host"]


def edge(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return edge(spark)


@pytest.fixture(scope="module")
def model():
    return word_bpe.WordBpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library(model, library):
    rng = random.Random(5)
    parts = ["th", "er", "ing", "é", "ß", "ΣΑ", " ", "\n", "'s", "'re", "12", "...", "<|endoftext|>", "</w>", "日本", "e\u0301", "\u2003", "\x1c", "🙂", "x" * 40]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert model.encode(text) == ids_of(library, text), text
        assert model.decode(model.encode(text)) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_bpe_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, SMALL).collect():
        want = ids_of(library, texts[r.doc_id])
        shown = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_bpe_columns(docs, library):
    rows = bpe.encode_decode(docs, PATH).withColumn("array", bpe.unpack(F.col("ids"))).collect()
    assert len(rows) == len(ROWS)
    for r, (_, text, _) in zip(rows, ROWS, strict=True):
        want = ids_of(library, text)
        assert np.frombuffer(r.ids, "<u4").tolist() == want == (r.array if len(want) < 1000 else want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == len(ROWS)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_token_counts(docs, library, model):
    for r, (_, text, _) in zip(token_counts.token_counts(docs.select("doc_id", "text"), PATH).collect(), ROWS, strict=True):
        assert (r.n_tokens, r.n_bytes) == (len(ids_of(library, text)), len((text or "").encode()))
        assert r.over_limit == (r.n_tokens > 2048)
    assert token_counts.token_counts(docs, PATH).filter("N_TOKENS < 0").count() == 0
    rng = random.Random(3)
    for _ in range(600):
        s = "".join(rng.choice(["a", "b'", "s ", "<|endoftext|>", "é", "the ", "\n", "x" * rng.randrange(9)]) for _ in range(rng.randrange(120)))
        for chunk, overlap in ((5, 1), (8, 3), (40, 10)):
            assert token_counts.count_tokens(model, s, chunk, overlap) == len(model.encode(s))
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_language_id_held_out(spark):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()
    assert len(right) == 2 and all(r[1] > 0.98 for r in right)


def test_language_id_edges(docs):
    known = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, known).collect()} == {"und"}
    some = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, some).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and got[6].lang_pred == "en" and 0 < got[6].score <= 1
    assert language_id.identify_held_out(docs).filter("doc_id is null and held_out").count() == 0
    assert language_id.identify(docs.limit(0), some).count() == 0


def test_filter_returns_all_languages():
    a, b = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(300, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for more in (0, 7, 40, 100):  # one word, wider words, several words
        f = language_id.Filter(["a", *[f"x{k}" for k in range(more)], "b"], [a, *[b[-3:]] * more, b])
        has = lambda k, h: f.containing(h)[:, f.bit(k)[0]] & f.bit(k)[1] > 0  # noqa: E731, B023
        assert has(0, a).all() and has(more + 1, b).all() and not has(0, b[-100:]).any() and has(more + 1, a).sum() == 200
        assert (f.false < 1e-6).all()
    with pytest.raises(ValueError):
        language_id.Filter([str(k) for k in range(1025)], [a] * 1025)


def test_language_id_equals_plain_counts(spark):
    """Sets of n-grams in place of the filter, and a count of each language's."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}

    def grams(text):
        text = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        text = re.sub(" +", " ", text)
        return [text[k : k + n] for n in (2, 3, 4, 5) for k in range(len(text) - n + 1)]

    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        if not held[r.doc_id] and r.text is not None and r.lang is not None:
            counts[r.lang].update(grams(r.text))
            n[r.lang] += 1
    known = {x: {g for g, k in c.items() if k >= 5} for x, c in counts.items()}
    order = sorted(known, key=lambda x: (-n[x], x))
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SMALL).collect()}
    for r in rows:
        hits = {x: sum(g in known[x] for g in grams(r.text)) for x in order}
        best = max(order, key=lambda x: hits[x])
        letters = any(c.isalpha() for c in r.text or "")
        assert got[r.doc_id].held_out == held[r.doc_id] and got[r.doc_id].lang_pred == (best if letters else "und")
        if letters:
            want = hits[best] / sum(hits.values()) * hits[best] / len(grams(r.text))
            assert abs(got[r.doc_id].score - want) < 0.002


def test_unlearned_languages_score_lower(spark):
    import corpus_pipeline

    known = language_id.train(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    odd = ["questa frase parla di montagne e di laghi vicino alla nostra vecchia casa di campagna", "bu cümle dağlar ve göller hakkında konuşuyor ve çok uzun sürüyor", "tämä lause kertoo vuorista ja järvistä jotka ovat kaukana täältä", "xqzjv kwpfh bgtrw zzxcv qqwpr mnbvk"]
    assert all(x < corpus_pipeline.MIN_SCORE for x in known.predict(odd)[1])
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").filter("text rlike '[a-z]{2}'")
    low = language_id.identify(docs, known).filter(F.col("score") < corpus_pipeline.MIN_SCORE).count()
    assert low <= 0.002 * docs.count()


def test_near_dedup(spark, docs):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[:k] + [f"q{k}"] + base[k + 1 :]), "en") for k in range(40)] + [(100 + k, " ".join(f"u{k}v{j}" for j in range(60)), "en") for k in range(30)]
    df = edge(spark, rows)
    got = {r.doc_id: r for r in near_dedup.near_dedup(df).collect()}
    want, _ = brute.near([(i, t) for i, t, _ in rows])
    assert {i: r.class_id for i, r in got.items()} == want and sum(r.kept for r in got.values()) == 31
    assert got[0].class_size == 40
    by_shuffle = near_dedup.near_dedup(df, listed=0).collect()  # frequencies joined to the documents instead of broadcast
    assert {r.doc_id: r for r in by_shuffle} == got
    rows = near_dedup.near_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[6].class_id == by[7].class_id == by[8].class_id == 6 and by[1].class_id == by[2].class_id == 1 and by[3].class_id == 3
    assert sum(r.kept for r in rows if r.doc_id in (9, 11)) == 1 and sum(r.kept for r in rows if r.doc_id is None) == 1
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def template_pages(rng, n, frame, own, edits):
    """n pages that share a frame, each with a copy that has some other words."""
    words = [f"t{k}" for k in range(frame)]
    rows = []
    for k in range(n):
        mine = [f"p{k}x{j}" for j in range(own)]
        rows += [(2 * k, " ".join(words + mine), "en"), (2 * k + 1, " ".join(words + mine[:-edits] + [f"c{k}x{j}" for j in range(edits)]), "en")]
    rows += [(10_000 + k, " ".join(f"f{rng.random()}" for _ in range(6)), "en") for k in range(4000)]
    rng.shuffle(rows)
    return rows


def test_near_dedup_finds_the_links_that_all_pairs_have(spark):
    """Pairs near the threshold among pages that are nearly as alike: at least 0.9 of all links are found, and no wrong one."""
    rows = template_pages(random.Random(6), 200, 300, 30, 22)
    want, links = brute.near([(i, t) for i, t, _ in rows])
    assert len(links) >= 200 and all(a // 2 == b // 2 for a, b in links)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(edge(spark, rows)).filter("doc_id < 10000").collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())


def test_near_dedup_loses_nothing_in_large_buckets(spark):
    """A large group of copies and other pages in its buckets: every two texts with a common band are linked or compared."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: k % 120] + [f"q{k}"] + base[k % 120 + 1 :]), "en") for k in range(700)]
    rows += [(1000 + 2 * k + c, " ".join(base[:100] + [f"o{k}x{j}" for j in range(20)] + [f"e{c}"]), "en") for k in range(60) for c in range(2)]
    rng.shuffle(rows)
    want, _ = brute.near([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(edge(spark, rows)).collect()}
    assert got == want


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    s = near_dedup.Sampler(512)
    g = np.unique(near_dedup.mix(np.arange(1, 1200, dtype=np.uint64)))
    w = rng.choice([1.0, 1.0, 0.5, 2.0], len(g)).astype(np.float32)
    a, b = (g[:900], w[:900]), (g[200:], w[200:])
    same = (s.samples(*a, np.zeros(1, int))[0] == s.samples(*b, np.zeros(1, int))[0]).mean()
    assert abs(same - near_dedup.similarity(a, b)) < 0.08


def test_shingle_frequencies_are_exact(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(300)]
    df = edge(spark, [(k, t, None) for k, t in enumerate(texts)]).repartition(3)
    want = Counter(g for t in texts for g in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    name = {g: int(near_dedup.shingles(near_dedup.Hasher(), [" ".join(g)])[0].view(np.int64)[0]) for g in want}
    got = {r.g: r.n for r in near_dedup.frequent_shingles(df, 300, 300).collect()}
    assert got == {name[g]: n for g, n in want.items() if n >= 2}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {v: v for e in edges for v in e}
    root = lambda v: v if parent[v] == v else root(parent[v])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: root(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    m = mixing.train(d, mixing.by_quality(labels))
    found = mixing.rates(d, m, queries.TARGETS).cache()
    assert found.filter("rate < 0").count() == 0 and found.count() == 10_000
    sums = found.selectExpr("sum(n_tokens) n", *[f"sum(n_tokens * rate * p_{x}) {x}" for x in m.domains]).first()
    assert all(abs(sums[x] / sums.n - queries.TARGETS[x]) < 0.01 for x in m.domains) and sums.toxic / sums.n < 0.01
    rows = found.select("n_tokens", "rate", "residual", *[f"p_{x}" for x in m.domains]).toPandas()
    # equal posteriors have equal rates, and the error reported is the one that is left
    assert (rows.groupby([f"p_{x}" for x in m.domains]).rate.nunique() == 1).all()
    assert abs(max(abs(sums[x] / sums.n - queries.TARGETS[x]) for x in m.domains) - rows.residual[0]) < 1e-4
    # a plain solver that takes many small steps comes no nearer to the targets
    p, n = rows[[f"p_{x}" for x in m.domains]].to_numpy(), rows.n_tokens.to_numpy(float)
    want = np.array([queries.TARGETS[x] for x in m.domains])
    weight, r = n / n.sum(), np.ones(len(n))
    for _ in range(3000):
        r = np.maximum(0, r - p @ (p.T @ (weight * r) - want))
    plain, ours = p.T @ (weight * r) - want, p.T @ (weight * rows.rate.to_numpy()) - want
    assert (ours**2).sum() <= (plain**2).sum() + 1e-5
    of = found.join(labels, "doc_id").groupBy("toxic", "quality").agg(F.avg("p_toxic").alias("p")).collect()
    at = {(r.toxic, r.quality): r.p for r in of}
    assert at[1, 1] > 0.85 and at[0, 1] < 0.03 and at[0, 0] < 0.12


def test_mixing_reachable_targets_are_met(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.dirichlet([0.5] * 4, 300), 4)
    names = list("abcd")
    rows = [(int(k), *map(float, x)) for k, x in zip(rng.integers(0, 900, 300), p)]
    features = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{x} double" for x in names))
    for target in ([0.4, 0.3, 0.2, 0.1], [0.1, 0.1, 0.1, 0.7], [0.9, 0.05, 0.05, 0.0]):
        want = np.array(target) * sum(r[0] for r in rows)
        steps, residual = mixing.fit(features, names, want)
        got = mixing.totals(features, names, mixing.rate(names, steps))
        assert residual < (1e-3 if min(target) else 0.02) and np.abs(got - want).max() / want.sum() < residual + 1e-4


def test_mixing_edges(spark, docs):
    labels = spark.createDataFrame([(6, "x"), (6, "y"), (8, "y"), (9, "z"), (None, "z"), (10, None)], "doc_id long, domain string")
    m = mixing.train(docs, labels)
    assert m.domains == ["y", "z"]  # of several labels of an id, the largest
    out = mixing.mix(docs, m, mixing.shares(m, {"y": 1.0}))
    assert out.count() == len(ROWS) and out.filter("rate is null or rate < 0").count() == 0 and "source" in out.columns
    rows = mixing.rates(docs, m, {"y": 0.5, "z": 0.5}).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in rows) == sorted(((i or 0), len((t or "").split())) for i, t, _ in ROWS)
    assert mixing.rates(docs.limit(0), m, {"y": 1.0}).count() == 0
    none = mixing.train(docs.limit(0), labels)  # no labelled document is there
    assert mixing.rates(docs.limit(0), none, {"y": 1.0}).count() == 0 and mixing.rates(docs, none, {"y": 1.0}).count() == len(ROWS)
    with pytest.raises(ValueError):
        mixing.train(docs, labels.limit(0))
    with pytest.raises(ValueError):
        mixing.train(docs, spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("domain")))


def test_mixing_writes_only_what_is_read_again(spark, monkeypatch):
    d = queries.table(spark, SMALL, "documents")
    names, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: names.append(name) or write(df, name))
    m = mixing.train(d, mixing.by_quality(queries.table(spark, SMALL, "labels")))
    want = mixing.without(m, "toxic")
    rated = mixing.rated_rows(d, m, want).select("doc_id", "rate")
    assert names == ["labelled", "labelled-features", "mixture"]
    assert sorted(rated.collect()) == sorted(mixing.mix(d, m, want).select("doc_id", "rate").collect())


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs, block=64).collect()
    texts = defaultdict(list)
    for i, t, _ in ROWS:
        texts[t or ""].append(i)
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in texts.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_hot_block(spark):
    rows = [(k, PROSE * (1 + k % 2) if k % 3 else f"own {k}" * 20, None) for k in range(700)]
    got = exact_dedup.exact_dedup(edge(spark, rows), block=32)
    assert Counter(r.group_size for r in got.collect()) == {1: 234, 233: 466}


def test_shards(spark, docs, tmp_path):
    many = edge(spark, [(k, PROSE[: k % 90], None) for k in range(3000)] + ROWS)
    rows = shards.slots(many, 7, bucket_bytes=20_000).collect()
    assert len(rows) == 3000 + len(ROWS) and {r.law for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    assert max(map(len, slots.values())) < 1.3 * min(map(len, slots.values()))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 3 and r.doc_id is not None]
    assert order != sorted(order)
    # law: the largest seeded hash of shard and id, computed without Spark
    xx = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def best(i, n):
        start = xx((20260101).to_bytes(4, "little"), 42)
        of = lambda s: xx(s.to_bytes(4, "little"), start)
        return max(range(n), key=lambda s: (signed(of(s) if i is None else xx(i.to_bytes(8, "little"), of(s))), s))

    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), best(i, 7), best(i, 8)) for i, t, _ in [(k, PROSE[: k % 90], None) for k in range(3000)] + ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == texts
    # slots depend on the records and the seed alone
    placed = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = shards.write_shards(many.repartition(5, "text"), str(tmp_path / "s"), 7, bucket_bytes=20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in again.collect()} == placed
    assert "source" in again.columns and {r.text for r in again.filter("doc_id = 9 and length(text) > 100").collect()} == {LONG}
    for file in (tmp_path / "s").glob("shard=*/*.parquet"):  # buckets lie one after the other, in the order of their slots
        found = [r["slot"] for r in pq.read_table(file, columns=["slot"], partitioning=None).to_pylist()]
        assert sum(b != a + 1 for a, b in zip(found, found[1:])) <= 40
    assert shards.slots(docs.limit(0)).count() == 0


def test_shards_deal_rows_that_are_alike(spark):
    many = edge(spark, [(None, "same", None)] * 3000 + [(k, "x" * k, None) for k in range(50)])
    rows = shards._records(many, 3, 1, "doc_id", "text", 10_000)[0].filter("_id is null").groupBy("bucket").count().collect()
    assert len(rows) > 3 and max(r["count"] for r in rows) < 1500
    got = shards.slots(many, 3, 1, bucket_bytes=10_000).collect()
    assert len(got) == 3050 and all(sorted(s) == list(range(len(s))) for s in ([r.slot for r in got if r.shard == k] for k in range(3)))


def test_url_filter(spark):
    urls = [None, "", "no-scheme.net/x", "http://a.NET/x", "https://example.net/en/1?q", "http://x.example.net/en", "http://example.net", "ftp://b.org/fr/#t", "http://org/fr/", "http://notorg/fr/", "http://example.com/de/../x", "http://u@example.com/de/", "x://y://z.net/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(1)})
    entries = spark.createDataFrame(queries.URL_ENTRIES, "rule_host string, rule_path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, entries).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("net/", "block") and got[6][2:] == (None, "allow")
    assert [got[k][2] for k in (7, 8, 9, 10, 11)] == ["org/fr/", "org/fr/", None, "example.com/de/", None] and got[12][0] == "y:"
    assert url_filter.judge(pages, entries).count() == len(urls) + 1
    assert url_filter.judge(pages, entries.limit(0)).filter("verdict = 'allow'").count() == len(urls) + 1
    assert url_filter.judge(pages.limit(0), entries).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    array = url_filter.bloom(keys, 750).scalar()
    passes = lambda df: df.filter(url_filter.might_contain(array, F.col("key"), 750)).count()
    assert passes(keys) == 3000 and passes(spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("key"))) < 600


def test_imatch(spark, docs):
    rows = imatch.with_next(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[6].fingerprint == by[7].fingerprint != by[9].fingerprint and by[1].fingerprint == by[2].fingerprint
    assert by[7].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in rows)
    assert imatch.with_next(docs.limit(0)).count() == 0 and imatch.with_next(docs.filter("doc_id = 6")).first().near_next == 1.0
    assert imatch.fingerprints(docs, "text").count() == len(ROWS)


def test_imatch_equals_plain_version(spark):
    rng = random.Random(11)
    words_ = [f"w{k}" for k in range(400)] + ["é", "Straße", "ÀB"]
    texts = [" ".join(rng.choice(words_) for _ in range(rng.choice((0, 2, 9, 40, 120)))) for _ in range(160)]
    texts += [texts[5], None, "", texts[7] + "!", texts[9].upper()] + ["solo"] * 3
    rows = [(k, t, None) for k, t in enumerate(texts)]
    rows += [(None, f"none {k} w1 w2", None) for k in range(60)] + [(500, f"many {k} w3", None) for k in range(80)]
    df = edge(spark, rows)
    ids = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(rows)], "k int, doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    order = [(r.doc_id, r.text or "") for r in ids.orderBy(F.desc_nulls_last("doc_id"), "tie").collect()]
    want = brute.imatch(order, 0.01, 0.2)
    got = imatch.with_next(df, low=0.01, high=0.2)
    by_shuffle = imatch.with_next(df, low=0.01, high=0.2, most=0)
    for out in (got.collect(), by_shuffle.collect()):
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == Counter(w[:5] for w in want)
        names = {}
        assert len(out) == len(rows)
        assert all(names.setdefault(r.fingerprint, r.n_chars) is not None for r in out)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, by_shuffle.collect()))
    # the same fingerprints for the same terms only
    shown = {r.doc_id: r.fingerprint for r in got.filter("doc_id < 160").collect()}
    terms = {w[0]: w[5] for w in want if w[0] is not None and w[0] < 160}
    assert all((shown[a] == shown[b]) == (terms[a] == terms[b]) for a in shown for b in shown)
    some = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df, "text", 0.01, 0.2).collect()}
    assert {r.doc_id: r.fingerprint for r in imatch.fingerprints(df, "text", 0.01, 0.2, most=0).collect()} == some and some[3] == shown[3]


def test_substring_dedup(spark, docs):
    assert substring_dedup.covers(substring_dedup.PERIOD, substring_dedup.COVER)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    make = lambda: " ".join(rng.choice([passage, "a b c d e", f"r{rng.random()}", "x\ty", "b c"]) for _ in range(rng.randrange(30)))
    rows = [(k, make(), None) for k in range(120)] + [(500 + k, PROSE * 4, None) for k in range(3)] + [(600, None, None), (601, "", None)]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.substring_dedup(edge(spark, rows)).collect()}
    assert got == brute.substring([(i, t) for i, t, _ in rows], 35)
    # ids that repeat, with the same text and with others, and none
    again = [(None if k % 5 == 0 else k % 3 if k % 2 else k, t, None) for k, (_, t, _) in enumerate(rows)] + [(1, PROSE * 2, None), (1, "a b c", None), (2, PROSE * 2 + "x", None), (77, "", None), (77, "", None)]
    for ends in ([], [(-(1 << 63), "low " * 40, None), (1 << 62, "q", None)], [(-(1 << 63), "low " * 40, None), ((1 << 63) - 1, make(), None)]):
        more = again + ends
        out = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.substring_dedup(edge(spark, more)).collect())
        want = brute.substring([(k, t) for k, (_, t, _) in enumerate(more)], 35)
        assert out == Counter((i, *want[k]) for k, (i, _, _) in enumerate(more))
    out = substring_dedup.substring_dedup(docs).collect()
    assert len(out) == len(ROWS) and {r.n_removed for r in out if r.doc_id == 9} == {30_000}
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    h = words.Hasher(unchanged=True)
    texts = [LONG, "word1x1 b", None, "", "b"]
    got, text, first, end, data = h.words(texts)
    assert [data[a:b].decode() for a, b in zip(first, end)] == [w for t in texts for w in (t or "").split()]
    by = defaultdict(set)
    for x, a, b in zip(got.tolist(), first, end):
        by[data[a:b]].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name], SMALL) == ""


def test_pipeline(spark):
    import corpus_pipeline

    out = __spark_entry__.queries()["pipeline"](spark, SMALL)
    rows = out.collect()
    source = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    near, _ = brute.near([(i, r.text) for i, r in source.items()])
    kept = {r.doc_id for r in rows}
    assert len(rows) == len(kept) and len({near[i] for i in kept}) == len(kept)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    classes = set(near.values())
    assert len(kept) >= 0.9 * len(classes - {near[i] for i in toxic})
    library = Tokenizer.from_file(PATH)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids_of(library, source[r.doc_id].text) for r in rows[:20])
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_keeps_the_chosen_rows(spark):
    import corpus_pipeline

    near = PROSE * 3
    rows = [(5, "A"), (7, "A"), (5, "B"), (8, "C"), (8, "D"), (None, "E"), (None, "E"), (None, "F"), (9, "F"), (10, near), (10, near + "more"), (None, near + "and"), (11, None), (12, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_exact_copies(spark, df, SMALL)
    want = Counter([(7, "A"), (5, "B"), (8, "C"), (8, "D"), (None, "E"), (9, "F"), (10, near), (10, near + "more"), (None, near + "and"), (12, "")])
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    got = corpus_pipeline.drop_near_copies(spark, df, SMALL)
    ids = Counter((r.doc_id, (r.text or "")[:9]) for r in got.collect())
    assert ids == Counter([(5, "A"), (5, "B"), (8, "C"), (8, "D"), (None, "E"), (9, "F"), (10, near[:9]), (11, "")])
    six = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b"), (7, "a2"), (8, "a2"), (9, "c")], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, six, SMALL).collect()) == Counter([(None, "a"), (7, "b"), (8, "a2"), (9, "c")])


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_tables(spark, docs, tmp_path, stage):
    """Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    clash = ["key0", "KEY1", "k0", "_k", "_metadata", "row", "rate", "p_toxic", "residual", "_cell", "h1", "bands", "lang_pred", "body", "name", "keep", "n"]
    odd = docs.drop("KEPT").select("*", *[F.lit("x").alias(c) for c in clash if c.lower() not in {x.lower() for x in docs.columns}])
    odd.write.parquet(str(tmp_path / "d"))
    for df in (odd, spark.read.parquet(str(tmp_path / "d"))):
        out = run(spark, df, SMALL)
        rows = out.collect()
        assert stage == 4 or out.columns == df.columns
        texts = Counter((t or "") for _, t, _ in ROWS)
        if name == "exact_dedup":
            assert Counter((r.text or "") for r in rows) == Counter(texts.keys())
        if name in ("mixing", "bpe"):
            assert len(rows) == len(ROWS) if name == "bpe" else len(rows) > 0
        if name == "language":
            assert all(any(c.isalpha() for c in r.text) for r in rows) and rows
        empty = run(spark, df.limit(0), SMALL)
        assert empty.count() == 0 and (stage == 4 or empty.columns == df.columns)
