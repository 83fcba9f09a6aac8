"""Runs of words, packed for one shuffle."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlex.functions import text as T
from textlex.operators import ngrams, runs
from textlex.plans import documents

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "...", "a", "a b", "a b c. a b c! x", "á b c. ́a b c", "ΑΣ.ΒΣ ΑΣ Α. ΑΣ", "one  two\nthree\tfour five", "x x x x x x x", "n0 \x01q ۔r s t… u v w", "Σ. .Σ a b", "İI ß SS ﬁ K"]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_top_trigrams_shuffle_texts_once(spark):
    """the runs' texts were shuffled by run, by context and again for a join, 7 times the input."""
    docs = spark.createDataFrame([("a b c",)], "text string")
    top = ngrams.most_frequent(ngrams.model(docs, 3), 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert exchanges(top) == 1 and "Join" not in plan and "hashpartitioning(bucket" in plan


def test_trigrams_of_the_query_shuffle_once(spark):
    """the only other shuffle is that of a small table of one file."""
    q = documents.QUERIES["trigrams"](spark, SMALL)
    assert exchanges(q) == 2 and "Join" not in q._jdf.queryExecution().executedPlan().toString()


def test_trigrams_broadcast_nothing(spark):
    """Spark took the sums of all contexts for small and broadcast them; at 0.10 GB a driver of 1 GB could not build that table."""
    q = documents.QUERIES["trigrams"](spark, SMALL)
    assert q.collect() and "Broadcast" not in q._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [2, 3])
def test_counts_equal_plain_counts(spark, n):
    docs = spark.createDataFrame([(t,) for t in ODD], "text string")
    names = [*ngrams.CONTEXT[n], "next"]
    got = {tuple(r[c] for c in names): r["count"] for r in ngrams.raw_counts(docs, n).collect()}
    want = Counter()
    for (w,) in docs.select(F.explode(T.sentences(F.col("text"))).alias("s")).select(T.tokens(F.col("s"))).collect():
        want.update(zip(*[w[k:] for k in range(n)]))
    assert got == dict(want) and len(got) > 10


@pytest.mark.parametrize("n", [2, 3])
def test_packing_keeps_each_run_in_its_contexts_bucket(n, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 5)  # many parts, whose counts are added later
    monkeypatch.setattr(runs, "BYTES", 20)
    lists = [["a", "b", "c", "a", "b", "c"], [], None, ["b"], ["a", "b", "c", "é", "x"], ["x"] * 9]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 2], pa.list_(pa.string()))], ["w"]) for i in range(0, 6, 2)]
    got, home = Counter(), {}
    for packed in runs._packer(n, 7)(iter(batches)):
        for bucket, text in zip(*(c.to_pylist() for c in packed.columns)):
            for line in text.split("\n"):
                words = line.split(" ")
                context = tuple(words[: n - 1])
                assert home.setdefault(context, bucket) == bucket
                for w in words[n - 1 :]:
                    w, _, times = w.partition("\t")
                    got[(*context, w)] += int(times or 1)
    assert got == Counter(run for w in lists for run in zip(*[(w or [])[k:] for k in range(n)]))


def test_tables_of_many_files_are_not_moved(spark, tmp_path):
    """a shuffle of whole texts that have splits enough."""
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4).write.parquet(path)
    assert exchanges(documents.docs(spark, str(tmp_path))) == 0 and exchanges(documents.docs(spark, SMALL)) == 1


def test_violations_sort_by_a_hash_first(spark):
    """runs were sorted by their texts; repeated ones are still found, of whatever context count."""
    grams = spark.createDataFrame([("a", "b", "c", 2, 4, 500_000), ("a", "b", "c", 2, 4, 500_000), ("a", "b", "d", 2, 4, 500_000), ("b", "b", "c", 5, 4, 1_000_000)], "previous_2 string, previous_1 string, next string, count long, context_count long, probability_millionths long")
    bad = ngrams.violations(grams, 3)
    assert sorted(r[:3] for r in bad.collect()) == [("a", "b", "c"), ("a", "b", "c"), ("b", "b", "c")] and bad.columns == grams.columns
    assert "xxhash64" in bad._jdf.queryExecution().executedPlan().toString()
