import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textlex.operators import lexicon
from textlex.sources import files, pack
from textlex.streaming import counts

ENTRY = {"word": "ez", "lemma": "ez", "normalized": "ez", "part_of_speech": "pron", "frequency": 1, "status": "approved"}


def entry(word):
    return ENTRY | {"word": word, "lemma": word, "normalized": word, "regions": ["general"], "sources": [], "token_count": 2, "document_count": 1, "zipf_milli": 3}


def test_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Derî.\n  Nan.\n", encoding="utf-8")
    rows = files.import_corpus(spark, str(tmp_path / "a.txt"), "c").orderBy("source_record").collect()
    assert [(r.document_id, r.text) for r in rows] == [("a.txt:1", "Derî."), ("a.txt:2", "Nan.")]
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    with pytest.raises(PySparkException):
        files.import_corpus(spark, str(tmp_path / "b.txt"), "c").collect()
    (tmp_path / "c.jsonl").write_text('{"k": "1", "t": "ez"}\n{"k": "1", "t": "tu"}\n')
    docs = files.import_corpus(spark, str(tmp_path / "c.jsonl"), "c", "jsonl", "k", "t")
    assert files.repeated_ids(docs).first().document_id == "c.jsonl:1"
    sums = files.checksums(spark, str(tmp_path))
    assert files.manifest_difference(sums, sums).count() == 0 and files.manifest_difference(sums, sums.limit(1)).count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = {f"f{k}.txt": [f"line {k} {j} " + "x" * (j % 50) for j in range(2000)] for k in range(3)}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\r\n".join(rows) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = files.read_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.source_file, r.line_num, r.line) for r in got) == sorted((n, j + 1, x) for n, rows in lines.items() for j, x in enumerate(rows))
    assert len({r.source_sha256 for r in got}) == 3


def test_lexicon_and_cases(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(json.dumps(ENTRY) + "\n\n")
    assert files.read_lexicon(spark, str(tmp_path / "l.jsonl")).first().sources == []
    (tmp_path / "m.jsonl").write_text('{"word": "ez"}\n')
    with pytest.raises(PySparkException):
        files.read_lexicon(spark, str(tmp_path / "m.jsonl")).collect()
    (tmp_path / "n.jsonl").write_text('{"context": ["a", "b"], "expected": ["c"]}\n{"context": "a"}\nnonsense\n')
    assert [r.context for r in files.read_cases(spark, str(tmp_path / "n.jsonl")).collect()] == [["a", "b"], ["a"]]
    (tmp_path / "d.dic").write_text("1\nAC\\/DC/AN po:noun\n", encoding="utf-8")
    row = lexicon.parse_lines(files.read_dictionary(spark, str(tmp_path / "d.dic"))).filter("event = 'Parsed'").first()
    assert (row.word, row.flags, row.part_of_speech) == ("AC/DC", "AN", "noun")


def test_registry(spark):
    toml = '[[corpus]]\ncorpus_id = "a"\nurl = "https://x/main/y"\nfiles = [{path = "a/b", sha256 = "' + "0" * 64 + '"}, {path = "../b", sha256 = "x"}]\n'
    assert [r.p for r in files.read_registry(spark, toml, "corpus").select(files.registry_problem().alias("p")).collect()] == ["MOVING_URL", "PATH"]


def test_pack_round_trip(spark, tmp_path):
    words = [entry(w) for w in ("bo", "ez", "ji")]
    bi, tri = [("ez", "ji", 3, 700_000), ("ez", "bo", 1, 300_000)], [("ez", "ji", "bo", 2, 1_000_000)]
    data = pack.encode(words, bi, tri)
    assert pack.decode(data) == (words, bi, tri) and pack.header(data)["entries"] == 3
    start = pack.header(data)["start"]
    for bad in (b"XXXX" + data[4:], data[:4] + struct.pack("<I", 5) + data[8:], data[:-1], data + b"x", data[:start] + bytes([data[start] ^ 1]) + data[start + 1 :], data[:20], b""):
        with pytest.raises(pack.PackError):
            pack.decode(bad)
    with pytest.raises(pack.PackError):
        pack.encode([entry("x" * 70_000)], [], [])
    (tmp_path / "p.bin").write_bytes(data)
    assert pack.read(spark, str(tmp_path / "p.bin"))[1].count() == 2


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", "ez ji bo ez")], "document_id string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    counts.accumulate(stream, out, state).awaitTermination()
    spark.createDataFrame([("2", "ez")], "document_id string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    counts.accumulate(stream, out, state).awaitTermination()
    got = {r.word: (r.token_count, r.document_count) for r in counts.total(spark.read.parquet(out)).collect()}
    assert got == {"ez": (3, 2), "ji": (1, 1), "bo": (1, 1)}
    assert counts.word_counts(stream).isStreaming


def test_report(spark, tmp_path):
    files.write_report(spark.range(3).select(F.col("id")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
