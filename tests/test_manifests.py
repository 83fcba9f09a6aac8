import hashlib
import json

import pytest

from textlex.plans import inline, reviews
from textlex.sources import manifests, pack
from textlex.sources.manifests import ManifestError

LINES = {"a/one.txt": "Nan.\nAv.\n", "a/two.txt": "Mal.\n", "b/docs.jsonl": '{"id": "1", "text": "Derî vebû."}\n{"id": "2", "text": "Sêv ket."}\n'}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def root(tmp_path):
    for name, text in LINES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = lambda *names: ", ".join(f'{{path = "{n}", sha256 = "{digest(LINES[n])}"}}' for n in names)
    (tmp_path / "corpora.toml").write_text(
        f"""[[corpus]]
corpus_id = "beta"
corpus_name = "Dialogue two"
license = "CC0-1.0"
document_format = "jsonl"
document_id_field = "id"
text_field = "text"
files = [{files("b/docs.jsonl")}]

[[corpus]]
corpus_id = "alpha"
corpus_name = "Text one"
license = "CC-BY-4.0"
author = "A. Writer"
url = "https://files.example/{"a" * 40}/x"
version = "{"a" * 40}"
files = [{files("a/one.txt", "a/two.txt")}]
""",
        encoding="utf-8",
    )
    return tmp_path


def test_import_all(spark, root):
    known = manifests.corpora(root / "corpora.toml")
    assert [c.corpus_id for c in known] == ["alpha", "beta"] and manifests.pinned(known[0]) and not manifests.pinned(known[1])
    target = root / "imported"
    made = manifests.import_all(spark, root / "corpora.toml", root, target)
    assert [(e["corpus_id"], e["document_count"]) for e in made["corpora"]] == [("alpha", 3), ("beta", 2)]
    assert manifests.verify_import(spark, root / "corpora.toml", target) == made
    docs = manifests.documents(spark, target, ["alpha", "beta"]).collect()
    assert {(r.document_id, r.text) for r in docs} == {("one.txt:1", "Nan."), ("one.txt:2", "Av."), ("two.txt:1", "Mal."), ("docs.jsonl:1", "Derî vebû."), ("docs.jsonl:2", "Sêv ket.")}
    assert [r["license"] for r in manifests.inventory_registry(made, known)] == ["CC-BY-4.0", "CC0-1.0"]
    with pytest.raises(ManifestError):
        manifests.inventory_registry(made, known[:1])
    assert manifests.import_one(spark, "beta", root / "corpora.toml", root, target)["document_count"] == 2
    with pytest.raises(ManifestError):
        manifests.import_one(spark, "gamma", root / "corpora.toml", root, target)


def test_import_fails_as_a_whole(spark, root):
    target = root / "imported"
    manifests.import_all(spark, root / "corpora.toml", root, target)
    before = sorted(p.name for p in target.iterdir())
    (root / "a/two.txt").write_text("Mal\u00ea.\n")
    with pytest.raises(ManifestError, match="checksum"):
        manifests.import_all(spark, root / "corpora.toml", root, target)
    assert sorted(p.name for p in target.iterdir()) == before and not list(root.glob(".imported*")) and not (root / "imported.lock").exists()
    with manifests.locked(root / "imported.lock"), pytest.raises(ManifestError, match="locked"):
        manifests.import_all(spark, root / "corpora.toml", root, target)


@pytest.mark.parametrize("harm", ["count", "registry", "extra", "document", "schema", "twice"])
def test_changed_imports_are_found(spark, root, harm):
    target = root / "imported"
    made = manifests.import_all(spark, root / "corpora.toml", root, target)
    if harm == "registry":
        (root / "corpora.toml").write_text((root / "corpora.toml").read_text() + "\n")
    elif harm == "extra":
        (target / "stray").mkdir()
    elif harm == "document":
        part = next(p for p in (target / "alpha").glob("part-*") if "Nan" in p.read_text())
        (target / "alpha" / f".{part.name}.crc").unlink()  # or the file system finds it first
        part.write_text(part.read_text().replace("Nan", "Nun"))
    else:
        made |= {"schema_version": "x"} if harm == "schema" else {}
        made["corpora"][0]["document_count"] += harm == "count"
        made["corpora"] += made["corpora"][:1] if harm == "twice" else []
        (target / "manifest.json").write_text(json.dumps(made))
    with pytest.raises(ManifestError):
        manifests.verify_import(spark, root / "corpora.toml", target)


POLICY = {"default_pack": "seed", "packs": {"seed": {"opt_in": False, "allow_as_default": True, "model_profile": "none"}, "reviewed": {"opt_in": False, "allow_as_default": True, "model_profile": "none"}, "experimental-full": {"opt_in": True, "allow_as_default": False, "model_profile": "none"}}}


def test_policy():
    assert manifests.check_policy(POLICY) is POLICY
    for path, value in ((("default_pack",), "experimental-full"), (("packs", "seed", "opt_in"), True), (("packs", "reviewed", "model_profile"), "bigram"), (("packs", "experimental-full", "allow_as_default"), True), (("packs", "more"), {})):
        bad = json.loads(json.dumps(POLICY))
        at = bad
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(ManifestError):
            manifests.check_policy(bad)


def entries(spark, name):
    from pyspark.sql import functions as F

    words = reviews.pack_lexicon(spark, name)
    none = F.array().cast("array<string>")
    return words.select("word", F.col("normalized").alias("lemma"), "normalized", F.lit("unknown").alias("part_of_speech"), F.lit(1).cast("long").alias("frequency"), F.lit("approved").alias("status"), none.alias("regions"), none.alias("sources"), "token_count", "document_count", "zipf_milli")


def test_packs(spark, root):
    known = manifests.corpora(root / "corpora.toml")
    same = {"review_decisions_sha256": "d" * 64, "review_queues_sha256": "e" * 64}
    for name in manifests.PACKS:
        m = manifests.write_pack(reviews.pack(spark, name), entries(spark, name), name, root / "packs" / name, POLICY, ["alpha"], known, same)
        assert m["entries"] == entries(spark, name).count() and m["data_licenses"] == [{"source_id": "alpha", "spdx": "CC-BY-4.0"}]
    assert set(manifests.validate_packs(root / "packs")) == set(manifests.PACKS)
    words, _, _ = pack.read(spark, str(root / "packs/seed/lexicon.bin"))
    assert {r.word for r in words.collect()} == {w for w, _ in inline.WORDS}
    with pytest.raises(ManifestError):
        manifests.write_pack(reviews.pack(spark, "seed"), entries(spark, "seed"), "seed", root / "packs/seed", POLICY, ["nowhere"], known, same)
    listing = root / "packs/seed/artifacts.sha256"
    good = listing.read_text()
    for bad in (good.replace("lexicon.bin", "../lexicon.bin"), good + good.splitlines()[0], good.replace("attribution", "/attribution"), "\n".join(good.splitlines()[1:]), good.replace(good[:8], "00000000")):
        listing.write_text(bad)
        with pytest.raises(ManifestError):
            manifests.validate_pack(root / "packs/seed", "seed")
    listing.write_text(good)
    (root / "packs/seed/stray").write_text("")
    with pytest.raises(ManifestError):
        manifests.validate_pack(root / "packs/seed", "seed")
    for one, other in (("a", "b"), ("", ""), (None, "a")):
        with pytest.raises(ManifestError):
            manifests.same_provenance("x", one, other)


def test_listings(tmp_path):
    (tmp_path / "b").write_text("1")
    (tmp_path / "a").write_text("2")
    manifests.write_listing(tmp_path, ["b", "a"], "data/", spaces=1)
    assert manifests.read_listing(tmp_path, {"a", "b"}, "data/") == {"a": digest("2"), "b": digest("1")}
    assert all(len(x.split(" ")) == 2 for x in (tmp_path / "artifacts.sha256").read_text().splitlines())


def test_replaced_directory_stays_if_the_block_fails(tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/old").write_text("")
    with pytest.raises(RuntimeError), manifests.replaced(tmp_path / "t") as stage:
        (stage / "new").write_text("")
        raise RuntimeError
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["old"]
    with manifests.replaced(tmp_path / "t") as stage:
        (stage / "new").write_text("")
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["new"] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_queues(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"target_type": "entry", "target_id": "x", "display": "1"}\n{"target_type": "entry", "target_id": "x", "display": "2"}\n\n')
    (tmp_path / "b.jsonl").write_text('{"target_type": "entry", "target_id": "x", "display": "3"}\n{"target_type": "conflict_group", "target_id": "x", "members": [{"entry_id": "x", "display": "d"}]}\n')
    got = {(r.target_type, r.target_id): r.display for r in manifests.read_queues(spark, str(tmp_path)).collect()}
    assert got == {("entry", "x"): "3", ("conflict_group", "x"): None}


def test_configurations(tmp_path):
    (tmp_path / "n.toml").write_text("[bigram]\nminimum_count = 3\nmaximum_predictions_per_context = 4\n[trigram]\nminimum_count = 2\nmaximum_predictions_per_context = 12\n")
    assert manifests.GramConfig.load(tmp_path / "n.toml") == manifests.GramConfig(3, 4)
    for bad in ((0, 4), (2, 17), (2, 16, 2, 13)):
        with pytest.raises(ManifestError):
            manifests.GramConfig(*bad)
    (tmp_path / "b.toml").write_text('[limits]\nmax_word_length = 32\n')
    assert manifests.BuildConfig.load(tmp_path / "b.toml").longest == 32 and manifests.BuildConfig().language == "ku-Latn"
