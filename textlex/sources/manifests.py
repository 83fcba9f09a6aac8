"""Imports of whole corpora, manifests of files, packs as directories, and their checks.

What is checked here is described by small registries and manifests, which the driver reads; the files themselves are hashed,
counted and written by Spark. Paths are those of a file system that the driver and all executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tomllib
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlex.functions import ids
from textlex.functions import text as T
from textlex.operators import review
from textlex.sources import files, pack

SCHEMA_VERSION = "textlex-canonical-1"
ARTIFACTS = ["attribution.txt", "collision-report.jsonl", "lexicon.bin", "manifest.json"]
LISTING = "artifacts.sha256"
#: Each pack, whether it is the default, and whether it is experimental.
PACKS = {"seed": (True, False), "reviewed": (False, False), "experimental-full": (False, True)}


class ManifestError(ValueError):
    pass


def _need(test: bool, message: str) -> None:
    if not test:
        raise ManifestError(message)


def sha256(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


# configurations


@dataclass(frozen=True)
class GramConfig:
    """Bounds of the n-gram models."""

    bigram_least: int = 2
    bigram_most: int = 16
    trigram_least: int = 2
    trigram_most: int = 12

    def __post_init__(self):
        _need(min(self.bigram_least, self.trigram_least) >= 1, "a least count is at least 1")
        _need(1 <= self.bigram_most <= 16 and 1 <= self.trigram_most <= 12, "predictions of a context are 1 to 16 for bigrams and 1 to 12 for trigrams")

    @classmethod
    def load(cls, path: str) -> GramConfig:
        given = tomllib.loads(Path(path).read_text("utf-8"))
        of = lambda n: (given[n]["minimum_count"], given[n]["maximum_predictions_per_context"])
        return cls(*of("bigram"), *of("trigram"))


@dataclass(frozen=True)
class BuildConfig:
    """Defaults of a lexicon's build."""

    language: str = "ku-Latn"
    strict: bool = True
    form: str = "NFC"
    script: str = "Latin"
    shortest: int = 1
    longest: int = 64

    @classmethod
    def load(cls, path: str) -> BuildConfig:
        given = tomllib.loads(Path(path).read_text("utf-8"))
        build, normal, limits = (given.get(k, {}) for k in ("build", "normalization", "limits"))
        return cls(build.get("language_tag", cls.language), build.get("strict_mode", cls.strict), normal.get("form", cls.form), normal.get("accepted_script", cls.script), limits.get("min_word_length", cls.shortest), limits.get("max_word_length", cls.longest))


# directories


@contextmanager
def locked(path: str | os.PathLike):
    """A lock file that only one holds at a time; it goes with the block."""
    try:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError as e:
        raise ManifestError(f"locked: {path}") from e
    try:
        yield
    finally:
        os.unlink(path)


@contextmanager
def replaced(target: str | os.PathLike):
    """A new directory that takes the target's place when the block ends well; else the target stays as it was."""
    target = Path(target)
    stage, backup = (target.with_name(f".{target.name}.{kind}-{uuid.uuid4().hex}") for kind in ("stage", "backup"))
    stage.mkdir(parents=True)
    try:
        yield stage
        if target.exists():
            target.rename(backup)
        try:
            stage.rename(target)
        except OSError:
            if backup.exists():
                backup.rename(target)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        shutil.rmtree(backup, ignore_errors=True)


def write_listing(folder: Path, names: list[str], prefix: str = "", spaces: int = 2) -> None:
    """The hashes of files: two spaces between hash and path, or one; sorted by path, or with one space by line."""
    rows = [(sha256(folder / n), f"{prefix}{n}") for n in names]
    lines = [f"{h}{' ' * spaces}{p}" for h, p in sorted(rows, key=lambda r: r[::-1] if spaces == 2 else r)]
    (folder / LISTING).write_text("\n".join(lines) + "\n", "utf-8")


def read_listing(folder: Path, allowed: set[str], prefix: str = "") -> dict[str, str]:
    """Paths with their hashes; paths that repeat, climb, are absolute or aren't allowed are errors, as are wrong hashes."""
    out: dict[str, str] = {}
    for line in (folder / LISTING).read_text("utf-8").splitlines():
        if not line.strip():
            continue
        parts = line.split()
        _need(len(parts) == 2, f"malformed line: {line}")
        digest, path = parts
        name = path.removeprefix(prefix)
        _need(not path.startswith("/") and ".." not in path.split("/") and path.startswith(prefix) and name in allowed, f"unexpected path: {path}")
        _need(name not in out, f"path occurs twice: {path}")
        _need(sha256(folder / name) == digest, f"wrong hash: {path}")
        out[name] = digest
    _need(set(out) == allowed, f"paths differ: {sorted(set(out) ^ allowed)}")
    return out


# corpora


@dataclass(frozen=True)
class Corpus:
    corpus_id: str
    files: tuple[tuple[str, str], ...]  # path and SHA-256
    document_format: str = "one-document-per-line"
    id_field: str = "id"
    text_field: str = "text"
    license: str = ""
    corpus_name: str = ""
    notes: str = ""
    url: str = ""
    version: str = ""
    author: str = ""
    extra: dict = field(default_factory=dict, compare=False)


def corpora(registry: str | os.PathLike, table: str = "corpus") -> list[Corpus]:
    """The corpora of a TOML registry, by id; ids that repeat and unsafe paths are errors."""
    out = []
    for e in tomllib.loads(Path(registry).read_text("utf-8")).get(table, []):
        known = {k: e[k] for k in ("document_format", "license", "corpus_name", "notes", "url", "version", "author") if k in e}
        known |= {new: e[old] for old, new in (("document_id_field", "id_field"), ("text_field", "text_field")) if old in e}
        out.append(Corpus(e["corpus_id"], tuple((f["path"], f["sha256"]) for f in e.get("files", [])), **known))
    names = [c.corpus_id for c in out]
    _need(len(set(names)) == len(names), "corpus ids repeat")
    for c in out:
        _need(bool(c.files), f"no files: {c.corpus_id}")
        _need(all(p and not p.startswith("/") and "\\" not in p and not {"", ".", ".."} & set(p.split("/")) for p, _ in c.files), f"unsafe path: {c.corpus_id}")
    return sorted(out, key=lambda c: c.corpus_id)


def pinned(corpus: Corpus) -> bool:
    """Whether the version is a whole commit hash that the URL holds."""
    return len(corpus.version) == 40 and all(c in "0123456789abcdefABCDEF" for c in corpus.version) and corpus.version in corpus.url


def verified(spark: SparkSession, corpus: Corpus, root: str | os.PathLike) -> list[str]:
    """The paths of a corpus' files, after their hashes were compared; no other file is read."""
    paths = [str(Path(root) / p) for p, _ in corpus.files]
    for p in paths:
        _need(os.path.exists(p), f"missing file: {p}")
    found = {r.path.removeprefix("file:").replace("///", "/"): r.sha256 for r in spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256")).collect()}
    for p, (_, digest) in zip(paths, corpus.files, strict=True):
        _need(found.get(p) == digest, f"wrong checksum: {p}")
    return paths


def scan(spark: SparkSession, corpus: Corpus, root: str | os.PathLike) -> DataFrame:
    """The canonical documents of a corpus from its registered files, hashed before they are read."""
    paths = verified(spark, corpus, root)
    out = None
    for p in paths:
        one = files.import_corpus(spark, p, corpus.corpus_id, corpus.document_format, corpus.id_field, corpus.text_field)
        out = one if out is None else out.unionByName(one)
    return out


def _digest(spark: SparkSession, folder: Path) -> str:
    """A hash of the hashes of a table's files, by name."""
    rows = files.checksums(spark, str(folder)).filter("file like 'part-%'").orderBy("file").collect()
    return hashlib.sha256("".join(f"{r.sha256}\n" for r in rows).encode()).hexdigest()


def import_all(spark: SparkSession, registry: str | os.PathLike, root: str | os.PathLike, target: str | os.PathLike) -> dict:
    """Imports all registered corpora into a directory with a folder of JSON lines for each and a manifest, or nothing at all.

    All files are hashed before any is read; ids that repeat in a corpus are an error.
    """
    known = corpora(registry)
    _need(bool(known), "no registered corpora")
    with locked(f"{target}.lock"):
        for c in known:
            verified(spark, c, root)
        entries = []
        with replaced(target) as stage:
            for c in known:
                docs = scan(spark, c, root)
                _need(not files.repeated_ids(docs).limit(1).count(), f"document ids repeat: {c.corpus_id}")
                docs.write.json(str(stage / c.corpus_id))
                n = spark.read.text(str(stage / c.corpus_id)).count()
                entries.append({"corpus_id": c.corpus_id, "documents": c.corpus_id, "documents_sha256": _digest(spark, stage / c.corpus_id), "document_count": n, "source_files": [{"path": p, "sha256": h} for p, h in c.files]})
            manifest = {"schema_version": SCHEMA_VERSION, "registry_sha256": sha256(registry), "corpora": entries}
            (stage / "manifest.json").write_text(json.dumps(manifest, indent=1, ensure_ascii=False), "utf-8")
    return manifest


def import_one(spark: SparkSession, corpus_id: str, registry: str | os.PathLike, root: str | os.PathLike, target: str | os.PathLike) -> dict:
    """As `import_all`, which keeps the directory whole; an unknown id is an error."""
    _need(corpus_id in {c.corpus_id for c in corpora(registry)}, f"unknown corpus: {corpus_id}")
    manifest = import_all(spark, registry, root, target)
    return next(e for e in manifest["corpora"] if e["corpus_id"] == corpus_id)


def verify_import(spark: SparkSession, registry: str | os.PathLike, target: str | os.PathLike) -> dict:
    """The manifest of an import, after schema, registry, corpora, hashes, document counts and the directory's contents were compared."""
    target = Path(target)
    _need((target / "manifest.json").exists(), "no manifest")
    manifest = json.loads((target / "manifest.json").read_text("utf-8"))
    _need(manifest["schema_version"] == SCHEMA_VERSION, "wrong schema version")
    _need(manifest["registry_sha256"] == sha256(registry), "the registry has changed")
    names = [e["corpus_id"] for e in manifest["corpora"]]
    _need(len(set(names)) == len(names), "corpus ids repeat in the manifest")
    _need(set(names) == {c.corpus_id for c in corpora(registry)}, "corpora of manifest and registry differ")
    _need(len({e["documents"] for e in manifest["corpora"]}) == len(names), "documents are named twice")
    _need({p.name for p in target.iterdir()} == {"manifest.json", *names}, "unexpected contents")
    for e in manifest["corpora"]:
        folder = target / e["documents"]
        _need(_digest(spark, folder) == e["documents_sha256"], f"wrong hash: {e['corpus_id']}")
        _need(spark.read.text(str(folder)).filter(F.trim("value") != "").count() == e["document_count"], f"wrong number of documents: {e['corpus_id']}")
    return manifest


def documents(spark: SparkSession, target: str | os.PathLike, corpora: list[str]) -> DataFrame:
    schema = "corpus_id string, document_id string, source_file string, source_record bigint, source_sha256 string, text string"
    return spark.read.schema(schema).json([str(Path(target) / c) for c in corpora])


def inventory_registry(manifest: dict, known: list[Corpus]) -> list[dict]:
    """Each corpus of a manifest with its registry entry; one that isn't registered is an error."""
    by = {c.corpus_id: c for c in known}
    for e in manifest["corpora"]:
        _need(e["corpus_id"] in by, f"not registered: {e['corpus_id']}")
    return [{"corpus_id": e["corpus_id"], "corpus_name": by[e["corpus_id"]].corpus_name, "license": by[e["corpus_id"]].license, "notes": by[e["corpus_id"]].notes, "files": len(e["source_files"]), "documents": e["document_count"]} for e in manifest["corpora"]]


# review queues and cases


def read_queues(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON lines of a directory of queues: target_type, target_id, normalized, display, members; of several rows of a target the last by file and line."""
    schema = "target_type string, target_id string, normalized string, display string, source_id string, source_revision string, members array<struct<entry_id string, display string>>"
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/*.jsonl")
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return review.latest_targets(lines.filter("target_id is not null").select("*", place.alias("position")))


# packs


def check_policy(policy: dict) -> dict:
    """A policy of packs: default_pack, packs (opt_in, allow_as_default, model_profile by name)."""
    packs = policy.get("packs", {})
    _need(set(packs) == set(PACKS), f"the packs are {sorted(PACKS)}")
    default = packs.get(policy.get("default_pack"))
    _need(default is not None, "the default pack isn't there")
    _need(not default["opt_in"] and default["allow_as_default"], "the default pack must be allowed and not opt-in")
    experimental = packs["experimental-full"]
    _need(experimental["opt_in"] and not experimental["allow_as_default"], "the experimental pack must be opt-in and no default")
    _need(all(p["model_profile"] == "none" for p in packs.values()), "packs have no models")
    return policy


def licenses(sources: list[str], registry: list[Corpus]) -> tuple[list[dict], str]:
    """The license of each source, and an attribution text; a source that isn't registered is an error."""
    by = {c.corpus_id: c for c in registry}
    for s in sources:
        _need(s in by, f"not registered: {s}")
    text = "\n".join(f"=== Source: {s} ===\nLicense: {by[s].license}\nProject: {by[s].corpus_name}\nAuthor: {by[s].author}\nRevision: {by[s].version}\n" for s in sources)
    return [{"source_id": s, "spdx": by[s].license} for s in sources], text


def write_pack(candidates: DataFrame, lexicon: DataFrame, pack_id: str, target: str | os.PathLike, policy: dict, sources: list[str], registry: list[Corpus], provenance: dict[str, str]) -> dict:
    """A pack as a directory of five files, or nothing at all. lexicon: the resolved entries; candidates: all of them, for the report on collisions."""
    definition = check_policy(policy)["packs"][pack_id]
    spdx, text = licenses(sources, registry)
    with replaced(target) as stage:
        empty = lambda columns: lexicon.sparkSession.createDataFrame([], columns)
        grams = "next string, count bigint, probability_millionths bigint"
        pack.write(lexicon, empty("previous string, " + grams), empty("previous_2 string, previous_1 string, " + grams), str(stage / "lexicon.bin"))
        lost = review.resolve_collisions(candidates).filter("competing > 0").orderBy("normalized")
        with open(stage / "collision-report.jsonl", "w", encoding="utf-8") as f:  # one row at a time
            for row in lost.select(F.to_json(F.struct("*"))).toLocalIterator():
                f.write(row[0] + "\n")
        (stage / "attribution.txt").write_text(text, "utf-8")
        data = (stage / "lexicon.bin").read_bytes()
        counts = {r.population: r["count"] for r in candidates.groupBy("population").count().collect()}
        manifest = {
            "pack_id": pack_id, "format_version": pack.VERSION, "is_default": policy["default_pack"] == pack_id, "is_experimental": definition["opt_in"], "model_profile": definition["model_profile"],
            "frequency_entry_count": 0, "bigram_count": 0, "trigram_count": 0, "selected": {p: counts.get(p, 0) for p in review.POPULATIONS}, "entries": pack.header(data)["entries"],
            "binary_sha256": hashlib.sha256(data).hexdigest(), "binary_size": len(data), "data_licenses": spdx, **provenance,
        }
        (stage / "manifest.json").write_text(json.dumps(manifest, indent=1, ensure_ascii=False), "utf-8")
        write_listing(stage, ARTIFACTS)
    return manifest


def validate_pack(folder: str | os.PathLike, pack_id: str) -> dict:
    """The manifest of a pack's directory, after all its rules were checked."""
    folder = Path(folder)
    _need(folder.exists(), f"missing pack: {pack_id}")
    _need({p.name for p in folder.iterdir()} == {*ARTIFACTS, LISTING}, f"files differ: {pack_id}")
    m = json.loads((folder / "manifest.json").read_text("utf-8"))
    default, experimental = PACKS[pack_id]
    _need(m["pack_id"] == pack_id and m["is_default"] == default and m["is_experimental"] == experimental, f"wrong identity: {pack_id}")
    _need(m["model_profile"] == "none" and not (m["frequency_entry_count"] or m["bigram_count"] or m["trigram_count"]), f"a pack without models holds some: {pack_id}")
    data = (folder / "lexicon.bin").read_bytes()
    _need(m["binary_sha256"] == hashlib.sha256(data).hexdigest() and m["binary_size"] == len(data), f"wrong binary: {pack_id}")
    read_listing(folder, set(ARTIFACTS))
    _need(len(pack.decode(data)[0]) == m["entries"], f"wrong number of entries: {pack_id}")
    text = (folder / "attribution.txt").read_text("utf-8")
    for x in m["data_licenses"]:
        _need(f"=== Source: {x['source_id']} ===" in text, f"no attribution: {x['source_id']}")
    return m


def validate_packs(folder: str | os.PathLike) -> dict[str, dict]:
    """The manifests of all packs; the reviewed and the experimental one come from the same inputs."""
    found = {name: validate_pack(Path(folder) / name, name) for name in PACKS}
    for key in ("review_decisions_sha256", "review_queues_sha256"):
        same_provenance(key, found["reviewed"].get(key), found["experimental-full"].get(key))
    return found


def same_provenance(name: str, one: str | None, other: str | None) -> str:
    """A value that two packs have alike; a missing or empty one is an error."""
    _need(bool((one or "").strip()) and bool((other or "").strip()), f"missing provenance: {name}")
    _need(one == other, f"provenance differs: {name}")
    return one


def unsafe_files(registry: DataFrame) -> DataFrame:
    """Rows of `files.read_registry` whose path leaves its folder or whose hash is none."""
    return registry.filter(~ids.safe_path(F.col("path")) | ~T.trim_space(F.col("sha256")).rlike("^[0-9a-f]{64}$"))
