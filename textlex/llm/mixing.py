"""Operator 5: mixing sources to target weights by soft membership, in DataFrame functions only.

Classifier. A naive Bayes classifier over features (words in lower case, and runs of marks with an A for capitals) learns
the domains of a labelled table: only features that tell some domain from the others (a log-likelihood ratio
of TELLING) and that at most COMMON of all documents have count (the presence of common words tells the length), and the
frequencies of each domain are shrunk towards those of all by SHRINK documents. Its scores are too sure of themselves, so they
only put a document into a cell: the best domain and by how much it leads (MARGINS steps), or no known feature. A document's
posterior is the share of each domain among the labelled documents of its cell that were set aside (one in ASIDE), smoothed
towards those of the best domain.

Rates. Nonnegative rates r of the documents are fitted so that the expected tokens of each domain, the sum of p n r, match target
totals: projected gradient steps on the squared errors e = sum of p n r - t, r <- max(0, r - LENGTH p e), from r = 1. A step is
taken implicitly, e being that of the rates after it, so that it may be as long as it likes: explicit steps must be short, and
thousands of them would be needed. What e will be is as many numbers as there are domains; they are found by Newton's
iteration, each a distributed sum over the different posteriors with their tokens (equal posteriors have equal
rates). Steps end when each domain's error is less than CLOSE of all tokens, or no longer fall: then targets are out of
reach, as a domain that no document surely lacks can't be brought to 0. The error that is left is reported as `residual`. A
document's rate is an expression of its posteriors and the few steps.

The classifier is fitted on a bounded sample: about SAMPLE labelled documents, chosen by a hash of the id, which also
bounds what is broadcast. It keeps the most telling feature of each of BUCKETS buckets. Everything else covers all documents.

Defined cases: null counts as empty, with no tokens; a document without features has the cell of such documents. Targets
are shares of all tokens; domains without one have the target 0, and one that no document has can't be matched. A labelled
table without rows, or with more than MAX_DOMAINS domains (a small set of names, as it is in a plan's
literals), is an error; of an id with several labels the largest name counts. Where no labelled document is in the table, all
documents have the labels' shares. Rows that repeat are separate documents; an empty table gives an empty result; added columns
replace those of their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlex.llm.arrow import kept
from textlex.llm.tables import written

BUCKETS, SAMPLE, TELLING, COMMON, SHRINK, MAX_DOMAINS = 1 << 12, 20_000, 12.0, 0.1, 10.0, 256
MARGINS, ASIDE, SMOOTH = 7, 4, 2.0
#: Error of a domain as a part of all tokens; the least relative fall of the squared error that counts as one; length of a step.
CLOSE, FALL, LENGTH = 1e-4, 1e-2, 1e4
#: Iterations within a step; a few are enough, as what they solve is linear in pieces.
NEWTON = 60


def _features(text: Column) -> Column:
    """Hashes of a text's different words and marks."""
    text = F.coalesce(text, F.lit(""))
    marks = F.split(F.regexp_replace(text, r"\p{Lu}+", "A"), r"[\p{Ll}\p{N}\s]+")
    tokens = F.concat(F.split(F.lower(text), r"[^\p{L}]+"), marks)
    return F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w)))


def _bucket(feature: Column) -> Column:
    return F.pmod(feature, F.lit(BUCKETS)).cast("int")


def _literal(values: list, kind: str) -> Column:
    """An array as one literal."""
    return F.split(F.lit(",".join(f"{v:.10g}" if kind == "double" else str(v) for v in values)), ",").cast(f"array<{kind}>")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


class Classifier:
    """domains, their log priors, the feature (hash) of each bucket, for each domain its weights by bucket, and the posteriors of each cell."""

    def __init__(self, domains: list[str], priors: list[float], features: dict[int, int], weights: list[dict[int, float]]):
        self.domains, self.priors = domains, priors
        self._features = _literal([features.get(b, 0) for b in range(BUCKETS)], "long")
        self._weights = [_literal([w.get(b, 0.0) for b in range(BUCKETS)], "double") for w in weights]
        share = np.exp(priors) / np.exp(priors).sum()
        self.cells = np.tile(share, (1 + len(domains) * MARGINS, 1))

    def calibrate(self, counts: list[tuple[int, str, int]]) -> None:
        """counts: cell, domain and how many of the labelled documents that were set aside."""
        n = np.zeros(self.cells.shape)
        for cell, domain, k in counts:
            n[cell, self.domains.index(domain)] += k
        prior = self.cells[0].copy()
        smooth = lambda k, towards: (k + SMOOTH * towards) / (k.sum(axis=-1, keepdims=True) + SMOOTH)
        self.cells[0] = smooth(n[0], prior)
        for d in range(len(self.domains)):
            at = slice(1 + d * MARGINS, 1 + (d + 1) * MARGINS)
            self.cells[at] = smooth(n[at], smooth(n[at].sum(axis=0), prior))
        self.cells = np.round(self.cells, 4)

    def with_cell(self, df: DataFrame, found: Column) -> DataFrame:
        """df with the cell of each document's features."""
        buckets = F.transform(F.filter(found, lambda h: F.element_at(self._features, _bucket(h) + 1) == h), _bucket)
        score = lambda w: F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.element_at(w, b + 1))
        scores = F.array(*[F.lit(p) + score(w) for p, w in zip(self.priors, self._weights, strict=True)])
        order = F.sort_array("_s", asc=False)
        lead = F.least(F.lit(MARGINS - 1), F.floor(order[0] - F.coalesce(F.get(order, 1), F.lit(-1e9))).cast("int"))
        best = F.array_position("_s", order[0]).cast("int") - 1
        cell = F.when(F.size("_b") == 0, 0).otherwise(1 + best * MARGINS + lead)
        return df.withColumn("_b", buckets).withColumn("_s", scores).withColumn("_cell", cell).drop("_b", "_s")

    def posteriors(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with a column p_<domain> for each domain."""
        df = self.with_cell(df, _features(F.col(text)))
        table = _literal(self.cells.ravel().tolist(), "double")
        found = F.struct(*[F.element_at(table, F.col("_cell") * len(self.domains) + k + 1).alias(f"p_{d}") for k, d in enumerate(self.domains)])
        # a generator of one row: filters on what follows aren't pushed below it, where they would evaluate all this again for each use
        df = df.withColumn("_p", F.explode(F.array(found)))
        return df.select("*", *[F.col("_p").getField(f"p_{d}").alias(f"p_{d}") for d in self.domains]).drop("_cell", "_p")


def train(df: DataFrame, labelled: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """labelled: doc_id, domain."""
    labelled = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    labelled = written(labelled, "labelled")
    sizes = {r.domain: r["count"] for r in labelled.groupBy("domain").count().orderBy("domain").limit(MAX_DOMAINS + 1).collect()}
    if not 0 < len(sizes) <= MAX_DOMAINS:
        raise ValueError(f"{'no labelled documents' if not sizes else f'more than {MAX_DOMAINS} domains'}")
    domains, total = sorted(sizes), sum(sizes.values())
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, sample / total) * 1_000_000))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # copies say nothing new, but would make all words of their text telling
    docs = docs.select("domain", F.array_sort(_features(F.col("text"))).alias("found"))
    docs = docs.groupBy("domain", F.xxhash64("found").alias("h")).agg(F.first("found").alias("found"))
    docs = written(docs.withColumn("aside", F.pmod("h", F.lit(ASIDE)) == 0), "labelled-features")
    fitted = docs.filter("not aside")
    of = {r.domain: r["count"] for r in fitted.groupBy("domain").count().collect()}
    n_docs = sum(of.values())
    if not n_docs:
        return Classifier(domains, [math.log(sizes[d] / total) for d in domains], {}, [{} for _ in domains])
    counts = fitted.select("domain", F.explode("found").alias("feature")).groupBy("domain", "feature").agg(F.count(F.lit(1)).alias("n"))
    table = counts.groupBy("feature").pivot("domain", domains).agg(F.sum("n"))
    c = {d: F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in domains}
    every = sum(c.values(), F.lit(0))
    whole = every / n_docs
    columns, score = [], F.lit(0.0)
    for k, d in enumerate(domains):
        share = of.get(d, 0) / n_docs
        part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
        if share > 0:
            score = F.greatest(score, 2 * (part(c[d], every * share) + part(every - c[d], every * max(1 - share, 1e-9))))
        columns.append(F.log((c[d] + SHRINK * whole) / (of.get(d, 0) + SHRINK) / whole).alias(f"w_{k}"))
    table = table.withColumn("score", score).filter((F.col("score") >= TELLING) & (whole <= COMMON))
    best = table.select(_bucket(F.col("feature")).alias("bucket"), F.struct("score", "feature", *columns).alias("f"))
    found = best.groupBy("bucket").agg(F.max("f").alias("f")).collect()  # BUCKETS rows at most
    weights = [{r.bucket: r.f[f"w_{k}"] for r in found} for k in range(len(domains))]
    priors = [math.log((of.get(d, 0) + 0.5) / (n_docs + 0.5 * len(domains))) for d in domains]
    out = Classifier(domains, priors, {r.bucket: r.f.feature for r in found}, weights)
    cells = out.with_cell(docs.filter("aside"), F.col("found")).groupBy("_cell", "domain").count().collect()  # cells times domains at most
    out.calibrate([(r["_cell"], r["domain"], r["count"]) for r in cells])
    return out


def rate(domains: list[str], steps: list[list[float]]) -> Column:
    """A document's rate from its posteriors after the steps taken.

    The steps are one array literal, so that the code Spark generates is the same whatever their values.
    """
    p = F.array(*[F.col(f"`p_{d}`") for d in domains])
    moved = lambda e: F.aggregate(F.zip_with(p, e, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    taken = F.split(F.lit(";".join(",".join(map(repr, step)) for step in steps)), ";") if steps else F.array().cast("array<string>")
    history = F.transform(taken, lambda t: F.split(t, ",").cast("array<double>"))
    return F.aggregate(history, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - moved(e)))


def totals(features: DataFrame, domains: list[str], r: Column) -> np.ndarray:
    """The expected tokens of each domain at these rates."""
    return np.array(list(features.agg(*[F.coalesce(F.sum(F.col(f"`p_{d}`") * F.col("n_tokens") * r), F.lit(0.0)) for d in domains]).first()), float)


def grouped(features: DataFrame, domains: list[str]) -> DataFrame:
    """The different posteriors with their tokens."""
    return written(features.groupBy(*[f"`p_{d}`" for d in domains]).agg(F.sum("n_tokens").alias("n_tokens")), "mixture")


def fit(features: DataFrame, domains: list[str], want: np.ndarray, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """The steps of the projected gradient for grouped posteriors and target totals, and the largest error left as a part of the targets' tokens."""
    p = [F.col(f"`p_{d}`") for d in domains]
    d, pairs = len(p), [(i, j) for i in range(len(p)) for j in range(i + 1)]
    scale = max(float(np.abs(want).sum()), 1.0)
    share = F.col("n_tokens") / scale

    def state(steps):
        """Errors, their derivatives by a step, and half the sum of the squared rates."""
        sums = [*[x * share * F.col("_r") for x in p], *[F.when(F.col("_r") > 0, p[i] * p[j] * share) for i, j in pairs], share * F.col("_r") * F.col("_r") / 2]
        found = np.array(list(features.withColumn("_r", rate(domains, steps)).agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums]).first()), float)
        slope = np.zeros((d, d))
        for (i, j), v in zip(pairs, found[d:-1], strict=True):
            slope[i, j] = slope[j, i] = v
        return found[:d] - want / scale, slope, found[-1]

    steps: list[list[float]] = []
    now = state(steps)
    while d and np.abs(now[0]).max() > close:
        move, at = np.zeros(d), now
        # the new rates are those of the move that is LENGTH times the error after it: the least of a convex function
        value = lambda move, at: at[2] + move @ want / scale + move @ move / (2 * LENGTH)
        for _ in range(NEWTON):
            slope = at[0] - move / LENGTH
            if np.abs(slope).max() < close / 100:
                break
            way, part = np.linalg.solve(at[1] + np.eye(d) / LENGTH, slope), 1.0
            while True:
                new = move + part * way
                there = state([*steps, new.tolist()])
                if value(new, there) <= value(move, at) - 1e-4 * part * (way @ slope) or part < 1e-3:
                    break
                part /= 2
            if value(new, there) >= value(move, at):
                break
            move, at = new, there
        before, after = float(now[0] @ now[0]), float(at[0] @ at[0])
        if after >= before:
            break
        steps.append(move.tolist())
        now = at
        if before - after < FALL * before:
            break
    return steps, float(np.abs(now[0]).max()) if d else 0.0


def _rated(features: DataFrame, model: Classifier, want) -> tuple[Column, float]:
    """The rate of documents with posteriors, for target totals that `want` gives from the grouped posteriors."""
    mixture = grouped(features, model.domains)
    steps, residual = fit(mixture, model.domains, want(mixture))
    return rate(model.domains, steps), residual


def shares(model: Classifier, targets: dict[str, float]):
    """Targets as shares of all tokens."""
    return lambda mixture: np.array([targets.get(d, 0.0) for d in model.domains]) * totals(mixture, model.domains, F.lit(1.0)).sum()


def without(model: Classifier, drop: str, room: float = 0.05):
    """Targets that the documents have which are less likely of the domain `drop` than not; the other domains get `room` more, so that their documents aren't thinned."""

    def want(mixture):
        clean = totals(mixture, model.domains, F.when(F.col(f"`p_{drop}`") < 0.5, 1.0).otherwise(0.0))
        return clean * np.array([1.0 if d == drop else 1 + room for d in model.domains])

    return want


def mix(df: DataFrame, model: Classifier, want, text: str = "text") -> DataFrame:
    """df with n_tokens, p_<domain>, rate (how many times each document is to be taken, on average) and residual."""
    added = ["n_tokens", *(f"p_{d}" for d in model.domains), "rate", "residual", "_b", "_s", "_cell", "_p"]
    df = df.select(*kept(df, added))
    features = model.posteriors(df.select(F.col(text)).withColumn("n_tokens", n_words(F.col(text))), text).drop(text)
    rated, residual = _rated(features, model, want)
    return model.posteriors(df.withColumn("n_tokens", n_words(F.col(text))), text).withColumns({"rate": rated, "residual": F.lit(residual)})


def rated_rows(df: DataFrame, model: Classifier, want, text: str = "text", rate_name: str = "rate") -> DataFrame:
    """df with its rate as the last column; its own columns stay, whatever their names."""
    own = [c for c in df.columns if c != rate_name]
    body = df.select(F.col(text).alias("text"), n_words(F.col(text)).alias("n_tokens"))
    rated, _ = _rated(model.posteriors(body).drop("text"), model, want)
    held = df.select(F.struct(*own).alias("row"), F.col(text).alias("text"))
    held = model.posteriors(held).select("row", rated.alias("rate"))
    return held.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("rate").alias(rate_name))


def rates(df: DataFrame, model: Classifier, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, residual; as `mix`, but the texts are read once."""
    docs = df.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n_tokens"), F.col(text).alias("text"))
    features = written(model.posteriors(docs).drop("text"), "posteriors")
    rated, residual = _rated(features, model, shares(model, targets))
    return features.withColumns({"rate": rated, "residual": F.lit(residual)})


def by_quality(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, high and low (quality)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))
