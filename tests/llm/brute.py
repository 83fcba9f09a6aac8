"""Plain versions of operators for small tables."""

import hashlib
import math
import re
from collections import Counter


def substring(docs, window):
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in docs}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        stay = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(stay.encode()).hexdigest())
    return out


def near(docs, threshold=0.8, rare=1e-4):
    """doc_id -> least doc_id of its class, and the links of different word sequences, by weighted Jaccard of all pairs of texts."""
    words = {i: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower()) for i, t in docs}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in words.items()}
    n, df = len(docs), Counter(g for b in bags.values() for g in b)
    weight = {g: 1 + math.log(n / max(d, rare * n)) / math.log(1 / rare) for g, d in df.items()}
    by_name = {}
    for i, t in docs:
        by_name.setdefault(tuple(words[i]) or (None, t or ""), []).append(i)
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(i, j):
        i, j = sorted((root(i), root(j)))
        parent[j] = i

    for group in by_name.values():
        for j in group[1:]:
            join(group[0], j)
    leads = [g[0] for g in by_name.values() if bags[g[0]]]
    size = {i: sum(weight[g] * k for g, k in bags[i].items()) for i in leads}
    holders = {}
    for i in leads:
        for g in bags[i]:
            holders.setdefault(g, []).append(i)
    links = set()
    for i in leads:
        low = Counter()
        for g, k in bags[i].items():
            for j in holders[g]:
                if j < i:
                    low[j] += weight[g] * min(k, bags[j][g])
        for j, x in low.items():
            if x / (size[i] + size[j] - x) >= threshold:
                links.add((j, i))
                join(i, j)
    return {i: root(i) for i, _ in docs}, links


def imatch(order, low, high):
    """order: (id, text) in their order. For each: id, length, digest of the edited text, likeness to it and to the next, and the terms of each subset."""
    from textlex.llm.imatch import LEAST, Fingerprints
    from textlex.llm.words import U64, Hasher, mix

    hasher, seeds = Hasher(), Fingerprints(None).seeds
    terms = lambda t: set(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t.lower()))
    df = Counter(w for _, t in order for w in terms(t))
    least = max(2, low * len(order))
    band = {w for w, n in df.items() if least <= n <= max(least, high * len(order))}
    stays = {}

    def subsets(text):
        found = terms(text)
        inside = found & band
        chosen = inside if len(inside) >= LEAST else found
        for w in chosen - stays.keys():  # chance: whether a subset has a term is taken from the same hash
            h = hasher.words([w])[0][0]
            stays[w] = [int(mix(h ^ s) % U64(10)) >= 3 for s in seeds]
        return [frozenset(w for w in chosen if stays[w][k]) for k in range(len(seeds))]

    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        own = subsets(text)
        near = [sum(a == b for a, b in zip(own, subsets(t))) / len(own) for t in (edited, after)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near[0], 9), round(near[1], 9), tuple(own)))
    return out
