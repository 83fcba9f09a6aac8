"""Weighted edit distance with transpositions, in quarters, as one expression and as a Pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Letters whose substitution costs a quarter, and neighbouring keys, three quarters; both directions.
DIACRITIC_PAIRS = ["iî", "uû", "sş", "cç", "eê"]
NEIGHBOUR_KEYS = ["rt", "re", "as", "aq", "az", "zx", "xc", "cv", "vb", "bn", "nm"]
QUARTER = {p for a, b in DIACRITIC_PAIRS for p in (a + b, b + a)}
NEAR = {p for a, b in NEIGHBOUR_KEYS for p in (a + b, b + a)}
GAP, SWAP, FAR = 4, 3, 4


def quarters(a: str, b: str) -> int:
    """Optimal string alignment of two strings, four times the distance."""
    before: list[int] = []
    row = [GAP * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [GAP * i]
        for j, y in enumerate(b, 1):
            change = 0 if x == y else 1 if x + y in QUARTER else 3 if x + y in NEAR else FAR
            cost = min(row[-1] + GAP, before[j] + GAP, before[j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + SWAP)
            row.append(cost)
    return row[-1]


#: The letters of the pairs, and the cost of changing one into another, in a table; 0 stands for all other letters.
_LETTERS = sorted(set("".join(DIACRITIC_PAIRS + NEIGHBOUR_KEYS)))
_CHANGE = np.full((len(_LETTERS) + 1,) * 2, FAR, np.int32)
for _pairs, _cost in ((NEAR, 3), (QUARTER, 1)):
    for _x, _y in _pairs:
        _CHANGE[_LETTERS.index(_x) + 1, _LETTERS.index(_y) + 1] = _cost
#: Pairs and letters of a table that is worked on at once.
ROWS, LETTERS = 4096, 64


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _kinds(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(codes.shape, np.int32)
    for k, letter in enumerate(_LETTERS, 1):
        out[codes == ord(letter)] = k
    return out


def quarters_of(a: list[str], b: list[str]) -> np.ndarray:
    """`quarters` of many pairs of short words at once: the same table, a cell of all pairs at a time."""
    la, lb = (np.array([len(w) for w in x]) for x in (a, b))
    n, m = int(la.max(initial=0)), int(lb.max(initial=0))
    x, y = _codes(a, n), _codes(b, m)
    kx, ky = _kinds(x), _kinds(y)
    out = np.where(la == 0, GAP * lb, 0).astype(np.int32)
    last, row = None, np.repeat(GAP * np.arange(m + 1, dtype=np.int32)[:, None], len(a), 1)
    for i in range(1, n + 1):
        before, row = row, np.empty_like(row)
        row[0] = GAP * i
        for j in range(1, m + 1):
            change = np.where(x[:, i - 1] == y[:, j - 1], 0, _CHANGE[kx[:, i - 1], ky[:, j - 1]])
            cost = np.minimum(np.minimum(row[j - 1], before[j]) + GAP, before[j - 1] + change)
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                cost = np.where(swap, np.minimum(cost, last[j - 2] + SWAP), cost)
            row[j] = cost
        last = before
        here = la == i
        out[here] = row[lb[here], here.nonzero()[0]]
    return out


@F.pandas_udf(IntegerType())
def distance_quarters(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int32)
    size = np.maximum(a.str.len(), b.str.len()).to_numpy()
    order = np.argsort(size, kind="stable")
    short = order[size[order] <= LETTERS]
    for k in range(0, len(short), ROWS):
        part = short[k : k + ROWS]
        out[part] = quarters_of(a.iloc[part].tolist(), b.iloc[part].tolist())
    for k in order[size[order] > LETTERS]:
        out[k] = quarters(a.iloc[k], b.iloc[k])
    return pd.Series(out)


def edit_cost(quarter_units: Column) -> Column:
    """Ten times the distance, rounded half up."""
    return F.floor((quarter_units * 5 + 1) / 2).cast("long")
