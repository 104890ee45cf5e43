"""Similarity of short texts: the mean of seven measures, each between 0 and 1."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hamming(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return 1.0 if n == 0 else sum(x == y for x, y in zip(a, b, strict=False)) / n


def damerau(a: str, b: str) -> float:
    """One minus edits (with swaps of neighbours) by the longer length."""
    n = max(len(a), len(b))
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return 1.0 if n == 0 else 1 - one[-1] / n


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def smith_waterman(a: str, b: str) -> float:
    """Best local alignment (match 1, mismatch and gap -1) by the shorter length."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (1 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    n = min(len(a), len(b))
    return best / n if n else float(a == b)


def jaccard(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def bag(a: str, b: str) -> float:
    x, y = Counter(a), Counter(b)
    n = max(len(a), len(b))
    return 1 - max((x - y).total(), (y - x).total()) / n if n else 1.0


def common_substring(a: str, b: str) -> float:
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else 0)
        best, above = max(best, *row), row
    n = max(len(a), len(b))
    return best / n if n else 1.0


MEASURES = (hamming, damerau, jaro, smith_waterman, jaccard, bag, common_substring)


def snippet_similarity(a: str, b: str) -> float:
    return sum(f(a, b) for f in MEASURES) / len(MEASURES)


@F.pandas_udf(T.DoubleType())
def snippet_similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null on either side is null."""
    return pd.Series([None if x is None or y is None else snippet_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
