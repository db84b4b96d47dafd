"""Fuzzy string ratios (survey X31): 0 to 100, rounded, from the longest common subsequence of characters.

ratio = 200 * lcs / (len a + len b). partial_ratio is the best ratio of the shorter string with a window of the longer.
token_sort_ratio compares sorted words, token_set_ratio the shared and the remaining words. They are meant for the rows
earlier rules left undecided, so they come as vectorised functions of two columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_WORD = re.compile(r"\W")


def lcs(a: str, b: str) -> int:
    """Bit-parallel length of the longest common subsequence."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        if u := v & where.get(c, 0):
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _raw(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / n if n else 0.0


def ratio(a: str, b: str) -> int:
    """0 if either side is empty."""
    return round(_raw(a, b)) if a and b else 0


def partial_ratio(a: str, b: str) -> int:
    """Windows have the shorter string's length and may stick out at either end of the longer one."""
    if not a or not b:
        return 0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if s in t:
        return 100
    chars, best, n = set(s), 0.0, len(s)
    windows = [(0, i) for i in range(1, n)] + [(i, i + n) for i in range(len(t) - n + 1)] + [(i, len(t)) for i in range(len(t) - n + 1, len(t))]
    for i, j in windows:
        edge = t[i] if j == len(t) and j - i < n else t[j - 1]
        if edge in chars:
            best = max(best, _raw(s, t[i:j]))
    return round(best)


def _words(s: str) -> list[str]:
    return _NOT_WORD.sub(" ", s).lower().split()


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b))))


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(_words(a)), set(_words(b))
    if not x or not y:
        return 0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100
    base = " ".join(both)
    left, right = " ".join(both + only_x), " ".join(both + only_y)
    scores = [_raw(left, right)]
    if base:
        scores += [_raw(base, left), _raw(base, right)]
    return round(max(scores))


RATIOS: dict[str, Callable[[str, str], int]] = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio)}


def fuzzy(name: str, a: Column, b: Column) -> Column:
    """One ratio as an integer column; null counts as empty."""
    f = RATIOS[name]

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p or "", q or "") for p, q in zip(x, y)], dtype="int32")

    return run(a, b)


def fuzzy_max(pairs: list[tuple[str, Column, Column]]) -> Column:
    """The largest of several ratios in one pass over the rows."""
    fs = [RATIOS[n] for n, _, _ in pairs]

    @F.pandas_udf(T.IntegerType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([max(f(r[2 * k] or "", r[2 * k + 1] or "") for k, f in enumerate(fs)) for r in zip(*cols)], dtype="int32")

    return run(*(c for _, a, b in pairs for c in (a, b)))
