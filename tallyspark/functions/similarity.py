"""Similarity of names by the longest common subsequence. No built-in expression has it (levenshtein counts substitutions)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: one integer holds a row of the table."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def best_ratio(a: str | None, b: str | None) -> float:
    """STR9: the better of the plain and the word-sorted ratio; 0 if a name is missing."""
    return max(ratio(a, b), ratio(sorted_words(a), sorted_words(b))) if a and b else 0.0


def containment(a: str | None, b: str | None) -> float:
    """STR10: best ratio of the shorter name (4 signs at least, strictly shorter) with a stretch of the longer as long as it."""
    a, b = sorted(((a or "").replace(" ", ""), (b or "").replace(" ", "")), key=len)
    if len(a) < 4 or len(a) == len(b):
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


#: Pairs whose subsequences are counted together, and the signs that a word of bits holds.
TOGETHER, WORD = 2000, 63


def _signs(texts: list[str]) -> np.ndarray:
    """A row of code points for each text, zeros behind them."""
    table = np.array(texts, dtype=np.str_)
    return table.view(np.uint32).reshape(len(texts), -1) if table.dtype.itemsize else np.zeros((len(texts), 0), np.uint32)


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """`common_subsequence` of each pair, for many pairs at once; only texts of over `WORD` signs, or with others than ASCII, are taken one by one."""
    out = np.zeros(len(a), np.int64)
    plain = np.array([len(x) <= WORD and len(y) <= WORD and x.isascii() and y.isascii() for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~plain):
        out[i] = common_subsequence(a[i], b[i])
    usable = np.flatnonzero(plain)
    for start in range(0, len(usable), TOGETHER):
        some = usable[start : start + TOGETHER]
        one, two, each = _signs([a[i] for i in some]), _signs([b[i] for i in some]), np.arange(len(some))
        size = np.array([len(b[i]) for i in some], np.uint64)
        masks = np.zeros((len(some), 128), np.uint64)
        for i in range(two.shape[1]):
            masks[each, two[:, i]] |= np.where(i < size, np.uint64(1 << i), np.uint64(0))
        full = (np.uint64(1) << size) - np.uint64(1)
        row = full.copy()
        for i in range(one.shape[1]):
            hit = row & np.where(one[:, i] > 0, masks[each, one[:, i]], np.uint64(0))
            row = ((row + hit) | (row - hit)) & full
        out[some] = size.astype(np.int64) - np.bitwise_count(row)
    return out


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    return np.where(both > 0, 100.0 * 2 * common_subsequences(a, b) / np.maximum(both, 1), 100.0)


def best_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """`best_ratio` of each pair."""
    there = np.array([bool(x) and bool(y) for x, y in zip(a, b)], bool)
    a, b = [x or "" for x in a], [x or "" for x in b]
    by_words = {x: sorted_words(x) for x in {*a, *b}}
    return np.where(there, np.maximum(_ratios(a, b), _ratios([by_words[x] for x in a], [by_words[x] for x in b])), 0.0)


def are_contained(a: list[str | None], b: list[str | None], least: float) -> np.ndarray:
    """Whether each pair's `containment` reaches `least`. What of the shorter name stands in a stretch stands in the whole longer one, so most pairs are told by that alone."""
    pairs = [sorted(((x or "").replace(" ", ""), (y or "").replace(" ", "")), key=len) for x, y in zip(a, b)]
    size = np.array([len(x) for x, _ in pairs], np.int64)
    told = (size >= 4) & (size < np.array([len(y) for _, y in pairs], np.int64))
    some = np.flatnonzero(told)
    most = common_subsequences([pairs[i][0] for i in some], [pairs[i][1] for i in some])
    out = np.full(len(pairs), 0.0 >= least)
    for i in some[200.0 * most / np.maximum(size[some] + most, 1) >= least - 1e-9]:
        out[i] = containment(*pairs[i]) >= least
    return out


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(best_ratios(a.tolist(), b.tolist()))


@F.pandas_udf(DoubleType())
def name_containment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment(x, y) for x, y in zip(a, b)])


@F.pandas_udf(BooleanType())
def name_contained(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series(are_contained(a.tolist(), b.tolist(), least.iloc[0] if len(least) else 0.0))
