"""Pair similarities. Levenshtein is native; the others go through one Arrow UDF.

Within the UDF strings are arrays of code points, and a whole block of pairs of like length
takes each step at once: Jaro's matching goes letter by letter of the first string, the common
subsequence row by row, with 64 columns in one word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as missing in a pair's fields, and field names in order of preference.
NULL_STRINGS = ["nan", "none", "null", "undefined", "na", "<na>", "nil", ""]
ALIASES = {
    "name": ["business_name_clean", "clean_name", "name_clean", "business_name", "name", "name_base"],
    "address": ["business_address_clean", "clean_address", "addr_clean", "business_address", "address", "street_address"],
    "zip": ["postal_code", "addr_postal_code", "zip_code", "pin_code", "zip", "pin"],
}


def text_field(c: Column) -> Column:
    s = F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(s.isin(NULL_STRINGS), "").otherwise(s)


def zip_field(c: Column) -> Column:
    s = F.regexp_replace(text_field(c), r"^(\d+)\.0$", "$1")
    s = F.regexp_replace(s, "[ -]", "")
    return F.when(s.isin("0", "00000", "000000", "unknown"), "").otherwise(s)


def field(columns: list[str], kind: str, prefix: str = "") -> Column:
    """The first alias of ``kind`` that is there and not empty."""
    of = zip_field if kind == "zip" else text_field
    found = [F.nullif(of(F.col(prefix + a)), F.lit("")) for a in ALIASES[kind] if prefix + a in columns]
    return F.coalesce(*found, F.lit(""))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    both = (a != "") & (b != "")
    return F.when(both, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


#: Pairs that are worked on together.
ROWS = 512
#: Bits of a word: longer strings take one pair at a time.
WORD = 64


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each, padded with zeros, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _blocks(a: list[str], b: list[str], fn: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """``fn`` of pairs, in blocks of like length."""
    out = np.zeros(len(a))
    order = np.argsort([len(x) * 4096 + len(y) for x, y in zip(a, b)], kind="stable")
    for at in range(0, len(order), ROWS):
        own = order[at : at + ROWS]
        out[own] = fn([a[i] for i in own], [b[i] for i in own])
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of pairs; 0 where one is empty."""
    return _blocks(a, b, _jaro_winkler)


def _jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    (x, nx), (y, ny) = _codes(a), _codes(b)
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    rows, col = np.arange(len(a)), np.arange(y.shape[1])
    free = col < ny[:, None]
    met = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):  # each letter takes the first free equal one within reach
        near = free & (y == x[:, i, None]) & (np.abs(col - i) <= reach[:, None])
        at = near.argmax(1)
        met[:, i] = near[rows, at] & (i < nx)
        free[rows[met[:, i]], at[met[:, i]]] = False
    taken = ~free & (col < ny[:, None])
    m = met.sum(1)
    wide = max(1, int(m.max(initial=0)))
    pick = lambda t, flags: np.take_along_axis(t, np.argsort(~flags, axis=1, kind="stable")[:, :wide], 1)
    swaps = ((pick(x, met) != pick(y, taken)) & (np.arange(wide) < m[:, None])).sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - swaps) / some) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    same = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(nx, ny)[:, None])
    lead = np.cumprod(same, axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + lead * 0.1 * (1 - jaro), jaro)


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of pairs' longest common subsequences."""
    out = np.zeros(len(a))
    turn = [len(x) > len(y) for x, y in zip(a, b)]
    a, b = [y if t else x for x, y, t in zip(a, b, turn)], [x if t else y for x, y, t in zip(a, b, turn)]
    short = np.array([len(x) <= WORD for x in a], bool)
    own = np.flatnonzero(short)
    out[own] = _blocks([a[i] for i in own], [b[i] for i in own], _common)
    for i in np.flatnonzero(~short):
        out[i] = _common_long(a[i], b[i])
    return out


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """The same where each first string has at most WORD letters: the letters are bits of one word."""
    (x, nx), (y, ny) = _codes(a), _codes(b)
    letters = np.zeros((len(a), WORD), np.uint32)
    letters[:, : x.shape[1]] = x
    inside = np.arange(WORD) < nx[:, None]
    row = np.full(len(a), ~np.uint64(0))
    for j in range(y.shape[1]):
        hits = inside & (letters == y[:, j, None]) & (j < ny)[:, None]
        at = np.packbits(hits, axis=1, bitorder="little").view("<u8")[:, 0]
        hit = row & at
        row = (row + hit) | (row - hit)
    full = np.where(nx >= WORD, ~np.uint64(0), (np.uint64(1) << (nx % WORD).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~row & full).astype(np.float64)


def _common_long(a: str, b: str) -> int:
    """The same for one pair of any length, with a whole number as the row."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _sizes(x: list[str]) -> np.ndarray:
    return np.fromiter(map(len, x), np.int64, len(x))


def token_sort_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Indel similarity of pairs after their words are sorted; 0 where one is empty."""
    x, y = ([" ".join(sorted(t.split())) for t in side] for side in (a, b))
    total = _sizes(x) + _sizes(y)
    ratio = np.where(total > 0, 2 * common_subsequence(x, y) / np.maximum(total, 1), 1.0)
    return np.where((_sizes(a) > 0) & (_sizes(b) > 0), ratio, 0.0)


def token_set_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """The best indel similarity among the common words and these with each side's other words."""
    sides = [(set(x.split()), set(y.split())) for x, y in zip(a, b)]
    both, only_x, only_y = ([" ".join(sorted(f(x, y))) for x, y in sides] for f in (set.__and__, set.__sub__, lambda x, y: y - x))
    n, ox, oy = _sizes(both), _sizes(only_x), _sizes(only_y)
    gap = (n > 0).astype(np.int64)
    nx, ny = n + gap + ox, n + gap + oy
    far = np.maximum(nx + ny, 1)
    best = 1 - (ox + oy - 2 * common_subsequence(only_x, only_y)) / far
    with_x, with_y = (1 - (1 + o) / np.maximum(n + w, 1) for o, w in ((ox, nx), (oy, ny)))
    best = np.where(n > 0, np.maximum(best, np.maximum(with_x, with_y)), best)
    best = np.where((n > 0) & ((ox == 0) | (oy == 0)), 1.0, best)
    some = np.array([bool(x) and bool(y) for x, y in sides], bool)
    return np.where(some, best, 0.0)


_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("jw", "sort", "set")])


@F.pandas_udf(_TYPE)
def text_similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    index: dict[tuple[str, str], int] = {}
    at = [index.setdefault(p, len(index)) for p in zip(a, b)]
    x, y = map(list, zip(*index)) if index else ([], [])
    known = np.stack([jaro_winkler(x, y), token_sort_ratio(x, y), token_set_ratio(x, y)], 1)
    return pd.DataFrame(known[at], columns=["jw", "sort", "set"])
