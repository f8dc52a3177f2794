"""Two-stage suffix sorting in numpy, of all or of chosen suffixes of a byte string.

Suffixes smaller than their successors are sorted directly, eight bytes at a time and to a
given depth. The others are induced: buckets of first bytes are scanned in ascending order,
and each suffix found there appends its predecessor, if that is of the other kind, to the
predecessor's bucket. Whole buckets are handled at once.
"""

from __future__ import annotations

import numpy as np

PAD = 64


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one little-endian number; data must be padded by 8 or more."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one never is."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    inside = at < len(differs)
    d = differs[at[inside]]
    out[inside] = t[d] < t[d + 1]
    return out


def _direct(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the first ``depth`` bytes (rounded up to eights) from each."""
    w = words_at(data)
    key = w[places].byteswap()
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(places) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | np.concatenate([~fresh[1:], [False]]))
        if not len(tied):
            break
        key = w[places[tied] + at].byteswap()
        order = np.lexsort((key, group[tied]))
        places[tied] = places[tied][order]
        key, own = key[order], group[tied]
        fresh[tied] |= np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    return places


def sort_suffixes(t: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Places of ``wanted`` suffixes (all, if None) of ``t`` in order.

    With ``depth``, suffixes that agree in so many bytes may come in any order.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    data = np.concatenate([t, np.zeros(max(PAD, depth + 16), np.uint8)])
    small = smaller_than_next(t)
    if wanted is None:
        active = np.ones(n, bool)
    else:  # and what they are induced from: all up to the next directly sorted suffix
        direct = np.flatnonzero(small)
        at = np.searchsorted(direct, wanted)
        until = np.append(direct, n - 1)[np.minimum(at, len(direct))]
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, wanted, 1)
        np.add.at(step, until + 1, -1)
        active = np.cumsum(step[:-1]) > 0
    places = np.flatnonzero(active & small)
    if depth >= n:  # exact order needs the ends: a shorter suffix goes first
        places = np.array(sorted(places.tolist(), key=lambda i, b=t.tobytes(): b[i:]), np.int64)
    else:
        places = _direct(data, places, depth)
    starts = np.searchsorted(t[places], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if active[n - 1] and not small[n - 1]:
        queue[t[n - 1]].append(np.array([n - 1]))
    out = []

    def before(x: np.ndarray) -> np.ndarray:
        p = x[x > 0] - 1
        return p[active[p] & ~small[p]]

    for c in range(256):
        part = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        queue[c] = []
        level, found = part, [part]
        while len(level):
            level = before(level)
            level = level[t[level] == c]
            found.append(level)
        bucket = np.concatenate([*found, places[starts[c] : starts[c + 1]]])
        out.append(bucket)
        if len(bucket):
            p = before(bucket)
            first = t[p]
            p, first = p[first > c], first[first > c]
            order = np.argsort(first, kind="stable")
            p, first = p[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for q in np.split(p, cuts) if len(p) else []:
                queue[t[q[0]]].append(q)
    sa = np.concatenate(out)
    if wanted is not None:
        mark = np.zeros(n, bool)
        mark[wanted] = True
        sa = sa[mark[sa]]
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each sorted suffix, the bytes it shares with the one before it, ``cap`` at most; 0 first."""
    out = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return out
    w = words_at(np.concatenate([t, np.zeros(cap + 16, np.uint8)]))
    a, b, own = sa[:-1], sa[1:], np.arange(1, len(sa))
    for at in range(0, cap, 8):
        x = w[a + at] ^ w[b + at]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        out[own] += same
        go = same == 8
        a, b, own = a[go], b[go], own[go]
    return np.minimum(out, np.minimum(cap, len(t) - np.concatenate([[len(t)], np.maximum(sa[:-1], sa[1:])])))
