"""Vectorised pre-tokenisation of the byte-level BPE pattern, without regular expressions.

The pattern (contractions | ?letters | ?numbers | ?others | white space) is run as a machine
of eight states over code-point classes. A class acts on states as a function; functions
compose associatively, so blocks of the text are reduced to one function each for all start
states at once, the block functions are scanned, and a second sweep fills in the states.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np

# classes of code points: letter, number, other, space, other white space, apostrophe that
# opens a contraction of 2 or 3 characters, end of a text
L, N, O, SP, WS, Q2, Q3, Z = range(8)  # noqa: E741
# states: within letters, numbers, others; after a space, after other white space;
# within a contraction with 2 or 1 characters to come; after a complete match
IN_L, IN_N, IN_O, A_SP, A_WS, C2, C1, DONE = range(8)
#: White space of Unicode.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STEP = 64
SEGMENT = 1 << 19


@cache
def classes() -> np.ndarray:
    kind = {"L": L, "N": N}
    t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    t[WHITE] = WS
    t[0x20] = SP
    return t


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and cut[class, state]: does a match start before the character?"""
    after, cut = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    for state in range(8):
        for c in range(8):
            if state in (C2, C1) and c != Z:
                after[c, state] = C1 if state == C2 else DONE
                continue
            joined = {L: IN_L, N: IN_N, O: IN_O, SP: A_SP, WS: A_WS, Q2: IN_O, Q3: IN_O, Z: DONE}[c]
            runs_on = (state, joined) in ((IN_L, IN_L), (IN_N, IN_N), (IN_O, IN_O)) or (
                state == A_SP and joined in (IN_L, IN_N, IN_O)
            )
            cut[c, state] = not runs_on
            after[c, state] = {Q2: C1, Q3: C2}.get(c, joined) if not runs_on else joined
    return after, cut


AFTER, CUT = _machine()


def _scan(cls: np.ndarray, start: int) -> np.ndarray:
    """The state before each character, beginning with ``start``."""
    n = len(cls)
    if n <= STEP:
        out, s = np.empty(n, np.uint8), start
        for i, c in enumerate(cls.tolist()):
            out[i] = s
            s = AFTER[c, s]
        return out
    rows = -(-n // STEP)
    grid = np.full(rows * STEP, Z, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, STEP).T)
    flat = AFTER.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for col in grid:
        f = flat[(col.astype(np.int16) << 3)[:, None] + f]
    first = _compose(f, start)
    out = np.empty((STEP, rows), np.uint8)
    s = first
    for i, col in enumerate(grid):
        out[i] = s
        s = flat[(col.astype(np.int16) << 3) + s]
    return out.T.reshape(-1)[:n]


def _compose(f: np.ndarray, start: int) -> np.ndarray:
    """The state before each block, from the blocks' functions; doubling scan."""
    g = f.copy()
    step = 1
    while step < len(g):
        h = g.copy()
        h[step:] = np.take_along_axis(g[step:], g[:-step].astype(np.intp), 1)
        g = h
        step *= 2
    out = np.empty(len(g), np.uint8)
    out[0] = start
    out[1:] = g[:-1, start]
    return out


def boundaries(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of all matches in code points ``cps``; texts end before the positions ``ends``,
    which hold one filler each. Fillers appear as starts too."""
    cls = classes()[cps]
    quote = np.flatnonzero(cps == 39)
    padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
    a, b = padded[quote + 1], padded[quote + 2]
    # fixed values: the contractions of the pattern: s t m d, then re ve ll
    two = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    cls[ends] = Z
    near = np.concatenate([cls, np.full(2, Z, np.uint8)])
    ok2, ok3 = near[quote + 1] != Z, (near[quote + 1] != Z) & (near[quote + 2] != Z)
    cls[quote[two & ok2]] = Q2
    cls[quote[three & ok3]] = Q3
    cls[ends] = Z
    cut = CUT[cls, _scan(cls, DONE)]
    # white space: a run is one match, but its last character is left for what follows it
    white = (cls == SP) | (cls == WS)
    before = np.concatenate([[False], white[:-1]])
    solid = np.concatenate([~white[1:] & (cls[1:] != Z), [False]])
    cut = np.where(white, ~before | solid, cut)
    return np.flatnonzero(cut)


def segments(text: str) -> Iterator[str]:
    """Parts of a long text, cut where a match always starts: before white space after a letter."""
    at = 0
    while len(text) - at > SEGMENT:
        p = at + SEGMENT
        while p > at and not (text[p] in " \n" and text[p - 1].isalpha()):
            p -= 1
        if p == at:
            p = at + SEGMENT
            while p < len(text) and not (text[p] in " \n" and text[p - 1].isalpha()):
                p += 1
        yield text[at:p]
        at = p
    yield text[at:]


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(indices of the texts, segments) in order, about SEGMENT characters at a time."""
    who: list[int] = []
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        for s in segments(t):
            if size + len(s) > SEGMENT and parts:
                yield who, parts
                who, parts, size = [], [], 0
            who.append(i)
            parts.append(s)
            size += len(s) + 1
    if parts:
        yield who, parts


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


#: Masks for the first k bytes of a little-endian word.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SHORT = 16


class PieceCoder:
    """Encodes texts to ids by their pieces, remembering at most about ``most`` different pieces.

    Pieces of up to 16 bytes are two words and a length, looked up for all pieces of a chunk
    at once in an open-addressing table of numpy arrays; longer ones go through a dict.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 500_000) -> None:
        self.encode, self.most = encode, most
        self.bits = max(10, (2 * most).bit_length())
        self.forget()

    def forget(self) -> None:
        size = 1 << self.bits
        self.key1, self.key2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int32)  # number of the piece
        self.long: dict[bytes, int] = {}
        self.count = 0
        self.lens, self.ends, self.flat = np.zeros(1024, np.int64), np.zeros(1025, np.int64), np.zeros(4096, np.uint32)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mix(a, b) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._slot(a, b)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & ((self.key1[at] != a) | (self.key2[at] != b)))
        mask, step = (1 << self.bits) - 1, 1
        while len(wrong):
            slot = (at[wrong] + step) & mask
            got = self.value[slot]
            out[wrong] = got
            wrong = wrong[(got >= 0) & ((self.key1[slot] != a[wrong]) | (self.key2[slot] != b[wrong]))]
            step += 1
        return out.astype(np.int64)

    def _insert(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        at, mask = self._slot(a, b), (1 << self.bits) - 1
        todo = np.arange(len(a))
        while len(todo):
            free = todo[self.value[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            own = free[one]
            self.key1[at[own]], self.key2[at[own]], self.value[at[own]] = a[own], b[own], number[own]
            todo = np.setdiff1d(todo, own, assume_unique=True)
            taken = todo[self.value[at[todo]] >= 0]
            at[taken] = (at[taken] + 1) & mask

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Encode pieces that aren't known and return their numbers."""
        got = self.encode([p.decode("utf-8", "surrogatepass") for p in new])
        more = np.fromiter(map(len, got), np.int64, len(got))
        a, b = self.count, self.count + len(new)
        used = int(self.ends[a])
        need = used + int(more.sum())
        if b > len(self.lens):
            self.lens = np.concatenate([self.lens, np.zeros(b, np.int64)])
            self.ends = np.concatenate([self.ends, np.zeros(b, np.int64)])
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.uint32)])
        self.lens[a:b] = more
        self.ends[a + 1 : b + 1] = used + np.cumsum(more)
        self.flat[used:need] = np.fromiter(chain.from_iterable(got), np.uint32, need - used)
        self.count = b
        return np.arange(a, b)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for who, segs in chunks(texts):
            joined = "\n".join([*segs, ""])
            cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            raw = joined.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw + bytes(24), np.uint8)
            lens = np.fromiter(map(len, segs), np.int64, len(segs))
            ends = np.cumsum(lens + 1) - 1
            starts = boundaries(cps, ends)
            filler = np.searchsorted(starts, ends)  # where the fillers are
            if len(raw) != len(cps):
                starts = np.flatnonzero((data[: len(raw)] & 0xC0) != 0x80)[starts]
            if self.count > self.most:
                self.forget()
            idx = self._numbers(raw, data, starts, filler)
            n = np.where(idx >= 0, self.lens[idx], 0)
            total = np.concatenate([[0], np.cumsum(n)])
            src = np.repeat(self.ends[idx] - total[:-1], n)
            src += np.arange(total[-1])
            ids = self.flat[src]
            a = 0
            for i, b in zip(who, total[filler].tolist()):
                parts[i].append(ids[a:b])
                a = b
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]

    def _numbers(self, raw: bytes, data: np.ndarray, starts: np.ndarray, filler: np.ndarray) -> np.ndarray:
        """The number of each piece; -1 for fillers."""
        size = np.diff(np.append(starts, len(raw)))
        w = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        a = w[starts] & MASKS[np.minimum(size, 8)]
        rest = np.clip(size - 8, 0, 8)
        b = w[starts + 8] & MASKS[rest]
        zero = np.flatnonzero(data[starts + np.maximum(size, 1) - 1] == 0)
        size[zero] += SHORT  # words don't tell "x" from "x" and a zero byte: those go through the dict
        idx = self._find(a, b)
        far = size > SHORT
        size[zero] -= SHORT
        far[filler] = False
        idx[filler] = -1
        for i in np.flatnonzero(far).tolist():
            idx[i] = self.long.get(raw[starts[i] : starts[i] + size[i]], -2)
        idx[filler] = 0
        unknown = np.flatnonzero(idx < 0)
        if len(unknown):
            near = unknown[~far[unknown]]
            pairs = np.stack([a[near], b[near]], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            s = pairs[order]
            fresh = np.concatenate([[True], (s[1:] != s[:-1]).any(1)]) if len(s) else np.zeros(0, bool)
            one = near[order[fresh]]
            if len(one):
                new = [raw[u : u + v] for u, v in zip(starts[one].tolist(), size[one].tolist())]
                number = self._learn(new)
                self._insert(a[one], b[one], number)
                idx[near[order]] = number[np.cumsum(fresh) - 1]
            wide = unknown[far[unknown]].tolist()
            if wide:
                new = list(dict.fromkeys(raw[starts[i] : starts[i] + size[i]] for i in wide))
                self.long.update(zip(new, self._learn(new).tolist()))
                for i in wide:
                    idx[i] = self.long[raw[starts[i] : starts[i] + size[i]]]
        idx[filler] = -1
        return idx
