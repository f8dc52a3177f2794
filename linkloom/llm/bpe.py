"""Byte-level BPE encoding and decoding by tiktoken rank files.

Pre-tokenisation is ``pretoken``'s scan; each different piece is merged once (pairs of least
rank first) and remembered. Where each token starts in the text is kept beside the ids, and
decoding puts each token's bytes at its offset.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .pretoken import PieceCoder

SHORT = 48


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@cache
def vocabulary(path: str) -> list[bytes]:
    r = ranks(path)
    out = [b""] * (max(r.values()) + 1)
    for k, v in r.items():
        out[v] = k
    return out


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    if (one := rank.get(piece)) is not None:
        return [one]
    if len(piece) > SHORT:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = rank.get
    far = 1 << 60
    pairs = [get(a + b, far) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < far:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], far)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], far)
    return [rank[p] for p in parts]


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list: n log n for very long pieces."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at i
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := rank.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to or not alive[end[i]]:
            continue
        j = end[i]
        alive[j] = False
        end[i] = to
        if to < n:
            prev[to] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


@cache
def coder(path: str) -> PieceCoder:
    rank = ranks(path)
    return PieceCoder(lambda pieces: [merge(p.encode("utf-8", "surrogatepass"), rank) for p in pieces])


@cache
def _token_bytes(path: str) -> np.ndarray:
    return np.array([len(t) for t in vocabulary(path)], np.int64)


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """(doc_id, ids, offsets) of each row of ``docs``.

    ids: unsigned 32-bit little-endian; offsets: where each token starts in the text's UTF-8
    bytes, in the same form (null unless asked for). Null and empty texts have no ids; repeated
    rows stay repeated; other columns are ignored; an empty table gives no rows.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder(path)([t or "" for t in b.column(1).to_pylist()])
        at = [None] * len(ids)
        if offsets:
            size = _token_bytes(path)
            at = [(np.cumsum(n := size[x]) - n).astype("<u4").tobytes() for x in ids]
        cols = [b.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.large_binary()), pa.array(at, pa.large_binary())]
        return pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.binary()), cols[2].cast(pa.binary())], ["doc_id", "ids", "offsets"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(d, run, "doc_id long, ids binary, offsets binary")


@cache
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, and where each begins."""
    size = _token_bytes(path)
    return np.frombuffer(b"".join(vocabulary(path)), np.uint8), np.cumsum(size) - size


def place_tokens(ids: np.ndarray, offsets: np.ndarray, path: str) -> bytes:
    """The text whose tokens ``ids`` start at ``offsets``: each token's bytes go to their place.

    Offsets need not begin at 0 or follow one another, so a part of a text decodes by itself.
    """
    if not len(ids):
        return b""
    flat, starts = _token_table(path)
    n = _token_bytes(path)[ids]
    at = offsets.astype(np.int64) - int(offsets.min())
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(int((at + n).max()), np.uint8)
    out[np.repeat(at, n) + nth] = flat[np.repeat(starts[ids], n) + nth]
    return out.tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for, each token at its offset.

    Null ids give null; a row without offsets has its tokens one after another; repeated rows
    stay repeated; other columns are ignored; an empty table gives no rows.
    """

    def text(ids: bytes | None, offsets: bytes | None) -> bytes | None:
        if ids is None:
            return None
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        n = _token_bytes(path)[own]
        return place_tokens(own, np.cumsum(n) - n if offsets is None else np.frombuffer(offsets, "<u4"), path)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [text(*x) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids", "offsets"), run, "doc_id long, ids binary, decoded binary")
