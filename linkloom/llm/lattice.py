"""Language-model scoring by subword lattices.

A text is a sequence of vocabulary pieces and one end. Its probability is the sum over all
segmentations of the product of the pieces' probabilities. No piece reaches over a word's
start, so the sum is a product over words, each found by a forward recursion in log space.

The vocabulary and its scores exist already. The scores, as Zipf's law has them (they are
ranks), weight the segmentations of every different training word; the expected piece counts
over the whole corpus are added to a prior that the scores make as well, and the sums weight
the segmentations again, ``ROUNDS`` times in all. Characters outside the vocabulary fall back
to byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import ship

from .common import gathered, stage, text_bytes
from .quality import held_out

MARK, LONG, ROWS = "▁", 96, 4096
CHUNK_TOKENS = 3_000_000
#: Words handled at once: enough of each length for whole-array work.
WORDS = 20_000
#: Weight of the prior in expected pieces; its ranks are flattened by this offset.
PRIOR, FLAT = 3200.0, 10.0
#: How often expected piece counts are taken.
ROUNDS = 2
NONE = -1e300


class Lattice:
    """Pieces with a hash table for look-ups of many substrings at once."""

    def __init__(self, pieces: list[str], byte_ids: list[int], ids: list[int], size: int) -> None:
        self.ids = dict(zip(pieces, ids))
        self.byte_ids, self.size = byte_ids, size
        self.most = max(map(len, pieces))
        self.bits = 19
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.full(1 << self.bits, -1, np.int32)
        for p, i in self.ids.items():
            h = 0
            for ch in p:
                h = (h * 0x100000001B3 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            at = self._slot(np.array([h], np.uint64))[0]
            while self.vals[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.vals[at] = h, i
        run = self.vals >= 0
        self.probes = max(map(len, "".join("x" if r else " " for r in run).split()), default=1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.vals[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.vals[at] >= 0))
        for step in range(1, self.probes + 1):
            if not len(open_):
                break
            slot = (at[open_] + step) & ((1 << self.bits) - 1)
            hit = (self.keys[slot] == h[open_]) & (self.vals[slot] >= 0)
            out[open_[hit]] = self.vals[slot[hit]]
            open_ = open_[~hit & (self.vals[slot] >= 0)]
        return out

    def fallback(self, ch: int, logp: np.ndarray) -> float:
        return float(sum(logp[self.byte_ids[b]] for b in chr(ch).encode("utf-8", "surrogatepass")))

    def arcs(self, cps: np.ndarray, logp: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, piece ids, log probabilities) for words of one length; id -2: by bytes."""
        n = cps.shape[1]
        c = cps.astype(np.uint64)
        for i in range(n):
            h = np.zeros(len(cps), np.uint64)
            for j in range(i, min(n, i + self.most)):
                h = h * np.uint64(0x100000001B3) + c[:, j] + np.uint64(1)
                got = self.find(h)
                if j == i and (got < 0).any():
                    lp = np.where(got >= 0, logp[got], NONE)
                    for ch in np.unique(cps[got < 0, i]).tolist():
                        own = (got < 0) & (cps[:, i] == ch)
                        lp[own] = self.fallback(ch, logp)
                    yield i, j + 1, np.where(got < 0, -2, got), lp
                elif (got >= 0).any():
                    yield i, j + 1, got, np.where(got >= 0, logp[got], NONE)

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lens, kind="stable")
        order = order[lens[order] <= LONG]
        for part in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1) if len(order) else []:
            for a in range(0, len(part), ROWS):
                rows = part[a : a + ROWS]
                text = "".join(MARK + words[k] for k in rows)
                yield rows, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), -1)

    def _scalar(self, word: str, logp: np.ndarray) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        s, ids = MARK + word, self.ids
        alpha = [NONE] * (len(s) + 1)
        alpha[0] = 0.0
        into: list[list[tuple[int, int, float]]] = [[]]
        for j in range(1, len(s) + 1):
            own = [(i, k, float(logp[k])) for i in range(max(0, j - self.most), j) if (k := ids.get(s[i:j])) is not None]
            if not own or own[-1][0] != j - 1:
                own.append((j - 1, -2, self.fallback(ord(s[j - 1]), logp)))
            top = max(alpha[i] + p for i, _, p in own)
            alpha[j] = top + math.log(sum(math.exp(alpha[i] + p - top) for i, _, p in own))
            into.append(own)
        return alpha, into

    def forward(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, cps in self._groups(words):
            alpha = np.full((cps.shape[1] + 1, len(rows)), NONE)
            alpha[0] = 0
            for i, j, _, lp in self.arcs(cps, logp):  # arcs come by start, so alpha[i] is complete
                np.logaddexp(alpha[j], alpha[i] + lp, out=alpha[j])
            out[rows] = alpha[-1]
        for k, w in enumerate(words):
            if len(w) >= LONG:
                out[k] = self._scalar(w, logp)[0][-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected pieces in ``counts`` copies of each word."""
        total = np.zeros(self.size)

        def by_bytes(ch: int, weight: float) -> None:
            for b in chr(ch).encode("utf-8", "surrogatepass"):
                total[self.byte_ids[b]] += weight

        for rows, cps in self._groups(words):
            n = cps.shape[1]
            arcs = list(self.arcs(cps, logp))
            alpha, beta = np.full((n + 1, len(rows)), NONE), np.full((n + 1, len(rows)), NONE)
            alpha[0] = beta[n] = 0
            for i, j, _, lp in arcs:
                np.logaddexp(alpha[j], alpha[i] + lp, out=alpha[j])
            for i, j, _, lp in reversed(arcs):
                np.logaddexp(beta[i], beta[j] + lp, out=beta[i])
            for i, j, k, lp in arcs:
                w = np.exp(np.minimum(0, alpha[i] + lp + beta[j] - alpha[n])) * counts[rows]
                known = k >= 0
                total += np.bincount(k[known], w[known], self.size)
                if (k == -2).any():
                    for ch in np.unique(cps[k == -2, i]).tolist():
                        by_bytes(ch, float(w[(k == -2) & (cps[:, i] == ch)].sum()))
        for at, word in enumerate(words):
            if len(word) >= LONG:
                alpha, into = self._scalar(word, logp)
                s, n = MARK + word, len(word) + 1
                beta = [NONE] * (n + 1)
                beta[n] = 0.0
                for j in range(n, 0, -1):
                    for i, k, p in into[j]:
                        w = float(counts[at]) * math.exp(min(0.0, alpha[i] + p + beta[j] - alpha[n]))
                        if k >= 0:
                            total[k] += w
                        else:
                            by_bytes(ord(s[i]), w)
                        beta[i] = float(np.logaddexp(beta[i], beta[j] + p))
        return total


@cache
def vocabulary(path: str) -> tuple[Lattice, np.ndarray]:
    """The lattice of a vocabulary file and its prior; the end is one more id after the pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    weight = np.zeros(n + 1)
    pieces, ids, byte_ids = [], [], [0] * 256
    for i in range(n):
        if m.IsByte(i):
            byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
            weight[i] = 1 / (n + FLAT)
        elif not (m.IsUnknown(i) or m.IsControl(i) or m.IsUnused(i)):
            pieces.append(m.id_to_piece(i))
            ids.append(i)
            weight[i] = 1 / (FLAT - m.get_score(i))
    weight[n] = weight.max()
    return Lattice(pieces, byte_ids, ids, n + 1), weight / weight.sum()


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-30))


def expected_pieces(counted: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces in the words of ``counted`` (word, c), weighted by ``logp``."""
    sent = counted.sparkSession.sparkContext.broadcast(logp)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = vocabulary(path)[0]
        total = np.zeros(lattice.size)
        for b in gathered(batches, WORDS):
            total += lattice.expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64), sent.value)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["piece", "n"])

    sums = counted.filter("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    out = np.zeros(len(logp))
    for r in sums.collect():  # as many rows as the vocabulary at most
        out[r["piece"]] = r["n"]
    return out


def _chunks(docs: DataFrame, rest: int) -> DataFrame:
    """One row for about CHUNK_TOKENS tokens: its different words, their counts in training
    documents, and each document's words as places in that list."""
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(rest=rest).alias("held")
    )
    schema = "chunk long, words array<string>, counts array<long>, docs array<long>, held array<boolean>, sizes binary, places binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part = 0, TaskContext.get().partitionId()
        index: dict[bytes, int] = {}
        keys, held, sizes, places, times, total = [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            own = np.array(sizes, np.int64)
            where = np.concatenate(places)
            n = np.concatenate(times)
            train = np.repeat(~np.array(held, bool), own)
            counts = np.bincount(where[train], n[train], len(index)).astype(np.int64)
            one = [
                (part << 32) | seq, list(index), counts, keys, held,
                own.astype("<u4").tobytes(), where.astype("<u4").tobytes(), n.astype("<u4").tobytes(),
            ]
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array([x], k) for x, k in zip(one, kinds)]
            arrays[1] = arrays[1].cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            own, out = b.column(0).to_pylist(), b.column(2).to_pylist()
            for k, text in enumerate(text_bytes(b.column(1))):
                w = text.lower().split()
                ids = np.fromiter((index.setdefault(x, len(index)) for x in w), np.int64, len(w))
                u, n = np.unique(ids, return_counts=True)
                keys.append(own[k])
                held.append(out[k])
                sizes.append(len(u))
                places.append(u.astype(np.uint32))
                times.append(n.astype(np.uint32))
                total += len(w)
                if total >= CHUNK_TOKENS:
                    yield row()
                    index, keys, held, sizes, places, times, total, seq = {}, [], [], [], [], [], 0, seq + 1
        if keys:
            yield row()

    ship(docs.sparkSession)
    return d.mapInArrow(run, schema)


def score(docs: DataFrame, path: str, rest: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of ``docs`` by a model of the rows that aren't held out.

    Every different word of the corpus is counted, and every one of them is segmented to learn
    the pieces' probabilities, so what is gathered grows with the corpus; what is sent to the
    executors has the vocabulary's size. Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Null texts are
    empty and consist of the end alone; rows with a null doc_id are training rows; repeated
    rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    chunks = stage(_chunks(docs, rest), "chunks")
    zipped = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    counted = stage(zipped.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")), "words")
    t = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = chunks.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    n_train, v_train = t["n"] + ends, t["v"] + (ends > 0)

    lattice, prior = vocabulary(path)
    logp = _log(prior)
    for _ in range(rounds):
        weight = PRIOR * prior + expected_pieces(counted, path, logp)
        weight[-1] = max(ends, 0.5)  # the end is a piece that each text has once
        logp = _log(weight / weight.sum())
    sent = docs.sparkSession.sparkContext.broadcast(logp)  # of the vocabulary's size

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, WORDS):
            lp = vocabulary(path)[0].forward(b.column(0).to_pylist(), sent.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp)], ["word", "c", "lp"])

    known = counted.mapInArrow(likelihood, "word string, c long, lp double")
    back = zipped.select("chunk", "place", F.col("x.words").alias("word")).join(known, "word").select(
        F.col("chunk").alias("of"), "place", "c", "lp"
    )
    unit = math.log10(n_train + 0.5 * (v_train + 1))
    end_base, end_lp = math.log10(ends + 0.5) - unit, float(logp[-1]) / math.log(10)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        c, lp = np.zeros(size), np.zeros(size)
        at = right.column("place").to_numpy()
        c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base = np.log10(c + 0.5) - unit
        cols: list[list] = [[] for _ in range(7)]
        for r in range(left.num_rows):
            get = lambda name, r=r: left.column(name)[r].as_py()
            sizes, where, n = (np.frombuffer(get(x), "<u4").astype(np.int64) for x in ("sizes", "places", "times"))
            cuts = np.concatenate([[0], np.cumsum(sizes)])

            def sums(x: np.ndarray, cuts=cuts) -> np.ndarray:
                run = np.add.reduceat(np.append(x, 0), cuts[:-1]) if len(cuts) > 1 else np.zeros(0)
                return np.where(np.diff(cuts) > 0, run, 0)

            for col, x in zip(cols, [
                get("docs"), get("held"), (sums(n) + 1).tolist(), (sums(n * (c[where] > 0)) + (ends > 0)).tolist(), [n_train] * len(sizes),
                (sums(n * base[where]) + end_base).tolist(), (sums(n * lp[where]) + end_lp).tolist(),
            ]):
                col.extend(x)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        arrays = [pa.array(x if k not in (pa.int64(),) else [None if v is None else int(v) for v in x], k) for x, k in zip(cols, kinds)]
        return pa.Table.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    kept = chunks.select("chunk", "docs", "held", "sizes", "places", "times")
    return kept.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(finish, schema)
