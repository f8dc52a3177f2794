"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap checks.

Test items are indexed by word, their BM25 contributions divided by the item's score against
itself, so one threshold fits all. Items are sorted by length into classes; a class whose
longest item has L words is queried with passages of 2L words at every L words of a document,
so each occurrence lies whole within a passage. The index keeps, for each word, the item blocks
that hold it with the word's greatest contribution there. These bounds, summed over a passage's
different words for many passages at once, discard most passages; the rest go through WAND,
which skips blocks by the same maxima and returns every item above the threshold.
An item counts as leaked if the passage holds at least 0.8 of its question's five-word
shingles and of its answer's words; question and answer are the first three quarters of an
item's words and the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, unstage

K1, B, THRESHOLD, OVERLAP, WIDTH = 1.2, 0.75, 0.6, 0.8, 5
BLOCK, CLASSES = 8, (12, 24, 48, 96)
#: An index holds at most so many items, chosen by hash; more items make more indexes, one after
#: another, each with its own pass. Frequencies and lengths always come from all items.
SHARD = 20_000
#: Cells of the table of passages and item blocks that is summed at once.
CELLS = 1 << 22
words = re.compile(r"\w+").findall


@dataclass
class Statistics:
    """What BM25 takes from all items: their number, mean length, and how many hold a word."""

    n: int
    mean: float
    df: dict[str, int]

    @staticmethod
    def of(items: list[list[str]]) -> Statistics:
        n = len(items)
        return Statistics(n, sum(map(len, items)) / max(1, n), dict(Counter(w for ws in items for w in set(ws))))


class Index:
    """The inverted index of some items, immutable after it is built. ``stats``: of all items, if these aren't all."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None) -> None:
        docs = sorted(((i, words((t or "").lower())) for i, t in items), key=lambda x: (len(x[1]), x[0]))
        docs = [d for d in docs if d[1]]
        self.items = docs
        stats = stats or Statistics.of([ws for _, ws in docs])
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in docs for w in ws}))}
        idf = {w: math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) for w in self.vocab}
        edges = [*CLASSES, 1 << 60]
        groups: dict[int, list[int]] = {}
        for k, (_, ws) in enumerate(docs):
            groups.setdefault(next(i for i, e in enumerate(edges) if len(ws) <= e), []).append(k)
        self.classes = []
        for own in groups.values():
            postings: dict[int, tuple[list[int], list[float]]] = {}
            bounds: dict[int, dict[int, float]] = {}
            for at, k in enumerate(own):
                ws = docs[k][1]
                norm = K1 * (1 - B + B * len(ws) / stats.mean)
                part = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in Counter(ws).items()}
                whole = sum(part.values())
                for w, x in part.items():
                    t = self.vocab[w]
                    ids, xs = postings.setdefault(t, ([], []))
                    ids.append(at)
                    xs.append(x / whole)
                    low = bounds.setdefault(t, {})
                    low[at // BLOCK] = max(low.get(at // BLOCK, 0.0), x / whole)
            # the same bounds as arrays: the blocks of term t are those from ptr[t] to ptr[t + 1]
            size = [len(bounds.get(t, ())) for t in range(len(self.vocab))]
            flat = [x for t in range(len(self.vocab)) for x in bounds.get(t, {}).items()]
            self.classes.append({
                "own": own, "length": max(len(docs[k][1]) for k in own), "postings": postings, "bounds": bounds,
                "most": {t: max(x.values()) for t, x in bounds.items()}, "blocks": -(-len(own) // BLOCK),
                "ptr": np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
                "block": np.array([x[0] for x in flat], np.int64), "bound": np.array([x[1] for x in flat]),
            })

    def best_bounds(self, c: dict, half: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` halves, the greatest bound of a block by this half's and the next one's terms.

        ``half`` and ``term`` are pairs in ascending order of the half. Work goes by the blocks
        that hold a term, and a bounded table of halves and blocks is summed at a time.
        """
        out, blocks = np.zeros(n), c["blocks"]
        step = max(1, CELLS // blocks)
        for a in range(0, n, step):
            b = min(n, a + step)
            u, v = np.searchsorted(half, [a, b + 1])  # and one half more, to add the next one's terms
            first, size = c["ptr"][term[u:v]], np.diff(c["ptr"])[term[u:v]]
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            cell = np.repeat(half[u:v] - a, size) * blocks + c["block"][at]
            s = np.bincount(cell, c["bound"][at], (b + 1 - a) * blocks).reshape(-1, blocks)
            out[a:b] = (s[:-1] + s[1:]).max(1)
        return out

    def wand(self, c: dict, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items of class ``c`` at THRESHOLD or above."""
        end = len(c["own"])
        cursors = [[0, c["postings"][t], c["bounds"][t], c["most"][t]] for t in terms if t in c["postings"]]
        found = []
        at = lambda x: x[1][0][x[0]] if x[0] < len(x[1][0]) else end

        def seek(x: list, to: int) -> None:
            ids = x[1][0]
            while x[0] < len(ids) and ids[x[0]] < to:
                x[0] += 1

        while True:
            cursors = sorted((x for x in cursors if at(x) < end), key=at)
            total, pivot = 0.0, -1
            for k, x in enumerate(cursors):
                total += x[3]
                if total >= THRESHOLD - 1e-9:
                    pivot = at(x)
                    last = k
                    break
            if pivot < 0:
                return found
            while last + 1 < len(cursors) and at(cursors[last + 1]) == pivot:
                last += 1
            block = pivot // BLOCK
            if sum(x[2].get(block, 0.0) for x in cursors[: last + 1]) < THRESHOLD - 1e-9:
                to = (block + 1) * BLOCK  # no item of this block can reach the threshold with these terms
                if last + 1 < len(cursors):
                    to = min(to, at(cursors[last + 1]))
                for x in cursors[: last + 1]:
                    seek(x, to)
                continue
            if at(cursors[0]) == pivot:
                score = sum(x[1][1][x[0]] for x in cursors[: last + 1])
                if score >= THRESHOLD - 1e-9:
                    found.append((c["own"][pivot], score))
                for x in cursors[: last + 1]:
                    x[0] += 1
            else:
                for x in cursors[: last + 1]:
                    seek(x, pivot)


def _shingles(ws: list[str]) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + WIDTH]) for i in range(max(1, len(ws) - WIDTH + 1))}


def overlaps(item: list[str], passage: list[str]) -> tuple[float, float]:
    """Shares of the question's shingles and of the answer's words that the passage holds."""
    cut = max(1, round(len(item) * 0.75))
    question, answer = item[:cut], Counter(item[cut:])
    own = _shingles(question)
    n = min(len(question), WIDTH)
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    q = len(own & there) / len(own)
    a = (answer & Counter(passage)).total() / answer.total() if answer else 1.0
    return q, a


def find(index: Index, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item_id, score, question, answer) of each leak, the best passage of each pair."""
    toks = [words(t.lower()) for t in texts]
    lens = np.array([len(w) for w in toks], np.int64)
    first = np.cumsum(lens) - lens
    get = index.vocab.get
    ids = np.fromiter((i for w in toks for i in map(get, w, repeat(-1))), np.int64, int(lens.sum()))
    known = np.flatnonzero(ids >= 0)
    doc = np.repeat(np.arange(len(texts)), lens)[known]
    place, ids = known - first[doc], ids[known]
    v = max(1, len(index.vocab))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for c in index.classes:
        n = c["length"]
        halves = -(-lens // n) + 1
        base = np.cumsum(halves) - halves
        pair = np.unique((base[doc] + place // n) * v + ids)
        half, term = pair // v, pair % v
        top = index.best_bounds(c, half, term, int(halves.sum()))
        for h in np.flatnonzero(top >= THRESHOLD - 1e-9).tolist():
            d = int(np.searchsorted(base, h, "right")) - 1
            at = (h - int(base[d])) * n
            passage = toks[d][at : at + 2 * n]
            a, b = np.searchsorted(half, [h, h + 2])
            for k, score in index.wand(c, list(dict.fromkeys(term[a:b].tolist()))):
                q, s = overlaps(index.items[k][1], passage)
                if q >= OVERLAP and s >= OVERLAP:
                    key = (d, index.items[k][0])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, s))
    for (d, item), x in best.items():
        yield (d, item, *x)


def _statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """Staged words (word, df), the number of items with words, and their mean length."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ws = [words((t or "").lower()) for t in b.column(0).to_pylist()]
        own = [sorted(set(w)) for w in ws]
        return pa.RecordBatch.from_arrays([pa.array(map(len, ws), pa.int64()), pa.array(own, pa.list_(pa.string()))], ["size", "own"])

    sizes = stage(map_batches(items.select("text"), run, "size long, own array<string>").filter("size > 0"), "item-words")
    df = stage(sizes.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "df")
    t = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    unstage(sizes)
    return df, t["n"], t["mean"] or 0.0


def _indexes(items: DataFrame, shard: int) -> Iterator:
    """Broadcast indexes of about ``shard`` items at most, built one at a time."""
    spark = items.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = max(1, -(-own.count() // shard))
    if n == 1:  # all items: their own statistics are the whole ones
        yield spark.sparkContext.broadcast(Index([tuple(r) for r in own.collect()]))
        return
    df, count, mean = _statistics(own)
    for k in range(n):
        rows = [tuple(r) for r in own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
        here = spark.createDataFrame(sorted((w,) for w in {w for _, t in rows for w in words((t or "").lower())}), "word string")
        known = {r["word"]: r["df"] for r in df.join(here, "word").collect()}
        yield spark.sparkContext.broadcast(Index(rows, Statistics(count, mean, known)))
    unstage(df)


def keep(docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Null and empty texts hold nothing; rows with a null doc_id and repeated rows are judged
    each; without items all rows stay; an empty table gives no rows.
    """
    at = docs.columns.index("text")
    was = None
    for index in _indexes(items, shard):
        if was is not None:  # a pass is done before the next index is built
            docs = stage(docs, "clean")
            was.unpersist()

        def run(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(at).to_pylist()]
            clean = np.ones(len(texts), bool)
            for a in range(0, len(texts), 500):
                for x in find(index.value, texts[a : a + 500]):
                    clean[a + x[0]] = False
            return b.filter(pa.array(clean))

        docs, was = map_batches(docs, run, docs.schema), index
    return docs


def leaks(docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak in ``docs``.

    Items without words match nothing; repeated rows of ``items`` count once, equal texts of
    different ids are all reported; null texts are empty;
    repeated rows of ``docs`` give repeated results; other columns are ignored; an empty
    table on either side gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = was = None
    for index in _indexes(items, shard):
        if was is not None:  # a pass is done before the next index is built
            out = stage(out, "leaks")
            was.unpersist()

        def run(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            own = b.column(0)
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [(at + x[0], *x[1:]) for at in range(0, len(texts), 500) for x in find(index.value, texts[at : at + 500])]
            cols = list(zip(*got)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            arrays = [own.take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        part = map_batches(d, run, schema)
        out, was = (part if out is None else out.union(part)), index
    return out
