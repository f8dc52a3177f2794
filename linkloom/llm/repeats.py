"""Removal of repeated byte strings by suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.

Exact copies are reduced to one text first. Each 50-byte window of a text has an anchor: the
24-byte string within it of least hash. Equal windows have equal anchors, so

1. every chunk of texts sends the hashes of its anchors, each once, and learns which occur in
   more than one text (two bits an anchor come back);
2. the windows of those anchors, as short segments, meet by anchor; identical segments of a
   chunk are sent once. The segments of a group are joined to one string, whose window starts
   are put in suffix order by two-stage sorting; adjacent common prefixes of 50 bytes or more
   form classes, and each window whose class holds a smaller document is repeated;
3. the removed runs come back to the chunks, which cut them out.

Nothing is judged by hashes alone: they only choose which windows meet. A very common anchor
(in more than HOT chunks) has its windows dealt one by one, by content, so that no group
gathers all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import ship

from .common import join_spread, n_partitions, stage, unstage
from .suffix import common_prefixes, sort_suffixes, words_at

WIDTH, GRAM = 50, 24
SPAN = WIDTH - GRAM + 1  # anchors' places within a window
CHUNK_BYTES, GROUP_BYTES, HOT, BLOCK = 4 << 20, 2 << 20, 1000, 1 << 19
LOWEST = -(1 << 63)
NOTHING = hashlib.sha256(b"").digest()


def _mix(x: np.ndarray, c: int) -> np.ndarray:
    x = x * np.uint64(c)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, op: np.ufunc, fill: int) -> np.ndarray:
    """op over SPAN values from each place on."""
    n = len(x)
    y = np.concatenate([x, np.full(SPAN, fill, x.dtype)])
    step = 1
    while 2 * step <= SPAN:
        y[: len(y) - step] = op(y[: len(y) - step], y[step:])
        step *= 2
    rest = SPAN - step
    return op(y[:n], y[rest : rest + n])


def _blocks(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    a = size = 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > BLOCK:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(lens):
        yield a, len(lens)


def anchors(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key) of each anchor of texts that lie one after another.

    Windows are those that lie within a text; the windows of an anchor follow one another.
    """
    parts = []
    offsets = np.concatenate([[0], np.cumsum(lens)])
    for a, b in _blocks(lens):
        lo, hi = int(offsets[a]), int(offsets[b])
        n = hi - lo
        if n < WIDTH:
            continue
        w = words_at(np.concatenate([data[lo:hi], np.zeros(64, np.uint8)]))
        h = _mix(w[:n], 0x9E3779B97F4A7C15) + w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = _mix(h, 0xBF58476D1CE4E5B9) + w[16 : n + 16] * np.uint64(0x165667B19E3779F9)
        h = _mix(h, 0x94D049BB133111EB) | np.uint64(1)
        ends = offsets[a + 1 : b + 1] - lo
        gram, window = np.ones(n, bool), np.ones(n, bool)  # may one start here and end within the text?
        for short, mark in ((GRAM - 1, gram), (WIDTH - 1, window)):
            late = (ends[:, None] - np.arange(1, short + 1)).ravel()
            mark[late[late >= 0]] = False
        least = _slide(np.where(gram, h, np.uint64(2**64 - 1)), np.minimum, 2**64 - 1)
        low = np.where(window, least, np.uint64(0))
        # a place is an anchor if it has the least hash of some window that holds it
        most = _slide(low[::-1], np.maximum, 0)[::-1]
        place = np.flatnonzero((most == h) & gram)
        s = np.flatnonzero(window)
        at = np.searchsorted(place, s)
        wrong = np.flatnonzero(h[place[at]] != low[s])
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[h[place[at[wrong]]] != low[s[wrong]]]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        parts.append((s[first] + lo, np.diff(np.append(first, len(s))), _mix(h[place[at[first]]], 0xD6E8FEB86659FD93)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _keys(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a chunk, ascending, and whether more than one text has them."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    k, d = keys[new], doc[new]
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(first) - 1
    many = np.zeros(group[-1] + 1, bool)
    many[group[1:][(d[1:] != d[:-1]) & ~first[1:]]] = True
    return k[first], many


def _pack(docs: DataFrame) -> DataFrame:
    """Chunks of about CHUNK_BYTES: (chunk, leads, lens, shas, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part = 0, TaskContext.get().partitionId()
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            leads, shas, texts = zip(*held)
            cols = [
                pa.array([(part << 32) | seq], pa.int64()),
                pa.array([np.array(leads, "<i8").tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(shas)], pa.binary()),
                pa.array([b"".join(texts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "leads", "lens", "shas", "blob"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in range(3))):
                held.append(x)
                size += len(x[2])
                if size >= CHUNK_BYTES:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "chunk long, leads binary, lens binary, shas binary, blob binary")


def _open(leads: bytes, lens: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(leads, "<i8"), np.frombuffer(lens, "<i8"), np.frombuffer(blob, np.uint8)


def _rows(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names.split())


def _ask(chunks: DataFrame, groups: int) -> DataFrame:
    """(group, chunk, keys, many): the different anchor keys of each chunk by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, leads, lens, blob = (b.column(c)[i].as_py() for c in range(4))
                _, lens, data = _open(leads, lens, blob)
                s, _, keys = anchors(data, lens)
                doc = np.searchsorted(np.cumsum(lens), s, "right")
                k, many = _keys(keys, doc)
                g = (k % np.uint64(groups)).astype(np.int64)
                order = np.argsort(g, kind="stable")
                g, k, many = g[order], k[order], many[order]
                own, first = np.unique(g, return_index=True)  # only the groups that occur
                cuts = [*first.tolist(), len(g)]
                rows = [
                    (x, chunk, (k[u:v] >> np.uint64(32)).astype("<u4").tobytes(), np.packbits(many[u:v]).tobytes())
                    for x, u, v in zip(own.tolist(), cuts, cuts[1:])
                ]
                if rows:
                    yield from _rows("group chunk keys many", [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows).to_batches()

    return chunks.select("chunk", "leads", "lens", "blob").mapInArrow(run, "group long, chunk long, keys binary, many binary")


def _answer(asked: DataFrame, hot: int) -> DataFrame:
    """(chunk, group, shared, common): bits for the keys as they were asked."""

    def run(t: pa.Table) -> pa.Table:
        group, chunk = t.column("group").to_pylist(), t.column("chunk").to_pylist()
        keys = [np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(t.column("many").to_pylist(), keys)]
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        s = whole[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(first, len(s)))
        multi = np.maximum.reduceat(np.concatenate(many)[order], first) > 0
        shared, common = np.zeros(len(s), bool), np.zeros(len(s), bool)
        shared[order] = np.repeat((n > 1) | multi, n)
        common[order] = np.repeat(n > hot, n)
        rows, at = [], 0
        for g, c, k in zip(group, chunk, keys):
            u, at = at, at + len(k)
            if shared[u:at].any():
                rows.append((c, g, np.packbits(shared[u:at]).tobytes(), np.packbits(common[u:at]).tobytes()))
        return _rows("chunk group shared common", [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)

    return asked.groupBy("group").applyInArrow(run, "chunk long, group long, shared binary, common binary")


SEGMENT = np.dtype([("lead", "<i8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1")])
RUN = np.dtype([("doc", "<u4"), ("a", "<u4"), ("b", "<u4")])


def _segments(chunk: int, leads: np.ndarray, lens: np.ndarray, data: np.ndarray, bits: dict[int, tuple[bytes, bytes]], groups: int) -> list[tuple]:
    """(group, chunk, head, bytes, runs) rows of a chunk: its segments by group, and the runs
    that are repeated within the chunk itself."""
    s, n, keys = anchors(data, lens)
    ends = np.cumsum(lens)
    doc = np.searchsorted(ends, s, "right")
    k, _ = _keys(keys, doc)
    g = (k % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    asked = np.fromiter(bits, np.int64, len(bits))
    low, high = (np.searchsorted(g[order], asked, side).tolist() for side in ("left", "right"))
    shared, common = np.zeros(len(k), bool), np.zeros(len(k), bool)
    for (a, b), u, v in zip(bits.values(), low, high):
        own = order[u:v]
        shared[own] = np.unpackbits(np.frombuffer(a, np.uint8), count=len(own))
        common[own] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(own))
    at = np.searchsorted(k, keys)
    keep = shared[at]
    begin, n, key, d, single = s[keep], n[keep], keys[keep], doc[keep], common[at][keep]
    if not len(begin):
        return []
    if single.any():  # windows of very common anchors go one by one
        m = np.where(single, n, 1)
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        begin, key, d, single = np.repeat(begin, m) + nth, np.repeat(key, m), np.repeat(d, m), np.repeat(single, m)
        n = np.where(single, 1, np.repeat(n, m))
    base = ends[d] - lens[d]
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    sent: dict[int, list[tuple]] = {}
    out: dict[int, list[bytes]] = {}
    runs = []
    lead = leads[d].tolist()
    rank = np.lexsort((begin, leads[d]))
    cells = list(zip(begin.tolist(), n.tolist(), d.tolist(), (begin - base).tolist(), key.tolist(), single.tolist()))
    for i in rank.tolist():  # by lead, so the first of equal segments has the smallest
        u, m, dd, rel, kk, alone = cells[i]
        text = raw[u : u + m + WIDTH - 1]
        was = seen.setdefault(text, lead[i])
        if was < lead[i]:
            runs.append((dd, rel, rel + m + WIDTH - 1))
            continue
        q = (int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") if alone else kk) % groups
        sent.setdefault(q, []).append((lead[i], dd, rel, m))
        out.setdefault(q, []).append(text)
    rows = [(q, chunk, np.array(x, SEGMENT).tobytes(), b"".join(out[q]), b"") for q, x in sent.items()]
    if runs:
        rows.append((chunk % groups, chunk, b"", b"", np.array(runs, RUN).tobytes()))
    return rows


def _send(chunks: DataFrame, answers: DataFrame, groups: int) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        bits = dict(zip(right.column("group").to_pylist(), zip(right.column("shared").to_pylist(), right.column("common").to_pylist())))
        for r in left.to_pylist() if bits else []:
            leads, lens, data = _open(r["leads"], r["lens"], r["blob"])
            rows += _segments(r["chunk"], leads, lens, data, bits, groups)
        return _rows("group chunk head bytes runs", kinds, rows)

    left = chunks.select("chunk", "leads", "lens", "blob").groupBy("chunk")
    right = answers.withColumnRenamed("chunk", "of").groupBy("of")
    return left.cogroup(right).applyInArrow(run, "group long, chunk long, head binary, bytes binary, runs binary")


def repeated(lead: np.ndarray, n: np.ndarray, text: bytes) -> np.ndarray:
    """For segments of ``n`` windows each, joined in ``text``: a bit for each window that also
    starts in a segment of a smaller lead."""
    size = n.astype(np.int64) + WIDTH - 1
    ends = np.cumsum(size)
    index: dict[bytes, int] = {}
    same = np.fromiter(
        (index.setdefault(text[a:b], len(index)) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(n)
    )
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, same, lead)
    kinds = list(index)
    t = np.frombuffer(b"".join(kinds), np.uint8)
    lens = np.fromiter(map(len, kinds), np.int64, len(kinds))
    windows = lens - WIDTH + 1
    seg = np.repeat(np.arange(len(kinds)), windows)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(lens) - lens)[seg] + nth
    sa = sort_suffixes(t, starts, WIDTH)
    fresh = common_prefixes(t, sa, WIDTH) < WIDTH
    if len(fresh):
        fresh[0] = True
    of = np.searchsorted(starts, sa)
    low = np.minimum.reduceat(least[seg[of]], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    hit = of[low < least[seg[of]]]
    mask = np.zeros(len(kinds), np.int64)
    np.bitwise_or.at(mask, seg[hit], np.int64(1) << nth[hit])
    return np.where(lead > least[same], (np.int64(1) << n.astype(np.int64)) - 1, mask[same])


def _runs(mask: int) -> list[tuple[int, int]]:
    """First and last set bits of each run of set bits."""
    out, i = [], 0
    while mask >> i:
        if mask >> i & 1:
            j = i
            while mask >> (j + 1) & 1:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def _judge(sent: DataFrame) -> DataFrame:
    """(chunk, runs) of removed bytes."""

    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_pylist()
        rows = [(c, r) for c, r in zip(chunk, t.column("runs").to_pylist()) if r]
        heads = [np.frombuffer(h, SEGMENT) for h in t.column("head").to_pylist()]
        whole = np.concatenate(heads)
        if len(whole):
            masks = repeated(whole["lead"], whole["n"], b"".join(t.column("bytes").to_pylist()))
            at = 0
            for c, h in zip(chunk, heads):
                m = masks[at : at + len(h)].tolist()
                at += len(h)
                got = [(d, a + i, a + j + WIDTH) for x, d, a in zip(m, h["doc"].tolist(), h["at"].tolist()) if x for i, j in _runs(x)]
                if got:
                    rows.append((c, np.array(got, RUN).tobytes()))
        return _rows("chunk runs", [pa.int64(), pa.binary()], rows)

    return sent.groupBy("group").applyInArrow(run, "chunk long, runs binary")


def _cut(chunks: DataFrame, runs: DataFrame, texts: bool) -> DataFrame:
    """(sha, lead, n_removed, n_spans, kept, left) of every text that loses bytes; left is null without ``texts``."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if right.num_rows:
            r = np.concatenate([np.frombuffer(x, RUN) for x in right.column("runs").to_pylist()])
            r = r[np.lexsort((r["a"], r["doc"]))]
            for c in left.to_pylist():
                leads, lens, _ = _open(c["leads"], c["lens"], b"")
                starts = np.cumsum(lens) - lens
                docs, first = np.unique(r["doc"], return_index=True)
                for d, own in zip(docs.tolist(), np.split(r, first[1:])):
                    a, b = own["a"].astype(np.int64), np.maximum.accumulate(own["b"].astype(np.int64))
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    u = int(starts[d])
                    text = c["blob"][u : u + int(lens[d])]
                    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                    rows.append((c["shas"][32 * d : 32 * d + 32], int(leads[d]), int((b - a).sum()), len(a), hashlib.sha256(kept).digest(), kept.decode("utf-8", "ignore").encode() if texts else None))
        return _rows("sha lead n_removed n_spans kept left", kinds, rows)

    return (
        chunks.groupBy("chunk")
        .cogroup(runs.withColumnRenamed("chunk", "of").groupBy("of"))
        .applyInArrow(run, "sha binary, lead long, n_removed long, n_spans long, kept binary, left binary")
    )


def _prepared(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, text, sha, more): only these, so no name of ``docs`` can clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    return docs.select(key.alias("key"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"), *more)


def cut_texts(docs: DataFrame, hot: int = HOT, texts: bool = True) -> DataFrame:
    """(sha, lead, n_removed, n_spans, kept, left) of each different text that loses bytes in
    its first document; ``kept`` is the digest of the remaining bytes, ``left`` those of them
    that form whole characters, if ``texts`` are wanted."""
    spark = docs.sparkSession
    reps = _prepared(docs).groupBy("sha").agg(F.min("key").alias("lead"), F.first("text").alias("text"))
    chunks = stage(_pack(reps.select("lead", "sha", "text")), "chunks")
    total = chunks.select(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("n")).first()["n"]
    groups = max(n_partitions(spark), total // GROUP_BYTES)
    answers = stage(_answer(_ask(chunks, groups), hot), "anchors")
    runs = stage(_judge(_send(chunks, answers, groups)), "runs")
    unstage(answers)
    out = stage(_cut(chunks, runs, texts), "cut")
    for done in (chunks, runs):
        unstage(done)
    return out


def _named(rows: DataFrame, cut: DataFrame, values: list[str], total: int) -> DataFrame:
    """``rows`` (key, sha, ...) with the first key of their text and ``values`` of ``cut``."""
    lead = rows.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    known = lead.join(cut.select("sha", *values), "sha", "left")
    return join_spread(rows, known, ["sha"], ["first", *values], total, ["key"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null texts are empty. A null doc_id counts as smaller than all others; rows of equal
    doc_id don't remove each other's bytes; repeated rows stay repeated. Texts below 50 bytes
    stay whole. Other columns are ignored. An empty table gives no rows.
    """
    rows = stage(_prepared(docs, "doc_id").select("doc_id", "key", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "shas")
    j = _named(rows, cut_texts(docs, hot, False), ["n_removed", "n_spans", "kept"], rows.count())
    copy = (F.col("key") > F.col("first")) & (F.col("n_bytes") >= WIDTH)
    return j.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha256"),
    )


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts, and n_chars brought up to date.

    Cuts go by bytes; what is left of a character that is cut in two goes as well. A later
    copy of a whole text keeps its row, with an empty text. Null texts stay null; a null doc_id
    counts as smaller than all others; repeated rows stay repeated; columns of any other name
    come back as they were; an empty table gives no rows.
    """
    cut = cut_texts(docs)
    rows = _prepared(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    j = _named(rows.select("key", "sha", "row"), cut, ["left"], docs.count())
    own = F.col("row")["text"]
    copy = (F.col("key") > F.col("first")) & (F.octet_length(own) >= WIDTH)
    text = F.when(copy, F.lit("")).otherwise(F.coalesce(F.col("left").cast("string"), own.cast("string")))
    j = j.select("row", text.cast(docs.schema["text"].dataType).alias("text"))
    back = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return j.select(*(back.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
