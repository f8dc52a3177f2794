"""SimHash near-duplicate groups by anchor-point covering.

Two 23-bit blocks of a 64-bit fingerprint each have the perfect binary Golay code (covering
radius 3) as anchors. Every fingerprint's home is the pair of codewords nearest to its blocks.
A fingerprint within ``threshold`` bits of it lies within radius plus threshold of that home,
the threshold shared out between the blocks; so each fingerprint visits all anchor pairs
within that reach and is compared with the homes there. No pair within the threshold is
missed, and the 2^24 anchor pairs keep the comparisons of unlike texts few.

Only distinct fingerprints are dealt to anchors, so exact copies cost one row each, whatever
the group's size; links between distinct fingerprints of a group are bounded by the 2,080
neighbours that a fingerprint can have at two bits.

``keep``, the filter of a pipeline, also catches texts whose five-word shingles are alike at
0.8 or more, by a complete prefix filter. All shingles have one order, by how often their cell
of a count table was met and then by hash; two alike texts share one of the first fifth of
their shingles. Texts that share one are first judged against two of each bucket and size
class, then all pairs that these links leave in different groups are judged, so large groups
of copies stay linear and no pair is left out. A pair whose sketches share far less than alike
texts' do is dropped; all others are judged by their whole sets of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, map_batches, ship, stage, text_bytes, unstage
from .components import connected_components

RADIUS, BLOCK, CHECKS = 3, 23, 11
#: Least shingle hashes of a sketch. Of two sketches of 64 from sets alike at 0.8, 0.87 is shared on
#: average, with a deviation of 0.035; pairs that share below 0.6 aren't judged by whole sets.
SKETCH, SHARED = 64, 0.6
#: Cells of the count table that orders shingles, and slices in which it is summed.
CELLS, SLICES = 1 << 19, 64
#: Members of a bucket that one salt takes.
SALTED = 500
#: Slack of comparisons with products of ``least``.
EPS = 1e-9
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011


def fingerprint(data: bytes, width: int = 3) -> int:
    """SimHash of UTF-8 bytes: A-Z lowered, shingles of ``width`` words, XXH64 with seed 42."""
    w = data.lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(w) <= width:
        return h64(b" ".join(w), 42)
    ones, n = np.zeros(64, np.int64), len(w) - width + 1
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = w[at : at + (1 << 15) + width - 1]
        h = np.array([h64(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(width)))], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; null texts count as empty, other columns are ignored."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, width) for x in text_bytes(b.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(d, run, "doc_id long, fp long")


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    v = v.astype(np.int64).copy()
    for i in range(BLOCK - 1, CHECKS - 1, -1):
        v ^= np.where((v >> i) & 1, GOLAY << (i - CHECKS), 0)
    return v


@cache
def coset_table(extra: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes, the error words of weight up to RADIUS + ``extra``.

    Returns the words and how far each exceeds the radius; rows are padded with an excess of 99.
    """
    words = np.array(
        [sum(1 << i for i in c) for k in range(RADIUS + extra + 1) for c in combinations(range(BLOCK), k)],
        np.int64,
    )
    weight = np.bitwise_count(words).astype(np.int64)
    syn = syndrome(words)
    order = np.lexsort((weight, syn))
    words, weight, syn = words[order], weight[order], syn[order]
    first = np.searchsorted(syn, np.arange(1 << CHECKS))
    slot = np.arange(len(syn)) - first[syn]
    e = np.zeros((1 << CHECKS, slot.max() + 1), np.int64)
    x = np.full(e.shape, 99, np.int64)
    e[syn, slot], x[syn, slot] = words, np.maximum(weight - RADIUS, 0)
    return e, x


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of all anchor pairs that each fingerprint is dealt to."""
    e, x = coset_table(threshold)
    fp = fp.view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    v1, v2 = (fp & mask).astype(np.int64), ((fp >> np.uint64(BLOCK)) & mask).astype(np.int64)
    s1, s2 = syndrome(v1), syndrome(v2)
    rows, i, j = np.nonzero(x[s1][:, :, None] + x[s2][:, None, :] <= threshold)
    anchor = ((v1[rows] ^ e[s1[rows], i]) << BLOCK) | (v2[rows] ^ e[s2[rows], j])
    return rows, anchor, (i == 0) & (j == 0)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, a below b, at ``threshold`` bits or fewer."""

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(fp), 2000):
            rows, anchor, home = anchors(fp[at : at + 2000], threshold)
            out.append((fp[at : at + 2000][rows], anchor, home))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["fp", "anchor", "home"])

    dealt = map_batches(fps.select("fp"), deal, "fp long, anchor long, home boolean")
    homes = dealt.filter("home").select(F.col("fp").alias("a"), "anchor").hint("shuffle_hash")
    return (
        dealt.select(F.col("fp").alias("b"), "anchor")
        .join(homes, "anchor")
        .filter("a < b")
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
        .select("a", "b")
    )


def groups(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    ``threshold`` bits. Repeated rows come out repeated; null texts are empty texts, with
    fingerprint 0; rows with a null doc_id keep null or their group's smallest id. An empty
    table gives an empty result.
    """
    fps = stage(fingerprints(docs, width), "fp")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")), "nodes")
    found = stage(links(nodes, threshold), "links")
    ends = (
        found.join(nodes.select(F.col("fp").alias("a"), F.col("root").alias("ra")), "a")
        .join(nodes.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    comp = connected_components(ends)
    unstage(found)
    named = nodes.join(comp, nodes.root == comp.node, "left").select("fp", "n", F.coalesce("component", "root").alias("component_id"))
    return join_spread(fps, named, ["fp"], ["component_id"], fps.count(), ["doc_id"])


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit words scrambled; different salts give independent words."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """XXH64 with seed 7 of the words of UTF-8 bytes, A-Z lowered."""
    return np.array([xxhash.xxh64_intdigest(t, 7) for t in data.lower().split()], np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The different 64-bit hashes of shingles of ``width`` words (all words, if fewer), sorted."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mixed(h ^ words[i : i + n], 2 * i + 1)
    return np.unique(h)


def sketch(members: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` least different 32-bit halves of a sorted set of hashes: all, if no more."""
    return np.unique((members[: SKETCH + 8] >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many hashes two packed sketches have in common, as a share of the larger one's, for many pairs."""

    def padded(side: list[bytes], base: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, side), np.int64, len(side)) // 4
        out = np.broadcast_to(np.arange(base, base + SKETCH, dtype=np.uint64), (len(side), SKETCH)).copy()
        out[np.arange(SKETCH) < size[:, None]] = np.frombuffer(b"".join(side), np.uint32)
        return out, size

    (x, n), (y, m) = padded(a, 1 << 32), padded(b, 1 << 33)  # what fills short ones equals nothing
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(1) / np.maximum(1, np.maximum(n, m))


def alike_sets(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets of hashes is ``least`` or more."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= least * (len(a) + len(b) - same) - EPS


def cell_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall to each of ``CELLS`` cells.

    The counts only order shingles, the rare ones first; whatever they are, no pair is lost.
    """
    size = CELLS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for b in batches:
            sets = [shingle_set(word_hashes(x), shingle) for x in text_bytes(b.column(0))]
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
        if total.any():
            parts = [total[i * size : (i + 1) * size].tobytes() for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in t["counts"].to_pylist():
            total += np.frombuffer(x, np.int32)
        return pa.table({"slice": t["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    ship(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slice int, counts binary")
    out = np.zeros((SLICES, size), np.int64)
    for r in counted.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def prefix_size(n: int, share: float) -> int:
    """How many of the first of ``n`` ordered members hold one of any ``share`` of them."""
    return n - math.ceil(share * n - EPS) + 1 if n else 0


def traits(docs: DataFrame, width: int, shingle: int, least: float) -> DataFrame:
    """(doc_id, fp, text_key, n, first, sketch) of each row: n different shingles, the first of them
    in order packed as binary, as many as a text alike at ``least`` must share one of, and the
    least hashes of all."""
    sent = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, shingle))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps, keys, sizes, first, least_ = [], [], [], [], []
        for x in text_bytes(b.column(1)):
            h = shingle_set(word_hashes(x), shingle)
            order = np.lexsort((h, sent.value[(h & np.uint64(CELLS - 1)).astype(np.int64)]))
            fps.append(fingerprint(x, width))
            keys.append(xxhash.xxh3_128_digest(b" ".join(x.lower().split())))
            sizes.append(len(h))
            first.append(h[order[: prefix_size(len(h), least)]].tobytes())
            least_.append(sketch(h).tobytes())
        cols = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(first, pa.binary()), pa.array(least_, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "text_key", "n", "first", "sketch"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(d, run, "doc_id long, fp long, text_key binary, n int, first binary, sketch binary")


def _unpacked(nodes: DataFrame) -> DataFrame:
    """(tok, root, n, at): one row for each of the first shingles of each text, with its place."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        toks = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        sizes = [len(t) for t in toks]
        at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        cols = [np.concatenate(toks), np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), at]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tok", "root", "n", "at"])

    return map_batches(nodes.select("root", "n", "first"), run, "tok long, root long, n int, at int")


def _fits(n: Column, at: Column, m: Column, to: Column, least: float) -> Column:
    """Whether texts of n and m shingles, the first common one at places ``at`` and ``to``, can be alike."""
    sizes = (n >= least * m - EPS) & (m >= least * n - EPS)
    return sizes & (F.least(n - at, m - to) >= least / (1 + least) * (n + m) - EPS)


def _indexed(n: Column, at: Column, least: float) -> Column:
    """Whether a place is among those at which the smaller of two alike texts has the first common shingle."""
    return at <= n - F.ceil(2 * least / (1 + least) * n - EPS)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of ``pairs``, staged: those whose sketches share enough. Most texts that met by chance
    in a few shingles go here, before whole sets are sent for."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = shared(b.column(2).to_pylist(), b.column(3).to_pylist()) >= SHARED
        return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: nodes.select(F.col("root").alias(k), F.col("sketch").alias(f"s{k}"))
    seen = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    out = stage(map_batches(seen, run, "a long, b long"), "plausible")
    unstage(pairs)
    return out


def judged(pairs: DataFrame, docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """(a, b) of ``pairs``, staged: those whose whole sets of shingles are alike at ``least`` or more."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(word_hashes(x), shingle).tobytes() for x in text_bytes(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "members"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = map_batches(d.join(ids, "doc_id", "left_semi"), run, "id long, members binary").distinct()
    sets = stage(sets, "sets")

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (b.column(i).to_pylist() for i in (2, 3))
        ok = [alike_sets(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) for p, q in zip(x, y)]
        return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: sets.select(F.col("id").alias(k), F.col("members").alias(f"s{k}"))
    seen = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    found = stage(map_batches(seen, judge, "a long, b long"), "alike")
    unstage(sets)
    return found


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def star_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b): each member of a bucket and size class with the least and the greatest there."""
    size_class = F.floor(F.log("n") / math.log(1 / least)).cast("int")
    t = members.withColumn("class", size_class)
    one = F.struct("root", "n", "at")
    hubs = t.groupBy("tok", "class").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low.root < high.root")
    met = t.join(hubs, ["tok", "class"]).select("root", "n", "at", F.explode(F.array("low", "high")).alias("h"))
    met = met.filter((F.col("root") != F.col("h.root")) & _fits(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at"), least))
    return met.select(*_ordered(F.col("root"), F.col("h.root"))).distinct()


def cross_pairs(members: DataFrame, comp: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of a bucket that can be alike and are of different groups of ``comp``.

    One of each such pair is outside the bucket's largest group; buckets are salted by size.
    """
    named = members.join(comp, members.root == comp.node, "left").withColumn("comp", F.coalesce("component", "root"))
    named = stage(named.select("tok", "root", "n", "at", "comp"), "named")
    sums = named.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    mixed_ = sums.groupBy("tok").agg(F.max_by("comp", "c").alias("top"), F.sum("c").alias("m"), F.count("*").alias("k")).filter("k > 1")
    t = named.join(mixed_.select("tok", "top", F.ceil(F.col("m") / SALTED).cast("int").alias("salts")), "tok")
    x = t.filter("comp <> top").withColumn("salt", F.pmod(F.xxhash64("root"), F.col("salts")).cast("int")).alias("x")
    y = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    c = F.col
    once = (c("y.comp") == c("y.top")) | (c("x.root") < c("y.root"))
    first = (
        F.when(c("x.n") < c("y.n"), _indexed(c("x.n"), c("x.at"), least))
        .when(c("x.n") > c("y.n"), _indexed(c("y.n"), c("y.at"), least))
        .otherwise(_indexed(c("x.n"), c("x.at"), least) & _indexed(c("y.n"), c("y.at"), least))
    )
    fits = _fits(c("x.n"), c("x.at"), c("y.n"), c("y.at"), least)
    on = (c("x.tok") == c("y.tok")) & (c("x.salt") == c("y.salt")) & (c("x.comp") != c("y.comp")) & once & first & fits
    pairs = x.join(y, on).select(*_ordered(c("x.root"), c("y.root"))).distinct()
    pairs._linkloom_path = named._linkloom_path  # unstaging the pairs deletes what they are read from
    return pairs


def alike(nodes: DataFrame, docs: DataFrame, known: DataFrame, least: float, shingle: int) -> DataFrame:
    """(node, component) over the links ``known`` (a, b) and all texts of ``nodes`` (root, n, first)
    whose shingles are alike at ``least`` or more."""
    toks = _unpacked(nodes).repartition("tok")  # one shuffle serves the counts and the join with them
    use = F.max(_indexed(F.col("n"), F.col("at"), least)).alias("use")
    shared = toks.groupBy("tok").agg(F.min("root").alias("low"), F.max("root").alias("high"), use).filter("use and low < high")
    members = stage(toks.join(shared.select("tok"), "tok"), "members")
    pairs = plausible(star_pairs(members, least), nodes)
    near = judged(pairs, docs, least, shingle)
    comp = connected_components(known.union(near))
    left = plausible(cross_pairs(members, comp, least), nodes)
    more = judged(left, docs, least, shingle)
    for done in (members, pairs, near, left):
        unstage(done)
    out = connected_components(comp.select("node", "component").union(more).toDF("a", "b"))
    for done in (comp, more):
        unstage(done)
    return out


def keep(docs: DataFrame, threshold: int = 2, width: int = 3, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest doc_id, with all its columns.

    Links are those of ``groups`` and, beside them, all texts alike at ``least`` or more by their
    shingles of ``shingle`` words. Rows with a null doc_id stay, as nothing tells them apart;
    of rows that share a doc_id one stays; null and blank texts are one group; an empty table
    gives no rows.
    """
    real = docs.filter("doc_id is not null")
    own = stage(traits(real, width, shingle, least), "traits")
    nodes = own.groupBy("text_key").agg(*(F.min(x).alias(y) for x, y in (("doc_id", "root"), ("fp", "fp"), ("n", "n"), ("first", "first"), ("sketch", "sketch"))))
    nodes = stage(nodes, "texts")
    unstage(own)
    prints = stage(nodes.groupBy("fp").agg(F.min("root").alias("low"), F.count("*").alias("n")), "prints")
    at = lambda k: prints.select(F.col("fp").alias(k), F.col("low").alias(f"r{k}"))
    close = links(prints, threshold).join(at("a"), "a").join(at("b"), "b").select("ra", "rb")
    same = nodes.join(prints.filter("n > 1").select("fp", "low"), "fp").select("root", "low")
    comp = alike(nodes, real, close.union(same).toDF("a", "b"), least, shingle)
    gone = comp.filter("node <> component").select(F.col("node").alias("root"))
    first = stage(nodes.select("root").join(gone, "root", "left_anti").select(F.col("root").alias("doc_id")).distinct(), "first")
    for done in (nodes, prints, comp):
        unstage(done)
    named = real.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
