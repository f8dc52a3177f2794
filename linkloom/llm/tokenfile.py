"""Token ids in canonical, length-limited Huffman code.

Ids are counted over the whole corpus; package-merge gives code lengths of at most MAX_BITS;
codes are canonical, so the lengths alone define them. A file holds the documents of a key
range in order: header, code lengths, document ids and lengths, bit offsets of independent
blocks of BLOCK ids (the checkpoints) and the bit stream. Blocks are decoded side by side by
table look-ups. Files are rows of a table in the shared folder, which any store can hold.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import ship

from .common import n_partitions, stage
from .pretoken import PieceCoder

MAGIC, MAX_BITS, BLOCK, END_ID = b"LLH1", 18, 512, 0
HEADER = struct.Struct("<4sIIQQQ")
#: Ids of a file are about this many; one longer document makes a longer file.
FILE_IDS = 1 << 20


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits; 0 for ids that never occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n <= 1:
        out[ids] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit codes of {most} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    w = counts[ids].astype(np.float64)
    leaf_flags, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([w, packages])
        order = np.argsort(both, kind="stable")
        leaf_flags.append(order < n)
        s = both[order]
        packages = s[: len(s) // 2 * 2].reshape(-1, 2).sum(1)
    lens, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lens[:leaves] += 1
        take = 2 * (take - leaves)
    out[ids] = lens
    return out


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes by (length, id), most significant bit first."""
    codes, code, was = np.zeros(len(lens), np.uint32), 0, 0
    ids = np.lexsort((np.arange(len(lens)), lens))
    for i in ids[lens[ids] > 0].tolist():
        n = int(lens[i])
        code <<= n - was
        codes[i], was = code, n
        code += 1
    return codes


def decode_table(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every window of MAX_BITS bits."""
    codes = canonical(lens)
    sym, size = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    ids = np.flatnonzero(lens)
    ids = ids[np.argsort(codes[ids].astype(np.int64) << (MAX_BITS - lens[ids].astype(np.int64)))]
    reach = 1 << (MAX_BITS - lens[ids].astype(np.int64))
    sym[: reach.sum()] = np.repeat(ids, reach)
    size[: reach.sum()] = np.repeat(lens[ids], reach)
    return sym, size


def write_file(ids: np.ndarray, docs: list[int | None], sizes: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> bytes:
    """The file image of ``ids``, which belong to ``docs`` in order, ``sizes`` to each."""
    n = lens[ids].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ids) else 0
    stream = np.zeros(total // 8 + 8, np.uint8)
    for a in range(0, len(ids), 1 << 18):
        e, k = ends[a : a + (1 << 18)], n[a : a + (1 << 18)]
        at = e - k
        base = int(at[0] >> 3)
        word = codes[ids[a : a + (1 << 18)]].astype(np.int64) << (32 - k - (at & 7))
        first = (at >> 3) - base
        part = np.zeros(int(first[-1]) + 4, np.int64)
        for j in range(4):  # the bits of different codes are disjoint, so sums are unions
            part[j : j + int(first[-1]) + 1] += np.bincount(first, (word >> (24 - 8 * j)) & 255).astype(np.int64)
        stream[base : base + len(part)] |= part.astype(np.uint8)
    marks = (ends - n)[::BLOCK].astype("<u8") if len(ids) else np.zeros(0, "<u8")
    packed = zlib.compress(lens.tobytes(), 1)
    key = np.array([x or 0 for x in docs], "<i8")
    null = np.array([x is None for x in docs], np.uint8)
    head = HEADER.pack(MAGIC, len(lens), len(packed), len(docs), len(ids), len(stream))
    return b"".join([head, packed, key.tobytes(), null.tobytes(), sizes.astype("<u8").tobytes(), marks.tobytes(), stream.tobytes()])


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def read_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and each document's token ids."""
    magic, vocab, n_packed, n_docs, n_ids, n_stream = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    packed = data[at : at + n_packed]
    at += n_packed
    key = np.frombuffer(data, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    null = np.frombuffer(data, np.uint8, n_docs, at).tolist()
    at += n_docs
    sizes = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    n_blocks = -(-n_ids // BLOCK)
    marks = np.frombuffer(data, "<u8", n_blocks, at)
    at += 8 * n_blocks
    if packed not in _tables:
        _tables.clear()
        _tables[packed] = decode_table(np.frombuffer(zlib.decompress(packed), np.uint8, vocab))
    ids = decode_blocks(np.frombuffer(data, np.uint8, n_stream, at), marks, n_ids, *_tables[packed])
    cuts = np.cumsum(sizes)[:-1] if n_docs else np.zeros(0, np.int64)
    return [None if z else k for k, z in zip(key, null)], np.split(ids, cuts) if n_docs else []


def decode_blocks(stream: np.ndarray, marks: np.ndarray, n_ids: int, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of all blocks that begin at the bit offsets ``marks``; each step decodes one id of every block."""
    out = np.zeros((len(marks), BLOCK), np.uint32)
    pos = marks.astype(np.int64)
    wide = np.zeros(len(stream), np.uint32)
    s = np.concatenate([stream, np.zeros(4, np.uint8)]).astype(np.uint32)
    wide = (s[:-4] << 24) | (s[1:-3] << 16) | (s[2:-2] << 8) | s[3:-1]
    last, mask = len(wide) - 1, np.uint32((1 << MAX_BITS) - 1)
    for step in range(min(BLOCK, n_ids)):
        w = (wide[np.minimum(pos >> 3, last)] >> (32 - MAX_BITS - (pos & 7)).astype(np.uint32)) & mask
        out[:, step] = sym[w]
        pos += size[w]
    return out.reshape(-1)[:n_ids]


@cache
def coder(path: str) -> PieceCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

    return PieceCoder(encode, most=1_000_000)


def encode_ordered(docs: DataFrame, path: str) -> DataFrame:
    """Rows of about FILE_IDS ids, in ascending doc_id order by (part, seq), with their counts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = d.repartitionByRange(n_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    schema = "part int, seq int, base long, n long, docs array<long>, sizes binary, ids binary, seen array<int>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            times = np.bincount(ids)
            seen = np.flatnonzero(times)
            times, ids = times[seen], ids.astype("<u2" if seen[-1] < 1 << 16 else "<u4")
            sizes = np.array([len(x) for x in held], "<u8")
            one = [part, seq, base, len(ids), keys, sizes.tobytes(), ids.tobytes(), seen.astype(np.int32), times]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds)], [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            texts, own = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for at in range(0, len(texts), 1024):
                for k, ids in zip(own[at : at + 1024], coder(path)(texts[at : at + 1024])):
                    keys.append(k)
                    held.append(np.append(ids, np.uint32(END_ID)))
                    size += len(ids) + 1
                    if size >= FILE_IDS:
                        yield row()
                        seq, base, keys, held, size = seq + 1, base + size, [], [], 0
        if held:
            yield row()

    ship(docs.sparkSession)
    return ordered.mapInArrow(run, schema)


def write_files(docs: DataFrame, path: str) -> DataFrame:
    """Encode ``docs`` and write token files: (part, seq, base, n, file).

    Null texts count as empty; every document ends with id 0; rows with a null doc_id come
    first and repeated rows stay repeated, ties in any order; other columns are ignored; an
    empty table gives no files. ``base``: ids before the file in its part.
    """
    spark = docs.sparkSession
    coded = stage(encode_ordered(docs, path), "ids")
    pairs = coded.select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n"))
    got = pairs.collect()  # as many rows as the vocabulary has ids
    counts = np.zeros(max([r["seen"] for r in got], default=0) + 1, np.int64)
    for r in got:
        counts[r["seen"]] = r["n"]
    lens = code_lengths(counts)
    sent = spark.sparkContext.broadcast((lens, canonical(lens)))  # two arrays of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                keys, sizes, ids = (r.column(c)[0].as_py() for c in (4, 5, 6))
                n = np.frombuffer(sizes, "<u8")
                image = write_file(np.frombuffer(ids, f"<u{len(ids) // int(n.sum())}"), keys, n, *sent.value)
                yield pa.RecordBatch.from_arrays([*r.columns[:4], pa.array([image], pa.binary())], ["part", "seq", "base", "n", "file"])

    return stage(coded.mapInArrow(run, "part int, seq int, base long, n long, file binary"), "tokens", "uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in ``files``, decoded.

    Documents with a null doc_id keep it; repeated rows stay repeated, each with its own ids;
    no files give no rows.
    """
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part, of which there are as many as shuffle partitions
    before = files.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(w), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                keys, ids = read_file(data)
                n = np.array([len(x) for x in ids], np.int64)
                crc = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], np.int64)
                cols = [pa.array([part] * len(n), pa.int32()), pa.array(keys, pa.int64()), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = files.select("part", "base", "file").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
