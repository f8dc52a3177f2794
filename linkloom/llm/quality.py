"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Terms are hashed byte pairs of the text plus counts of repeated words and lines. Square roots
of counts, weighted by inverse document frequency, are projected on the leading directions of
a labelled sample. Every document gets its exact cosine with every sampled vector, block by
block; the nearest ``K`` vote with their label, weighted by a power of the similarity and by
the share of their label among all labelled rows (the sample holds both labels alike).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

#: The sample: at most so many rows of each label, those of least xxhash64(doc_id).
SAMPLE = 1500
PAIRS, EXTRA, DIMS, K, POWER, BLOCK = 2048, 4, 48, 15, 4, 512
THRESHOLD = 0.3
#: Columns of a Krylov block beyond the directions asked for, and blocks.
EXCESS, STEPS = 16, 10


def _slots() -> np.ndarray:
    code = np.arange(1 << 16, dtype=np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64)


SLOTS = _slots()


def features(text: bytes) -> np.ndarray:
    """Square roots of term counts."""
    v = np.zeros(PAIRS + EXTRA, np.float32)
    b = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(b) - 1), 1 << 20):
        x = b[at : at + (1 << 20) + 1].astype(np.int64)
        v[:PAIRS] += np.bincount(SLOTS[x[:-1] * 256 + x[1:]], minlength=PAIRS)
    words, lines = text.split(), text.split(b"\n")
    v[PAIRS:] = 4 * sum(map(eq, words, words[1:])), len(words) - len(set(words)), 10 * (len(lines) - len(set(lines))), len(words)
    return np.sqrt(v)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _to_unit(x: np.ndarray) -> None:
    """``_unit`` in place."""
    for at in range(0, len(x), BLOCK):
        x[at : at + BLOCK] = _unit(x[at : at + BLOCK])


def leading(x: np.ndarray, dims: int) -> np.ndarray:
    """The ``dims`` leading eigenvectors of ``x.T @ x``, by Rayleigh-Ritz on a block Krylov space.

    ``eigh`` of the whole matrix holds six copies of it, in double precision, in the driver.
    """
    n = x.shape[1]
    q = np.random.default_rng(0).standard_normal((n, min(n, dims + EXCESS)))
    blocks = []
    for _ in range(STEPS):
        q = np.linalg.qr(q)[0]
        blocks.append(q)
        q = x.T @ (x @ q.astype(np.float32))
    basis = np.linalg.qr(np.concatenate(blocks, axis=1))[0].astype(np.float32)
    y = x @ basis
    _, u = np.linalg.eigh(y.T @ y)
    return np.ascontiguousarray(basis @ u[:, ::-1][:, :dims])


def _model(packed: list[bytes], y: np.ndarray, counts: dict[int, int]) -> dict:
    """The model of features packed as float16. The driver holds one matrix of them, changed in place."""
    x = np.empty((len(packed), PAIRS + EXTRA), np.float32)
    for i, f in enumerate(packed):
        x[i] = np.frombuffer(f, np.float16)
    _to_unit(x)
    idf = np.log1p(1 / ((x > 0).mean(0) + 0.01)).astype(np.float32)
    x *= idf
    _to_unit(x)
    mean = x.mean(0)
    x -= mean
    axes = leading(x, DIMS)
    weight = np.array([counts[k] / max(1, (y == k).sum()) for k in y], np.float32)
    return {"idf": idf, "mean": mean, "axes": axes, "z": _unit(x @ axes), "y": y.astype(np.float32), "w": weight / weight.max()}


def held_out(doc_id: str = "doc_id", rest: int = 0):
    """crc32 of the id as text, modulo 5, is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The model: a few arrays of bounded size.

    Only labelled rows that aren't held out are used, a bounded sample of them; null labels
    and labels other than 0 and 1 are ignored. Without any, every document scores 0.5.
    """
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    own = own.filter(~held_out()).distinct()
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pick = None
    for y in sorted(counts):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        pick = part if pick is None else pick.union(part)
    if pick is None:
        return {"z": np.zeros((0, DIMS), np.float32)}
    # at most 2 * SAMPLE rows of two numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id").select("doc_id", "y", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [features(x).astype(np.float16).tobytes() for x in text_bytes(b.column(2))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["doc_id", "y", "f"])

    # one row for each sampled label: of rows that share an id, the one of least features
    one = map_batches(rows, run, "doc_id long, y int, f binary").groupBy("doc_id", "y").agg(F.min("f").alias("f"))
    got = sorted(one.collect())  # at most 2 * SAMPLE rows
    if not got:
        return {"z": np.zeros((0, DIMS), np.float32)}
    return _model([r["f"] for r in got], np.array([r["y"] for r in got]), counts)


def vote(model: dict, texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1."""
    out = np.full(len(texts), 0.5)
    if not len(model["z"]):
        return out
    k = min(K, len(model["z"]))
    for at in range(0, len(texts), BLOCK):
        x = _unit(np.array([features(t) for t in texts[at : at + BLOCK]]))
        z = _unit((_unit(x * model["idf"]) - model["mean"]) @ model["axes"])
        cos = z @ model["z"].T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-3) ** POWER * model["w"][near]
        out[at : at + BLOCK] = (w * model["y"][near]).sum(1) / w.sum(1)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``.

    Null texts count as empty; empty texts get a score like others; repeated rows stay
    repeated; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SAMPLE vectors and the axes: about 2 MB

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = vote(sent.value, text_bytes(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(d, run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns.

    Null texts count as empty; empty texts are judged like others; rows with a null doc_id and
    repeated rows are judged each; an empty table gives no rows.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(vote(sent.value, text_bytes(b.column(at))) >= THRESHOLD))

    return map_batches(docs, run, docs.schema)
