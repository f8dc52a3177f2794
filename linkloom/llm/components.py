"""Connected components of a link table: local forests first, then alternating star contraction.

Links that are few enough after the first forests are one more forest, and need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import ship

from .common import gathered, join_spread, stage, unstage

#: Links that are joined to a local forest at once.
LINKS = 1 << 20
#: Links that are worth a task and a file of their own in a round; fewer tasks write them, never more.
ROWS = 1 << 11
#: Links that one task joins to the last forest: 4 MB of ids. More go through rounds.
TOGETHER = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of some links, without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    lead = np.arange(len(nodes))
    while True:  # hook the greater of two leads to the lesser, then let all point to their leads' leads
        x, y = lead[u], lead[v]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(lead, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (far := lead[lead]).tobytes() != lead.tobytes():
            lead = far
    own = np.flatnonzero(lead != np.arange(len(nodes)))
    return nodes[own], nodes[lead[own]]


def _forests(edges: DataFrame) -> DataFrame:
    """Links with the same components, at most one for each node and LINKS links of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, LINKS):
            x, y = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    ship(edges.sparkSession)
    return edges.mapInArrow(run, "a long, b long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    sym = _both(edges)
    low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    met = join_spread(sym, low, ["a"], ["m"], 2 * total, ["b"])
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    met = join_spread(down, low, ["a"], ["m"], total, ["b"])
    leaves = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return leaves.union(low.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, together: int = TOGETHER) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Each partition's links shrink to a forest. If at most ``together`` links are left, one task joins
    them to the forest of all; else large-star and small-star steps in turn until the edges stay the same; every round is
    written to the shared folder, in files in proportion to its links. A group costs joins with one
    row for each of its nodes, and the rows of a node with many links are dealt to many tasks. Nodes
    without links don't appear. Null ends and loops are ignored. The result reads a staged table,
    which ``unstage`` of the result deletes.
    """
    own = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    edges = stage(_forests(own).distinct(), "cc")
    # order-free digest of the edge set: its size and two independent 64-bit sums
    digest = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", F.lit(1), "a")).alias("y")]
    was = edges.agg(*digest).first()
    for _ in range(max_rounds):
        if not was["n"]:
            break
        if was["n"] <= min(together, LINKS):  # the forest of all links is the result
            whole = stage(_forests(edges.coalesce(1)), "cc")
            unstage(edges)
            edges = whole
            break
        files = -(-was["n"] // ROWS)
        large = stage(_large_star(edges, was["n"]).distinct().coalesce(files), "cc")
        new = stage(_small_star(large, was["n"]).distinct().coalesce(files), "cc")
        for done in (large, edges):
            unstage(done)
        edges, now = new, new.agg(*digest).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._linkloom_path = edges._linkloom_path
    return out
