"""Shared helpers: table access, staging in the cluster's shared folder, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkloom.session import shared_dir, ship, spread, stage, unstage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, dealt to all cores if it is one of few files."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array, null as empty, without making str objects."""
    out = col.cast(pa.binary()) if pa.types.is_string(col.type) else col.cast(pa.large_binary())
    return [b or b"" for b in out.to_pylist()]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``rows`` rows each, for work that pays by the row count."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: White space of the word definition, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


#: A key is hot if it holds more than one in so many of all rows; so there are fewer hot keys than this.
HOT = 1000


def join_spread(big: DataFrame, small: DataFrame, on: list[str], values: list[str], total: int, by: list[str]) -> DataFrame:
    """``big`` with the columns ``values`` of ``small``, null where a key isn't there.

    ``small`` has one row for each key ``on`` and ``n``, how many rows of ``big`` have that key;
    ``total`` is at least their sum. Hot keys, fewer than HOT, are broadcast, and their rows are
    dealt by ``by``, so that no task gets all rows of a key. Neither table may have columns that
    begin with ``_j_``.
    """
    least = f"n > {total / HOT!r}"
    value = f"struct(true AS _j_found, {', '.join(f'`{v}`' for v in values)})"
    keys = lambda p: [f"`{k}` AS _j_{p}{i}" for i, k in enumerate(on)]
    same = lambda p: " AND ".join(f"`{k}` <=> _j_{p}{i}" for i, k in enumerate(on))
    far = small.filter(least).selectExpr(*keys("h"), f"{value} AS _j_h")
    near = small.filter(f"NOT ({least})").selectExpr(*keys("c"), f"{value} AS _j_c", "0 AS _j_of")
    dealt = ", ".join(f"`{c}`" for c in by)
    j = big.join(F.broadcast(far), F.expr(same("h")), "left")
    j = j.selectExpr("*", f"IF(_j_h IS NULL, 0, CAST(1 + pmod(xxhash64({dealt}), {1 << 20}) AS INT)) AS _j_salt")
    j = j.join(near, F.expr(f"{same('c')} AND _j_salt = _j_of"), "left")
    return j.selectExpr(*(f"`{c}`" for c in big.columns), *(f"coalesce(_j_h, _j_c).`{v}` AS `{v}`" for v in values))
