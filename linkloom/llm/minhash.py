"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Shingles of five words (all words, if fewer) are hashed once. The low 7 bits of a hash choose
one of 128 bins; a bin keeps its smallest hash. An empty bin borrows from the first non-empty
one in its own random probing order (optimal densification); the order of bin k is
k, k+t, k+2t, ... modulo 128 with an odd step t drawn for k, so the first non-empty bin is
found without probing, by inverting the order. Of each bin's value the low 8 bits are stored.
Likeness is the share of equal bins, corrected for the 1/256 of unlike bins that agree.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, n_partitions

BINS, BITS, WIDTH = 128, 8, 5


def inverse_steps() -> list[int]:
    """For each bin, the inverse modulo BINS of its odd probing step."""
    return [pow(xxhash.xxh64_intdigest(str(k), 7) % BINS | 1, -1, BINS) for k in range(BINS)]


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<tinyint> of BINS stored values, null where the text has no word."""
    seq = lambda n: F.sequence(F.lit(0), n)
    t = df.withColumn(
        "_w",
        F.transform(
            F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"{SPACE}+"), lambda x: x != ""),
            lambda x: F.xxhash64(x),
        ),
    )
    shingle = F.transform(
        seq(F.size("_w") - WIDTH), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(WIDTH)))
    )
    hashes = (
        F.when(F.size("_w") >= WIDTH, shingle)
        .when(F.size("_w") > 0, F.array(F.xxhash64("_w")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    key = lambda h: F.shiftleft(h.bitwiseAND(BINS - 1), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    bin_of = lambda x: F.shiftright(x, 56)
    t = t.withColumn("_s", F.sort_array(F.transform(hashes, key))).drop("_w")
    t = t.withColumn(
        "_m", F.filter("_s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("_s", i - 1))))
    ).drop("_s")
    t = t.withColumn("_b", F.transform("_m", bin_of))
    inv = F.array(*(F.lit(x) for x in inverse_steps()))
    low = (1 << BITS) - 1

    def value(k: Column) -> Column:
        own = F.array_position("_b", k.cast("long"))
        borrowed = F.array_min(
            F.transform(
                "_m",
                lambda x: F.shiftleft(((bin_of(x) - k) * F.get(inv, k)).bitwiseAND(BINS - 1), BITS).bitwiseOR(
                    x.bitwiseAND(low)
                ),
            )
        ).bitwiseAND(low)
        got = F.when(own > 0, F.get("_m", own.cast("int") - 1).bitwiseAND(low)).otherwise(borrowed)
        return (got - (1 << (BITS - 1))).cast("tinyint")

    bins = F.transform(seq(F.lit(BINS - 1)), value)
    return t.withColumn(out, F.when(F.size("_m") > 0, bins)).drop("_m", "_b")


def packed(bins: Column) -> Column:
    """Hexadecimal digits of the stored bits; all zero for a text without words."""
    shown = F.array_join(
        F.transform(bins, lambda v: F.lpad(F.hex(v.cast("int") + (1 << (BITS - 1))), 2, "0")), ""
    )
    return F.lower(F.coalesce(shown, F.lit("0" * (BINS * BITS // 4))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles; two texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    est = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(est)


def with_next(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, str]:
    """Deal rows so that a window gives each row the next one by ``key``; after the last, the first.

    Returns the dealt rows and the name of the struct (range, guest). Ranges of the key are cut at ``parts`` approximate
    quantiles, which are keys of rows; the rows at a cut go to the range before it as well,
    marked as guests, so that no range is larger than its share and no join is needed.
    """
    probes = [i / parts for i in range(parts)]
    cuts = df.agg(F.percentile_approx(key, probes, 10_000).alias("q"), F.min(key).alias("a")).first()
    bounds = sorted({*(cuts["q"] or []), *([cuts["a"]] if cuts["a"] is not None else [])})
    lit = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array(F.lit(0).cast("long"))
    range_ = F.size(F.filter(lit, lambda b: b <= F.col(key)))
    before = F.when(range_ == 1, F.lit(max(1, len(bounds)))).otherwise(range_ - 1)
    homes = F.when(
        F.array_contains(lit, F.col(key)),
        F.array(
            F.struct(range_.alias("range"), F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest"))
        ),
    ).otherwise(F.array(F.struct(range_.alias("range"), F.lit(0).alias("guest"))))
    return df.withColumn("_home", F.explode(homes)), "_home"


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text and its likeness to that and to the next text.

    The edited text is the text with its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's. Documents go by (doc_id, text), a null doc_id first;
    repeated rows are documents of their own; null texts are empty; other columns are ignored;
    an empty table gives no rows; a single document is its own next.
    """
    from pyspark.sql import Window

    parts = n_partitions(docs.sparkSession)
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"),
    )
    dealt, home = with_next(with_bins(d, "text", "fp"), "_key", parts)
    flat = dealt.select("doc_id", "text", "fp", "_key", f"{home}.*")
    w = Window.partitionBy("range").orderBy("guest", "_key", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    seen = (
        flat.withColumn("next", F.lead(F.struct("text", "fp")).over(w))
        .filter("guest = 0")
        .select(
            "doc_id",
            "fp",
            F.length("text").cast("long").alias("n_chars"),
            F.col("next.fp").alias("next_fp"),
            F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)).alias("edit"),
        )
    )
    both = with_bins(seen, "edit", "edit_fp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edit", 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edit_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edit_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
