"""The corpus pipeline: quality, near-duplicates, repeats, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, decontaminate, quality, repeats, simhash
from linkloom.llm.common import stage, table, unstage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts count as empty and are judged like others, as are rows with a null doc_id and
    repeated rows; without usable labels all stay; an empty table gives no rows.
    """
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Null and blank texts are one group; of rows that share a doc_id one stays; rows with a null
    doc_id all stay, as nothing tells them apart; an empty table gives no rows.
    """
    return simhash.keep(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document holds are cut out; every document keeps its row.

    Null texts stay null; a null doc_id counts as the smallest; rows of equal doc_id don't cut
    each other; an empty table gives no rows.
    """
    return repeats.dedupe(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay; items without words match nothing; rows with a
    null doc_id and repeated rows are judged each; an empty table on either side takes nothing.
    """
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of what they decode to at their offsets.

    Null and empty texts have no ids; rows with a null doc_id and repeated rows stay; an empty
    table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("benchmark decontamination", leak_stage),
    ("byte-level bpe", token_stage),
]

#: SQL can't express the classifier; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        kept = stage(fn(spark, docs, sf_dir), name.replace(" ", "-"))
        unstage(docs)  # the next stage reads only what this one kept
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
