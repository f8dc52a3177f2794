"""Candidate pairs as a stream: each arriving list file is exploded as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators.blocking import explode_pairs


def stream_candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (s1, cand) pairs of the candidate files that appear in ``folder``."""
    schema = "source1_entity_id string, candidate_entity_ids string"
    d = spark.readStream.schema(schema).options(sep="\t", header=True).csv(folder)
    return explode_pairs(d, "candidate_entity_ids")
