"""The whole resolution: scan, normalise, block, score, match, write, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.normalize import normalize
from linkloom.operators import blocking, evaluation, features, training
from linkloom.session import spread, stage, unstage
from linkloom.sources import synthetic, tsv

from . import checking


def predict_matches(candidates: DataFrame, entities: DataFrame, trained: dict, use_mock: bool = False) -> DataFrame:
    """(s1, ids): candidates at the model's threshold or above; pairs that lack a record don't match."""
    pairs = blocking.explode_pairs(candidates, "candidate_entity_ids").distinct()
    return training.as_lists(training.predict_pairs(features.extract_features(pairs, entities, use_mock), trained))


def train_synthetic(spark: SparkSession, **settings) -> dict:
    return training.train_model(synthetic.feature_rows(spark), n_folds=3, **settings)


def build_training_set(
    candidates: DataFrame, entities: DataFrame, truth: DataFrame, ratio: int = 5, max_pairs: int | None = None, use_mock: bool = False
) -> DataFrame:
    """(s1, cand, label, FEATURES): all positives and sampled negatives of each s1.

    Negatives are sampled before pairs that lack a record are dropped; ``max_pairs`` counts what is left.
    """
    pairs = blocking.explode_pairs(candidates, "candidate_entity_ids").distinct()
    known = truth.select("s1", F.explode("ids").alias("cand"))
    sampled = training.sample_negatives(training.label_pairs(pairs, known), ratio)
    joined = features.join_records(sampled, entities)
    return features.feature_function(use_mock)(training.cap_pairs(joined, max_pairs))


def normalized_sources(spark: SparkSession, data_dir: str) -> list[DataFrame]:
    """Sources 1 to 3, each scanned and normalised once and written to the shared folder."""
    paths = [tsv.find_source(spark, data_dir, k, ("test_", "train_")) for k in (1, 2, 3)]
    return [stage(normalize(spread(tsv.read_tsv(spark, p))), f"source{k}") for k, p in enumerate(paths, 1)]


def run_pipeline(
    spark: SparkSession, data_dir: str, output_dir: str, model_path: str | None = None, top_k: int = 30, check: bool = True,
    single_file: bool = False, **settings,
) -> dict:
    """Resolve the sources in ``data_dir``; returns statistics and, if asked for, the validator's report."""
    sources = normalized_sources(spark, data_dir)
    found = stage(blocking.generate_candidate_pairs(*sources, top_k=top_k), "candidates")
    tsv.write_tsv(found, f"{output_dir}/candidate_pairs.tsv", single_file=single_file)
    if model_path and tsv.exists(spark, model_path):
        trained = training.load_model(spark, model_path)
    else:
        trained = train_synthetic(spark, **settings)
        if model_path:
            training.save_model(spark, trained, model_path)
    records = None
    for k, s in enumerate(sources):
        s = s.withColumn("ord", F.struct(F.lit(k).alias("src"), "ord"))
        records = s if records is None else records.unionByName(s)
    matched = stage(evaluation.assemble_matches(found, predict_matches(found, records, trained)), "matched")
    tsv.write_tsv(matched, f"{output_dir}/matching_results.tsv", single_file=single_file)
    out = {"stats": evaluation.match_stats(matched).first().asDict()}
    for done in (*sources, found, matched):
        unstage(done)
    if check:
        out["report"] = checking.validate(spark, f"{output_dir}/matching_results.tsv", f"{output_dir}/candidate_pairs.tsv", data_dir)
    return out
