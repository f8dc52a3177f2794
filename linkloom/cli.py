"""Command line: preprocess, block, train, predict, run, validate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from linkloom.functions.normalize import normalize
from linkloom.operators import blocking, evaluation, training
from linkloom.plans import checking, resolution
from linkloom.session import spread, stage
from linkloom.sources import synthetic, tsv

#: Fixed value: the model's name in a model folder.
MODEL = "entity_resolution_model"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("preprocess")
    for f in ("--input-dir", "--output-dir", "--input-file", "--output-file"):
        p.add_argument(f)
    p = sub.add_parser("block")
    p.add_argument("--normalized-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--top-k", type=int, default=30)
    p.add_argument("--use-gpu", action="store_true", help="accepted and ignored")
    p.add_argument("--ground-truth")
    p = sub.add_parser("train")
    p.add_argument("--mode", choices=["train", "predict", "both", "synthetic"], default="both")
    p.add_argument("--normalized-dir", default="data/normalized_train")
    p.add_argument("--candidate-file", "--candidates", default="output/candidate_pairs.tsv")
    p.add_argument("--ground-truth", default="dataset/train/train_ground_truth.tsv")
    p.add_argument("--test-candidate-file", help="candidates to predict, if not those of --candidate-file")
    p.add_argument("--test-normalized-dir", help="records to predict, if not those of --normalized-dir")
    p.add_argument("--output", default="matching_results.tsv")
    p.add_argument("--backend", choices=sorted(training.BACKENDS), default="lightgbm")
    p.add_argument("--use-gpu", action="store_true", help="accepted and ignored")
    p.add_argument("--model-path", help="a saved model, for predict")
    p.add_argument("--model-dir", default="models", help="where a trained model is saved")
    p.add_argument("--use-mock-features", action="store_true")
    p.add_argument("--max-pairs", type=int)
    p.add_argument("--n-folds", type=int, default=5)
    p.add_argument("--neg-ratio", type=int, default=5)
    p.add_argument("--trees", type=int, help="number of trees, if not the backend's")
    p.add_argument("--synthetic-dir", default="data/synthetic")
    p = sub.add_parser("run")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--model-path")
    p.add_argument("--top-k", type=int, default=30)
    p.add_argument("--trees", type=int, help="number of trees, if not the backend's")
    p.add_argument("--single-file", action="store_true", help="write each output as one file")
    p.add_argument("--no-validate", action="store_true")
    p = sub.add_parser("validate")
    p.add_argument("-m", "--matching", default="output/matching_results.tsv")
    p.add_argument("-c", "--candidate", default="output/candidate_pairs.tsv")
    p.add_argument("-t", "--test-dir", default="dataset/test")
    p.add_argument("--check-ids", action="store_true")
    return top


def _report(r: checking.Report) -> int:
    for name, s in r.stats.items():
        print(f"{name}: {s['total']} rows ({s['empty']} empty, {s['non_empty']} non-empty)")
    for text in r.warnings:
        print(f"WARNING: {text}")
    for k, text in enumerate(r.errors, 1):
        print(f"{k}. {text}")
    print("PASS" if r.passed else f"FAIL: {len(r.errors)} to fix")
    return int(not r.passed)


def _preprocess(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.input_file and a.output_file:
        tsv.write_tsv(tsv.preprocess_tsv(spark, a.input_file), a.output_file, skip_existing=True)
    elif a.input_dir and a.output_dir:
        tsv.process_directory(spark, a.input_dir, a.output_dir)
    else:
        parser().print_help()
    return 0


def _sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Normalised sources; where a normalised file is missing, the raw one is normalised."""
    out = []
    for k in (1, 2, 3):
        path = tsv.find_source(spark, folder, k)
        d = tsv.read_tsv(spark, path)
        d = d.fillna("") if "normalized_" in path else normalize(spread(d))
        out.append(stage(d, f"source{k}"))
    return out


def _block(spark: SparkSession, a: argparse.Namespace) -> int:
    tsv.write_tsv(blocking.generate_candidate_pairs(*_sources(spark, a.normalized_dir), top_k=a.top_k), a.output)
    if a.ground_truth:
        truth = tsv.read_tsv(spark, a.ground_truth)
        print(blocking.evaluate_blocking_recall(tsv.load_candidates(spark, a.output), truth).first()["recall"])
    return 0


def _train(spark: SparkSession, a: argparse.Namespace) -> int:
    settings = {"trees": a.trees} if a.trees else {}
    if a.mode == "synthetic":
        t = resolution.train_synthetic(spark, backend=a.backend, **settings)
        training.save_model(spark, t, f"{a.model_dir}/{MODEL}")
        synthetic.save(spark, a.synthetic_dir)
        pairs = synthetic.candidates(spark)
        got = resolution.predict_matches(pairs, synthetic.entities(spark), t, a.use_mock_features)
        tsv.write_tsv(evaluation.assemble_matches(pairs, got), a.output)
        print(evaluation.evaluate_predictions(got, tsv.truth_lists(pairs)).first().asDict())
        return 0
    records, pairs = tsv.load_normalized(spark, a.normalized_dir), tsv.load_candidates(spark, a.candidate_file)
    known = bool(a.ground_truth) and tsv.exists(spark, a.ground_truth)
    truth = tsv.load_ground_truth(spark, a.ground_truth) if known else None
    if a.mode in ("train", "both"):
        if truth is None:
            print(f"no truth at {a.ground_truth}")
            return 1
        rows = resolution.build_training_set(pairs, records, truth, a.neg_ratio, a.max_pairs, a.use_mock_features)
        try:
            t = training.train_model(rows, a.backend, a.n_folds, **settings)
        except ValueError as e:
            print(e)
            return 1
        training.save_model(spark, t, a.model_path if a.mode == "train" and a.model_path else f"{a.model_dir}/{MODEL}")
        got = resolution.predict_matches(pairs, records, t, a.use_mock_features)
        print(evaluation.evaluate_predictions(got, truth).first().asDict())
    else:
        path = a.model_path or f"{a.model_dir}/{MODEL}"
        if not tsv.exists(spark, path):
            print(f"no model at {path}")
            return 1
        t = training.load_model(spark, path)
    if a.mode in ("predict", "both"):
        if a.test_normalized_dir:
            records = tsv.load_normalized(spark, a.test_normalized_dir)
        if a.test_candidate_file:
            pairs = tsv.load_candidates(spark, a.test_candidate_file)
        got = resolution.predict_matches(pairs, records, t, a.use_mock_features)
        tsv.write_tsv(evaluation.assemble_matches(pairs, got), a.output)
        if truth is not None:
            print(evaluation.evaluate_predictions(got, truth).first().asDict())
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    settings = {"trees": a.trees} if a.trees else {}
    out = resolution.run_pipeline(spark, a.data_dir, a.output_dir, a.model_path, a.top_k, not a.no_validate, a.single_file, **settings)
    print(out["stats"])
    return _report(out["report"]) if "report" in out else 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        return _report(checking.validate(spark, a.matching, a.candidate, a.test_dir, a.check_ids))
    except Exception as e:  # a store that can't be read is a failed check, not a crash
        print(f"FAIL: {e}")
        return 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    return {"preprocess": _preprocess, "block": _block, "train": _train, "run": _run, "validate": _validate}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
