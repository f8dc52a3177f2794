"""Stage 3B: training pairs, the classifier and prediction."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.session import ship, stage, unstage

from . import boosting
from .evaluation import best_threshold, prf, threshold_sweep
from .features import FEATURES

#: Settings of the boosted trees for each named backend; all run on this package's own trees.
BACKENDS = {
    "lightgbm": boosting.Settings(positive="balanced"),
    "xgboost": boosting.Settings(least=1, positive=5.0),
    "sklearn": boosting.Settings(rows=1.0, columns=1.0, l1=0.0, l2=0.0001),
    "legacy": boosting.Settings(trees=300, depth=5, leaves=31, least=20, rows=1.0, columns=1.0, l1=0.0, l2=0.0001),
}
#: Which backend stands in where one isn't known.
FALLBACK = "sklearn"
#: The classifier is fitted on at most so many training pairs, those of least hash.
MAX_ROWS = 200_000


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label, 1 where (s1, cand) is in ``truth``."""
    t = truth.select("s1", "cand").distinct().withColumn("label", F.lit(1))
    return pairs.join(t, ["s1", "cand"], "left").fillna(0, ["label"])


def sample_negatives(labelled: DataFrame, ratio: int = 5, seed: int = 42) -> DataFrame:
    """All positives and, for each s1, at most max(ratio * positives, 1) negatives, by hash order."""
    per = Window.partitionBy("s1")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "s1", "cand"))
    d = labelled.withColumn("_most", F.greatest(ratio * F.sum("label").over(per), F.lit(1)))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("s1", "label").orderBy(key, "cand")))
    return d.filter("label = 1 or _rn <= _most").drop("_most", "_rn")


def cap_pairs(pairs: DataFrame, max_pairs: int | None) -> DataFrame:
    """Whole s1 groups in id order until ``max_pairs`` is reached; 0 or None keeps all.

    Group counts are summed by range first, so the running total isn't one task's work. Ranges
    are staged, as their bounds come from a sample that a second run need not repeat.
    """
    if not max_pairs:
        return pairs
    n = pairs.groupBy("s1").count()
    part = stage(n.repartitionByRange("s1").withColumn("part", F.spark_partition_id()), "ranges")
    inside = part.withColumn("run", F.sum("count").over(Window.partitionBy("part").orderBy("s1")))
    totals = part.groupBy("part").agg(F.sum("count").alias("all"))
    before = totals.select(  # one row for each partition
        "part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    kept = inside.join(F.broadcast(before), "part").filter(F.col("before") + F.col("run") - F.col("count") < max_pairs)
    return pairs.join(kept.select("s1"), "s1", "left_semi")


def get_model(backend: str = "lightgbm", **settings) -> boosting.Settings:
    """Settings of a backend, or of the fallback if its name isn't known."""
    return replace(BACKENDS.get(backend, BACKENDS[FALLBACK]), **settings)


def with_folds(d: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Stratified folds: rows of a label are dealt to folds evenly by their pair's hash.

    A fold is a remainder of the hash, so no task sees all rows of a label; the shares of a
    label are alike over the folds but for chance.
    """
    return d.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "label", "s1", "cand"), F.lit(k)).cast("int"))


def bounded(features: DataFrame, most: int = MAX_ROWS, seed: int = 42) -> DataFrame:
    """The rows to fit on: all, or about the ``most`` of least hash of (s1, cand)."""
    n = features.count()
    if n <= most:
        return features
    share = int(most / n * (1 << 30))
    return features.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "s1", "cand"), F.lit(1 << 30)) < share)


def _arrays(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels in an order that doesn't depend on how rows arrived."""
    t = t.sort_values(["s1", "cand", "label", *FEATURES], kind="stable")
    return t[FEATURES].to_numpy(np.float32), t["label"].to_numpy(np.int64)


def train_model(features: DataFrame, backend: str = "lightgbm", n_folds: int = 5, most: int = MAX_ROWS, **settings) -> dict:
    """Cross-validate, choose the threshold on out-of-fold scores, and fit on all rows.

    ``features``: s1, cand, label and FEATURES. The folds' models and the whole model are fitted
    side by side, each by one task on at most about ``most`` rows. Returns model, threshold, f05
    and the folds' mean and deviation at 0.5. Without rows it raises ValueError.
    """
    spark = features.sparkSession
    ship(spark)
    own = get_model(backend, **settings)
    d = stage(with_folds(bounded(features.select("s1", "cand", "label", *FEATURES), most), n_folds), "training")
    if d.isEmpty():
        unstage(d)
        raise ValueError("no training pairs")
    # fold k's rows go to every model but the k-th; the last model has all rows
    dealt = d.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(n_folds))))

    def fit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        inside = t[t["fold"] != key[0]]
        model = boosting.fit(*_arrays(inside), own)
        rest = t[t["fold"] == key[0]]
        p = model.probabilities(rest[FEATURES].to_numpy(np.float32))
        out = pd.DataFrame({"s1": rest["s1"], "cand": rest["cand"], "y": rest["label"], "p": p, "fold": rest["fold"]})
        out["model"] = None
        if key[0] == n_folds:
            out = pd.DataFrame([[None, None, None, None, None, json.dumps(model.to_dict())]], columns=["s1", "cand", "y", "p", "fold", "model"])
        return out

    schema = "s1 string, cand string, y int, p double, fold int, model string"
    done = stage(dealt.repartition(n_folds + 1, "of").groupBy("of").applyInPandas(fit, schema), "folds")
    model = boosting.Trees.from_dict(json.loads(done.filter("model is not null").select("model").first()[0]))
    oof = done.filter("model is null")
    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    per = oof.groupBy("fold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    s = per.select(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("f")).agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("s")).first()
    best = best_threshold(threshold_sweep(oof)).first()
    for t in (d, done):
        unstage(t)
    return {
        "model": model, "threshold": best["threshold"], "f05": best["f05"], "backend": backend, "fold_mean": s["m"], "fold_std": s["s"],
    }


def score(model: boosting.Trees, d: DataFrame) -> DataFrame:
    """Adds p, the model's probability of a match."""
    spark = d.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the settings: trees times nodes

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(sent.value.probabilities(b.to_numpy(np.float32)))

    return d.withColumn("p", probability(F.struct(*(F.col(n).cast("double").alias(n) for n in FEATURES))))


def predict_pairs(features: DataFrame, trained: dict) -> DataFrame:
    """(s1, cand, p) at the threshold or above."""
    return score(trained["model"], features).filter(F.col("p") >= trained["threshold"]).select("s1", "cand", "p")


def as_lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1").agg(F.array_sort(F.collect_set("cand")).alias("ids"))


def save_model(spark: SparkSession, trained: dict, path: str) -> None:
    """One JSON line: the trees and what is known of them."""
    meta = {k: trained[k] for k in ("threshold", "f05", "backend")}
    meta |= {"feature_names": FEATURES, "n_features": len(FEATURES), "timestamp": time.strftime("%Y-%m-%d %H:%M:%S")}
    line = json.dumps(meta | {"trees": trained["model"].to_dict()})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {"model": boosting.Trees.from_dict(meta.pop("trees"))} | meta
