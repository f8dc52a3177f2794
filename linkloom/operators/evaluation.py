"""Thresholds, scores of predictions, and assembly of the matching table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... below stop, each by one multiplication."""
    n = -int(-(stop - start) // step)
    return [start + i * step for i in range(n)]


#: The thresholds that are tried.
SWEEP, LEGACY_SWEEP = grid(0.30, 0.96, 0.01), grid(0.10, 0.95, 0.05)


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    return F.when(precision + recall > 0, (1 + b2) * precision * recall / (b2 * precision + recall)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, f_beta(p, r)


def threshold_sweep(scored: DataFrame, steps: list[float] = SWEEP) -> DataFrame:
    """(step, threshold, tp, fp, fn, precision, recall, f05) for pooled (y, p) rows.

    One pass: rows are counted by the highest threshold that they reach, then summed from the
    top over the few thresholds.
    """
    lit = F.array(*(F.lit(t) for t in steps))
    got = scored.select("y", F.size(F.filter(lit, lambda t: F.col("p") >= t)).alias("n")).groupBy("n").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    spark = scored.sparkSession
    rows = spark.createDataFrame(list(enumerate(steps, 1)), "step int, threshold double")
    all_ = got.unionByName(rows.select(F.col("step").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")))
    per = all_.groupBy("n").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.orderBy(F.col("n").desc())  # one row for each threshold
    sums = per.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}).withColumn(
        "fn", F.sum("pos").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.coalesce("fn", F.lit(0)))
    return rows.join(F.broadcast(sums), F.col("step") == F.col("n")).select(
        "step", "threshold", "tp", "fp", F.coalesce("fn", F.lit(0)).alias("fn"), p.alias("precision"), r.alias("recall"), f.alias("f05")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """One row (threshold, f05): the lowest threshold of the best score; 0.5 and 0 if all are 0."""
    top = sweep.filter("f05 > 0").agg(F.max(F.struct("f05", -F.col("step"), "threshold")).alias("m"))
    return top.select(F.coalesce(F.col("m.threshold"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col("m.f05"), F.lit(0.0)).alias("f05"))


def top_thresholds(sweep: DataFrame, n: int = 10) -> DataFrame:
    return sweep.orderBy(F.col("f05").desc(), "step").limit(n)


def macro_f05(pairs: DataFrame) -> DataFrame:
    """One row: mean F0.5 over s1 of (s1, y, pred) pairs."""
    y, d = F.col("y") == 1, F.col("pred") == 1
    per = pairs.groupBy("s1").agg(F.count_if(y & d).alias("tp"), F.count_if(~y & d).alias("fp"), F.count_if(y & ~d).alias("fn"))
    return per.agg(F.coalesce(F.avg(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]), F.lit(0.0)).alias("macro_f05"))


def macro_threshold(scored: DataFrame, steps: list[float] = SWEEP) -> DataFrame:
    """As best_threshold, by the mean of F0.5 over s1."""
    lit = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(steps, 1)))
    at = scored.withColumn("g", F.explode(lit)).select("s1", "y", "g.*", (F.col("p") >= F.col("g.threshold")).alias("d"))
    y = F.col("y") == 1
    per = at.groupBy("step", "threshold", "s1").agg(
        F.count_if(y & F.col("d")).alias("tp"), F.count_if(~y & F.col("d")).alias("fp"), F.count_if(y & ~F.col("d")).alias("fn")
    )
    return best_threshold(per.groupBy("step", "threshold").agg(F.avg(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]).alias("f05")))


def evaluate_predictions(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of macro and micro scores of (s1, ids array) over all entities of ``truth``.

    An entity with neither truth nor prediction scores 0, as the reference point of the task has it.
    """
    none = F.array().cast("array<string>")
    p = predicted.select("s1", F.array_distinct("ids").alias("got"))
    j = truth.select("s1", F.array_distinct("ids").alias("want")).join(p, "s1", "left").withColumn("got", F.coalesce("got", none))
    n = j.select(
        F.size(F.array_intersect("got", "want")).alias("tp"),
        F.size(F.array_except("got", "want")).alias("fp"),
        F.size(F.array_except("want", "got")).alias("fn"),
    )
    f = prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    s = n.agg(
        F.coalesce(F.avg(f), F.lit(0.0)).alias("macro_f05"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")),
    )
    mp, mr, mf = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("macro_f05", mp.alias("micro_precision"), mr.alias("micro_recall"), mf.alias("micro_f05"), "tp", "fp", "fn")


def assemble_matches(candidates: DataFrame, predicted: DataFrame, check_ids: bool = True) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) for every candidate row: predictions that are candidates.

    With ``check_ids`` only ids of sources 2 and 3 other than the row's own stay; the legacy
    form of the table goes without that rule.
    """
    p = predicted.groupBy("s1").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    ids = F.filter(F.transform(F.split(F.coalesce("candidate_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    good = F.array_intersect(ids, F.coalesce("ids", F.array().cast("array<string>")))
    if check_ids:
        good = F.filter(good, lambda x: x.rlike("^S[23]-") & (x != F.col("source1_entity_id")))
    return candidates.join(p, candidates.source1_entity_id == p.s1, "left").select(
        "source1_entity_id", F.array_join(F.array_sort(good), ",").alias("matched_entity_ids")
    )


def match_stats(matches: DataFrame) -> DataFrame:
    n = F.when(F.col("matched_entity_ids") == "", 0).otherwise(F.size(F.split("matched_entity_ids", ",")))
    return matches.agg(
        F.count("*").alias("n_rows"),
        F.count_if(n > 0).alias("with_match"),
        F.count_if(n == 0).alias("singletons"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("pairs"),
    )
