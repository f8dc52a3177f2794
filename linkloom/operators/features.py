"""Stage 3A: the nine features of a candidate pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.similarity import field, levenshtein_ratio, text_similarity
from linkloom.session import ship

#: The order of the feature contract.
FEATURES = [
    "name_levenshtein_ratio", "name_jaro_winkler", "name_token_sort_ratio", "name_token_set_ratio",
    "address_levenshtein_ratio", "address_jaro_winkler", "address_token_sort_ratio", "address_token_set_ratio",
    "exact_zip_match",
]


def latest(entities: DataFrame) -> DataFrame:
    """One record for each id that isn't blank, the last by ``ord``."""
    cols = [c for c in entities.columns if c != "entity_id"]
    return (
        entities.filter("entity_id <> ''")
        .groupBy("entity_id")
        .agg(F.max_by(F.struct(*cols), "ord").alias("r"))
        .select("entity_id", "r.*")
    )


def join_records(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, cand) pairs with both records' name, address and zip; pairs that lack one are dropped."""
    e = latest(entities)
    side = lambda p: e.select(
        F.col("entity_id").alias(p), *(field(e.columns, k).alias(f"{p}_{k}") for k in ("name", "address", "zip"))
    )
    # the join on s1 needs this partitioning anyway; a set number keeps the string work spread out
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "s1").join(side("s1"), "s1").join(side("cand"), "cand")


def skipped_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row (pairs, no_s1, no_cand): pairs that ``join_records`` drops, by the record they lack first."""
    ids = entities.filter("entity_id <> ''").select("entity_id").distinct()
    side = lambda k: ids.select(F.col("entity_id").alias(k), F.lit(True).alias(f"has_{k}"))
    j = pairs.join(side("s1"), "s1", "left").join(side("cand"), "cand", "left")
    lacks = lambda k: F.col(f"has_{k}").isNull()
    return j.agg(F.count("*").alias("pairs"), F.count_if(lacks("s1")).alias("no_s1"), F.count_if(~lacks("s1") & lacks("cand")).alias("no_cand"))


def with_features(joined: DataFrame) -> DataFrame:
    """(s1, cand, FEATURES) of rows with s1_/cand_ name, address and zip, and their label if they have one."""
    ship(joined.sparkSession)
    out = joined
    for k in ("name", "address"):
        a, b = F.col(f"s1_{k}"), F.col(f"cand_{k}")
        both = (a != "") & (b != "")
        out = out.withColumn(f"_{k}", text_similarity(a, b)).withColumns(
            {f"{k}_levenshtein_ratio": levenshtein_ratio(a, b)}
            | {
                f"{k}_{n}": F.when(both, F.col(f"_{k}")[x]).otherwise(0.0)
                for n, x in (("jaro_winkler", "jw"), ("token_sort_ratio", "sort"), ("token_set_ratio", "set"))
            }
        )
    same: Column = (F.col("s1_zip") != "") & (F.col("s1_zip") == F.col("cand_zip"))
    out = out.withColumn("exact_zip_match", F.when(same, 1.0).otherwise(0.0))
    return out.select(*_kept(joined), *FEATURES)


def _kept(d: DataFrame) -> list[str]:
    return [c for c in ("s1", "cand", "label") if c in d.columns]


def with_mock_features(joined: DataFrame, seed: int = 42) -> DataFrame:
    """Stand-ins of the features, to try the steps around them: prefix and word shares, and noise."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    noise = lambda k: F.rand(seed + k) * 0.1 - 0.05
    n1, n2, a1, a2 = (F.col(c) for c in ("s1_name", "cand_name", "s1_address", "cand_address"))
    seq = F.sequence(F.lit(0), F.least(F.length(n1), F.length(n2)))
    same = F.size(F.filter(seq, lambda i: (i > 0) & (F.substring(n1, F.lit(1), i) == F.substring(n2, F.lit(1), i))))
    prefix = same / F.greatest(F.length(n1), F.length(n2), F.lit(1))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    share = lambda x, y: F.size(F.array_intersect(words(x), words(y))) / F.greatest(F.size(F.array_union(words(x), words(y))), F.lit(1))
    both = (a1 != "") & (a2 != "")
    own = {
        "name_levenshtein_ratio": clip(prefix + noise(1)),
        "name_jaro_winkler": clip(prefix * 0.85 + 0.15 + noise(2)),
        "name_token_sort_ratio": share(n1, n2),
        "name_token_set_ratio": share(n1, n2),
        "address_levenshtein_ratio": F.when(both, 0.1 + 0.6 * F.rand(seed + 3)).otherwise(0.0),
        "address_jaro_winkler": F.when(both, 0.2 + 0.6 * F.rand(seed + 4)).otherwise(0.0),
        "address_token_sort_ratio": share(a1, a2),
        "address_token_set_ratio": share(a1, a2),
        "exact_zip_match": F.when((F.col("s1_zip") != "") & (F.col("s1_zip") == F.col("cand_zip")), 1.0).otherwise(0.0),
    }
    return joined.select(*_kept(joined), *(own[n].alias(n) for n in FEATURES))


def feature_function(use_mock: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The scorer of joined pairs: the real features or, if asked for, the stand-ins."""
    return with_mock_features if use_mock else with_features


def extract_features(pairs: DataFrame, entities: DataFrame, use_mock: bool = False) -> DataFrame:
    return feature_function(use_mock)(join_records(pairs, entities))


def as_map(features: DataFrame) -> DataFrame:
    """(s1, cand, features map<string, float>)."""
    names = F.array(*(F.lit(n) for n in FEATURES))
    return features.select("s1", "cand", F.map_from_arrays(names, F.array(*(F.col(n).cast("float") for n in FEATURES))).alias("features"))
