"""Deterministic synthetic sources for smoke runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.features import FEATURES

from .tsv import write_tsv

#: Name, address and zip of the ten template businesses.
TEMPLATES = [
    ("Walmart Supercenter", "702 SW 8th St, Bentonville, AR", "72716"),
    ("Starbucks Coffee", "2401 Utah Ave S, Seattle, WA", "98134"),
    ("Target Store", "1000 Nicollet Mall, Minneapolis, MN", "55403"),
    ("Home Depot", "2455 Paces Ferry Rd, Atlanta, GA", "30339"),
    ("McDonald's", "110 N Carpenter St, Chicago, IL", "60607"),
    ("Best Buy", "7601 Penn Ave S, Richfield, MN", "55423"),
    ("Costco Wholesale", "999 Lake Dr, Issaquah, WA", "98027"),
    ("Apple Store", "1 Apple Park Way, Cupertino, CA", "95014"),
    ("CVS Pharmacy", "1 CVS Dr, Woonsocket, RI", "02895"),
    ("Walgreens", "108 Wilmot Rd, Deerfield, IL", "60015"),
]


def entities(spark: SparkSession, n: int = 50) -> DataFrame:
    """Normalised-form records: for each i one S1, its true S2 and a wrong S3."""
    t = spark.createDataFrame([(k, *x) for k, x in enumerate(TEMPLATES)], "k int, name string, address string, zip string")
    i = spark.range(1, n + 1).withColumnRenamed("id", "i")
    kinds = F.array(
        *(
            F.struct(F.lit(s).alias("src"), F.lit(base).alias("base"), F.lit(word).alias("word"), k.alias("k"))
            for s, base, word, k in (
                ("S1", 0, "#", (F.col("i") - 1) % 10),
                ("S2", 10000, "store ", (F.col("i") - 1) % 10),
                ("S3", 20000, "branch ", F.col("i") % 10),
            )
        )
    )
    rows = i.withColumn("x", F.explode(kinds)).select("i", "x.*").join(F.broadcast(t), "k")  # ten rows
    addr = F.lower("address")
    return rows.select(
        F.concat("src", F.lit("-"), F.lpad((F.col("base") + F.col("i")).cast("string"), 5, "0")).alias("entity_id"),
        F.concat(F.lower("name"), F.lit(" "), "word", F.col("i").cast("string")).alias("business_name_clean"),
        F.when(F.col("src") == "S2", F.replace(addr, F.lit("st,"), F.lit("street,"))).otherwise(addr).alias("business_address_clean"),
        F.lit("US").alias("country"),
        F.col("zip").alias("postal_code"),
        F.concat(F.lower("name"), F.lit(" "), F.when(F.col("src") == "S1", "").otherwise(F.col("word")), F.col("i").cast("string")).alias("name_tokens"),
        F.col("i").alias("ord"),
    )


def candidates(spark: SparkSession, n: int = 50) -> DataFrame:
    i = spark.range(1, n + 1).withColumnRenamed("id", "i")
    of = lambda s, b: F.concat(F.lit(s), F.lpad((F.col("i") + b).cast("string"), 5, "0"))
    return i.select(
        of("S1-", 0).alias("source1_entity_id"),
        F.concat_ws(",", of("S2-", 10000), of("S3-", 20000)).alias("candidate_entity_ids"),
        of("S2-", 10000).alias("matched_entity_ids"),
        F.col("i").alias("ord"),
    )


def save(spark: SparkSession, folder: str, n: int = 50) -> None:
    """Write the synthetic candidates, truth and records as TSV files."""
    c = candidates(spark, n)
    write_tsv(c.drop("matched_entity_ids"), f"{folder}/synthetic_candidate_pairs.tsv")
    write_tsv(c.drop("candidate_entity_ids"), f"{folder}/synthetic_ground_truth.tsv")
    write_tsv(entities(spark, n), f"{folder}/synthetic_normalized_records.tsv")


def feature_rows(spark: SparkSession, n: int = 5000, share: float = 0.1, seed: int = 42) -> DataFrame:
    """s1, cand, label and FEATURES: positives score high, negatives low."""
    pos = F.col("id") < int(n * share)
    d = spark.range(n).select(F.concat(F.lit("S1-"), "id").alias("s1"), F.concat(F.lit("S2-"), "id").alias("cand"), pos.cast("int").alias("label"))
    for k, name in enumerate(FEATURES):
        u = F.rand(seed + k)
        v = F.when(F.col("label") == 1, 0.55 + 0.45 * u).otherwise(0.45 * u)
        if name == "exact_zip_match":
            v = (u < F.when(F.col("label") == 1, 0.85).otherwise(0.05)).cast("double")
        d = d.withColumn(name, v)
    return d.orderBy(F.md5(F.concat(F.lit(str(seed)), "s1")))
